"""Jaccard join of word shingles by PartEnum signatures.

The sizes of sets fall into bands. Two sets of a band that are similar enough differ in at most k
shingles, so of n1 parts of the shingle domain one holds few of the differences. That part is cut
again into n2 pieces, and every choice that leaves some pieces out is enumerated: one choice leaves
out all differences, and what both sets have in the rest is the same. A signature is a hash of that.

With spare parts two similar sets agree in several parts. So a set may leave out the signatures of
projections with hardly a shingle, which many unlike sets share, as long as no more parts than the
spare ones have such: in one more part the sets agree, and there neither leaves anything out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations, product
from math import comb, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from settlespark.llm.components import components
from settlespark.llm.decontaminate import gram_hashes, membership, word_hashes
from settlespark.session import durable

GRAM, SHARE = 4, (85, 100)
WIDTH = 1.25  # greatest by least size of a band
#: Differences left in a part and pieces of a part: dearer ones later, each with longer projections.
CHOICES = ((0, 1), (1, 3), (1, 4), (2, 5), (2, 7), (3, 7), (3, 8), (4, 9), (5, 11))
THIN = 2  # shingles below which a projection is thin; one less where that saves half of the signatures
MEETINGS = 24.0  # unlike sets of a band that may share an empty projection
FLUSH = 1 << 19  # signatures a task holds before it hands them on
SLOT = 1 << 19  # signatures that are sorted together
TOGETHER = 1 << 21  # shingles of the sets that a task holds at a time
CROSS = 8  # open pairs for each row of the groups, below which they are all compared
STILL = 0.5  # share of the open pairs that a round left, above which it was not worth another
SHORT = (1 << 48) - 1
HEAD = 16  # numbers of 64 parities that travel with a set
LONG = 2 * 64 * HEAD  # shingles beyond which a set has a sketch with more parities than that
PIVOTS = 8  # nodes of a signature that the others are compared with in one round

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def texts_of(column):
    """Values of an Arrow text column, one by one; a null counts as an empty text."""
    for value in column:
        yield value.as_py() or ""


def shingle_set(text: str, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; of fewer words, one of them all."""
    data = text.encode("utf-8", "surrogatepass").lower()
    inside = np.concatenate(([False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    words = word_hashes(data, edges[::2], edges[1::2])
    return np.unique(gram_hashes(words, min(gram, len(words)) or 1))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


# --- bands and signatures --------------------------------------------------------------------------


def band_of(size: int) -> int:
    """The number of the band that holds sets of this size."""
    band = max(0, int(log(size) / log(WIDTH)) - 1)
    while band_top(band) < size:
        band += 1
    return band


def band_top(band: int) -> int:
    """The greatest size of a band."""
    return int(WIDTH ** band)


def most_apart(top: int, share: tuple[int, int] = SHARE) -> int:
    """Differences of two similar sets of at most ``top`` shingles each: from I >= share * U, with I and U by size."""
    return 2 * top * (share[1] - share[0]) // (share[1] + share[0])


def needed(apart: int, left: int) -> int:
    """Parts of which one at least holds no more than ``left`` of the differences."""
    return apart // (left + 1) + 1


def _fewer(mean: float, n: int) -> float:
    """Probability that a Poisson number is less than ``n``."""
    total, term = 0.0, exp(-mean)
    for i in range(n):
        total, term = total + term, term * mean / (i + 1)
    return total


def layout(top: int, population: int, share: tuple[int, int] = SHARE) -> tuple[int, int, int, int]:
    """``(n1, n2, left, thin)`` for a band: the cheapest choice, with spare parts, under which unlike sets seldom share empty projections."""
    apart = most_apart(top, share)
    if apart == 0:
        return 1, 1, 0, THIN
    found = []
    for (left, pieces), thin in product(CHOICES, (THIN, THIN - 1)):
        least = needed(apart, left)
        for spare in sorted({*range(min(least, 8) + 1), *(least * i // 16 for i in range(17))}):
            parts, choices = least + spare, comb(pieces, left)
            held = top / WIDTH / parts * (pieces - left) / pieces
            empty = exp(-held) * (1 - _fewer(parts * min(1.0, choices * _fewer(held, thin)), spare))
            if population * empty <= MEETINGS:
                found.append((parts * choices * (1 + THIN - thin), parts, pieces, left, thin))
                break
    left, pieces = CHOICES[-1]
    return min(found)[1:] if found else (needed(apart, left), pieces, left, THIN)


def bands_for(size: int, share: tuple[int, int] = SHARE) -> range:
    """Bands in which a set must be signed: its own, and those of similar sets that are larger."""
    return range(band_of(size), band_of(size * share[1] // share[0]) + 1)


class Signer:
    """Signatures of sets under the layouts of all bands.

    Those of thin projections are left out where no more parts have such than are spare: of a similar set the
    parts that agree are more, and one of them has no thin projection in either set.
    """

    def __init__(self, plan: dict[int, tuple[int, ...]], share: tuple[int, int] = SHARE):
        self.share, self.bands = share, {}
        for band, (parts, pieces, left, *thin) in plan.items():
            gone = np.array(list(combinations(range(pieces), left)), np.int64).reshape(comb(pieces, left), left)
            spot = np.arange(parts * len(gone), dtype=np.uint64).reshape(parts, len(gone)) * np.uint64(256) + np.uint64(band + 1)
            spare = parts - needed(most_apart(band_top(band), share), left)
            self.bands[band] = parts, pieces, gone, spot * _MIX, spare, thin[0] if thin else THIN

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """All signatures of a set; none for an empty set."""
        out = []
        values = _mixed(shingles + _ODD)
        for band in bands_for(len(shingles), self.share) if len(shingles) else ():
            parts, pieces, gone, spot, spare, least = self.bands[band]
            cell = (((_mixed(shingles + np.uint64(band * int(_ODD) % 2 ** 64)) >> np.uint64(32)) * np.uint64(parts * pieces)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(parts * pieces, np.uint64)
            np.add.at(sums, cell, values)
            sums = sums.reshape(parts, pieces)
            rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums[:, gone].sum(axis=2, dtype=np.uint64)
            sigs = _mixed(_mixed(rest + _ODD) + spot)
            if spare > 0:
                held = np.bincount(cell, minlength=parts * pieces).reshape(parts, pieces)
                thin = held.sum(axis=1)[:, None] - held[:, gone].sum(axis=2) < least
                if np.count_nonzero(thin.any(axis=1)) <= spare:
                    sigs = sigs[~thin]
            out.append(sigs.ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


# --- Spark jobs -------------------------------------------------------------------------------------


def sized(docs: DataFrame, id_col: str, text_col: str, gram: int = GRAM) -> DataFrame:
    """``(id, set, short, n)`` for every row: the digest of its shingle set, the first 48 bits of that, and its size."""
    def run(batches):
        for batch in batches:
            digests, sizes = [], []
            for text in texts_of(batch.column(1)):
                shingles = shingle_set(text, gram)
                digests.append(digest(shingles))
                sizes.append(len(shingles))
            short = np.frombuffer(b"".join(digests), np.int64)[::2] & SHORT
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(short), pa.array(sizes, pa.int64())], names=["id", "set", "short", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, set binary, short bigint, n bigint")


def classes_of(marked: DataFrame) -> DataFrame:
    """``(node, set, short, n, first)``: one row for each set that is not empty, with a number of its own and the least id.

    The number is the short digest; where sets share that, the further ones are told apart in its upper bits.
    """
    found = marked.where("n > 0").groupBy("set", "short", "n").agg(F.min("id").alias("first"))
    nth = F.row_number().over(Window.partitionBy("short").orderBy("set")) - 1
    return found.select((F.col("short") + nth.cast("long") * (SHORT + 1)).alias("node"), "set", "short", "n", "first")


def band_plan(sets: DataFrame, share: tuple[int, int] = SHARE) -> tuple[dict[int, tuple[int, ...]], int]:
    """The layout of every band in use, and how many signatures all sets have. Four rows for each band reach the driver."""
    rows = sets.select(F.ceil(F.log("n") / F.lit(log(WIDTH)) * 4).alias("step"), "n").groupBy("step").agg(
        F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    population: dict[int, int] = {}
    for r in rows:
        for band in range(band_of(r.least), bands_for(r.most, share)[-1] + 1):
            population[band] = population.get(band, 0) + r.rows
    plan = {band: layout(band_top(band), count, share) for band, count in population.items()}
    total = sum(r.rows * sum(plan[b][0] * comb(plan[b][1], plan[b][2]) for b in bands_for(r.most, share)) for r in rows)
    return plan, total


def _packed(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(parts: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    return np.pad(data, ((0, 0), (0, 8 - width))).view("<u8").ravel()


def _repeats(sigs: np.ndarray) -> np.ndarray:
    """Of sorted signatures, those that are not the first of their kind."""
    out = np.zeros(len(sigs), bool)
    out[1:] = sigs[1:] == sigs[:-1]
    return out


def groups(docs: DataFrame, text_col: str, plan: dict[int, tuple[int, ...]], total: int, gram: int = GRAM, share: tuple[int, int] = SHARE) -> DataFrame:
    """``(sig, short)``: sets, by their short digest, whose signature another set has as well; at times a row twice.

    A signature becomes a slot and 40 bits within it. A task sends one set of each signature it holds
    to the slot; further sets of the same signature go elsewhere, spread evenly, since it is known
    already that they share it. So however many near copies there are, a slot gets at most one entry
    of a signature from each load of a task. A chance meeting of two signatures costs a comparison.
    """
    slots = max(1, -(-total // SLOT), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from pyspark import TaskContext

        signed, load = Signer(plan, share), TaskContext.get().partitionId() * 7919
        sigs, sets, held = [], {}, 0

        def handed():
            d = np.repeat(np.fromiter(sets, np.uint64, len(sets)), [len(s) for s in sigs])
            s = np.concatenate(sigs)
            slot = s % np.uint64(slots)
            s = (slot << np.uint64(40)) | ((s // np.uint64(slots)) & np.uint64((1 << 40) - 1))
            order = np.argsort(s)
            s, d = s[order], d[order]
            later = _repeats(s)
            slot, rest, own = (s >> np.uint64(40))[~later], s[~later], d[~later]
            cuts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))
            rows = [(int(slot[a]), _packed(rest[a:b], 5), _packed(own[a:b], 6)) for a, b in zip(cuts, cuts[1:])]
            if later.any():
                both = later.copy()
                both[:-1] |= later[1:]
                rows.append((slots + load % slots, s[both].tobytes(), _packed(d[both], 6)))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["slot", "sigs", "sets"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                shingles = shingle_set(text, gram)
                key = int.from_bytes(digest(shingles)[:6], "little")
                if len(shingles) and key not in sets:
                    sets[key] = None
                    sigs.append(signed(shingles))
                    held += len(sigs[-1])
                if held > FLUSH:
                    yield handed()
                    sigs, sets, held, load = [], {}, 0, load + 1
        if held:
            yield handed()

    def found(table: pa.Table) -> pa.Table:
        slot, sigs, sets = table.column("slot")[0].as_py(), table.column("sigs").to_pylist(), _unpacked(table.column("sets").to_pylist(), 6)
        if slot >= slots:
            sigs = np.frombuffer(b"".join(sigs), np.int64)
        else:
            sigs = _unpacked(sigs, 5)
            order = np.lexsort((sets, sigs))
            sigs, sets = sigs[order], sets[order]
            fresh = np.ones(len(sigs), bool)
            fresh[1:] = (sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1])
            sigs, sets = sigs[fresh], sets[fresh]
            keep = _repeats(sigs)
            keep[:-1] |= keep[1:]
            sigs, sets = (sigs[keep] | np.uint64(slot << 40)).view(np.int64), sets[keep]
        return pa.table({"sig": pa.array(sigs), "short": pa.array(sets.view(np.int64))})

    dealt = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "slot int, sigs binary, sets binary")
    return dealt.groupBy("slot").applyInArrow(lambda table: found(table), "sig bigint, short bigint")


def parities(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the counts in ``bits`` cells, packed: sets differ in at least as many shingles as parities."""
    counts = np.zeros(bits, np.uint8)
    np.add.at(counts, (_mixed(shingles ^ _MIX) & np.uint64(bits - 1)).astype(np.int64), 1)
    return np.packbits(counts & 1, bitorder="little")


def sketch(shingles: np.ndarray) -> bytes:
    """Parities in half as many cells as shingles, or more: they tell most sets apart that share less than three quarters."""
    return parities(shingles, max(64, 1 << (len(shingles) - 1).bit_length() - 1)).tobytes()


def parities_apart(a: bytes, b: bytes) -> int:
    """Parities in which two sketches differ; the longer is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


#: What can be taken from a set, and how it is stored.
TAKEN = {"head": (lambda x: parities(x, 64 * HEAD).view(np.int64), pa.list_(pa.int64()), "array<bigint>"),
         "sketch": (lambda x: sketch(x) if len(x) > LONG else b"", pa.binary(), "binary"), "shingles": (lambda x: x.view(np.int64), pa.list_(pa.int64()), "array<bigint>")}


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, take: tuple[str, ...], gram: int = GRAM) -> DataFrame:
    """``(node, n, *take)`` of the sets in ``wanted``, once each.

    Only rows with the least id of a wanted set can be needed. A bitmap of bounded size, with ids and sets, thins the scan.
    """
    bits = min(28, max(20, int(wanted.count() * 64).bit_length()))
    marks = wanted.select(F.explode(F.array(F.xxhash64("first"), "short")).alias("fp"))
    shared, low = docs.sparkSession.sparkContext.broadcast(membership(marks, bits)), (1 << bits) - 1

    def run(batches):
        held, found, size = np.frombuffer(shared.value, np.uint8), {}, 0

        def handed():
            columns = [pa.array([TAKEN[t][0](x) for x in found.values()], TAKEN[t][1]) for t in take]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *columns], names=["set", *take])

        for batch in batches:
            spot = batch.column(0).to_numpy() & low
            rows = np.flatnonzero(held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            for text in texts_of(batch.column(1).take(pa.array(rows))):
                shingles = shingle_set(text, gram)
                key = digest(shingles)
                bit = int.from_bytes(key[:6], "little") & low
                if held[bit >> 3] >> (bit & 7) & 1 and key not in found:
                    found[key] = shingles
                    size += len(shingles)
                if size > TOGETHER:
                    yield handed()
                    found, size = {}, 0
        yield handed()

    rows = docs.select(F.xxhash64(F.col(id_col)).alias("row"), F.col(text_col).alias("text"))
    kept = rows.mapInArrow(run, ", ".join(["set binary", *(f"{t} {TAKEN[t][2]}" for t in take)]))
    once = kept.groupBy("set").agg(*[F.first(t).alias(t) for t in take])
    return once.join(wanted.select("set", "node", "n"), "set").drop("set")


def _beside(found: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs ``(a, b)`` with the sizes and a column of both their sets."""
    for side in "ab":
        found = found.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", column)]), side)
    return found


def likely(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Of the pairs ``(a, b, long)`` of nodes those that their sketches do not rule out; only two long sets have such."""
    def run(batches):
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            apart = [parities_apart(p, q) for p, q in zip(x, y)]
            near = [(share[1] + share[0]) * d <= (share[1] - share[0]) * (i + j) for d, i, j in zip(apart, n, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["a", "b"])

    long = _beside(pairs.where("long").drop("long"), sets.where(F.col("n") > LONG), "sketch")
    return pairs.where("not long").select("a", "b").unionByName(
        long.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint"))


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose nodes the links do not join already."""
    known = components(links)
    for side in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return pairs.where("not coalesce(of_a, a) <=> coalesce(of_b, b)").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame], share: tuple[int, int] = SHARE) -> DataFrame:
    """Links among the pairs ``(a, b, long)`` that join what all similar pairs join: sketches rule most others out, whole sets decide.

    First each node is compared with the least of its partners, then the nodes of pairs that are still apart.
    """
    def decided(pairs):
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return durable(_beside(pairs, full, "shingles").where(share[1] * both >= share[0] * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))

    maybe = durable(likely(durable(pairs), sets, share))
    ends = maybe.select(F.col("a").alias("node"), F.col("b").alias("other")).union(maybe.select("b", "a")).groupBy("node").agg(F.min("other").alias("other"))
    full = whole(ends.select("node"))
    found = decided(ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    rest = durable(unlinked(maybe, found))
    return found if rest.isEmpty() else found.unionByName(decided(rest))


def distinct_lists(groups: DataFrame) -> DataFrame:
    """``(sig, node, n)`` for one signature of each list of nodes: near copies share most of their signatures."""
    lists = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    kept = lists.where("c > 1").groupBy("c", "x", "s").agg(F.min("sig").alias("sig")).select("sig")
    return groups.join(kept, "sig", "left_semi")


def _perhaps(share: tuple[int, int]):
    """Whether the rows ``a`` and ``b`` of a join may be similar, by sizes and by the parities of 1,024 cells. It runs within the join."""
    apart = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(HEAD)), F.lit(0))
    n, m = F.col("a.n"), F.col("b.n")
    return (share[1] * F.least(n, m) >= share[0] * F.greatest(n, m)) & ((share[1] + share[0]) * apart <= (share[1] - share[0]) * (n + m))


def _met(left: DataFrame, right: DataFrame, unlike, share: tuple[int, int]) -> DataFrame:
    """Distinct pairs ``(a, b, long)`` of nodes that share a signature, differ in label and may be similar, and whether both are long."""
    found = left.alias("a").join(right.alias("b"), (F.col("a.sig") == F.col("b.sig")) & unlike & _perhaps(share))
    return found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"),
                        (F.least("a.n", "b.n") > LONG).alias("long")).distinct()


def joined(groups: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame], share: tuple[int, int] = SHARE, rounds: int = 6) -> DataFrame:
    """Links ``(a, b)`` of nodes that leave every pair of similar sets in one component.

    While many pairs of unlike components share a signature, the nodes of each signature are compared
    with a few of them only, so copies of one text melt into a component without meeting in pairs.
    Once few pairs are open, or a round leaves most of them open, all open pairs are compared: after that
    no link can be missing. Pairs that parities of their sets rule out never leave the join; of the
    others ``whole`` gives the shingles.
    """
    heads = sets.select("node", *[F.col("head")[i].alias(f"w{i}") for i in range(HEAD)])
    links, size, before = None, groups.count(), None
    for turn in range(rounds + 1):
        rows = groups.withColumn("label", F.col("node"))
        if links is not None:
            known = components(links)
            rows = groups.join(known, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("label"))
        counts = rows.groupBy("sig", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("sig").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"))
        mixed = durable(counts.where("open > 0"))
        left = mixed.agg(F.sum("open")).first()[0] or 0
        rows = durable(rows.join(mixed.select("sig"), "sig", "left_semi").join(heads, "node"))
        if left <= CROSS * size or turn == rounds or before is not None and left > STILL * before:
            break
        few = [F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)]
        pivots = rows.groupBy("sig").agg(F.array_distinct(F.array(*few)).alias("p")).select("sig", F.explode("p").alias("p")).select("sig", "p.*").join(heads, "node")
        found = verified(_met(rows, pivots, F.col("a.label") != F.col("b.label"), share), sets, whole, share)
        links, before = found if links is None else links.unionByName(found), left
    found = verified(_met(rows, rows, F.col("a.label") < F.col("b.label"), share), sets, whole, share)
    return found if links is None else links.unionByName(found)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, share: tuple[int, int] = SHARE) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per document.

    A document's set holds its distinct word shingles, A-Z lower-cased and split at ASCII white
    space; with fewer words the whole sequence is the one shingle. Documents link when the
    intersection is at least ``share`` of the union; ``component_id`` is the least id that links
    reach. Texts that are null or without words have an empty set and stay alone. Equal sets are
    folded to one before any join. Rows that repeat an id count each; a null id belongs to its
    component but never names it. Shingles are told apart by 64-bit hashes. Other columns are not read;
    an empty table gives no rows.
    """
    marked = durable(sized(docs, id_col, text_col, gram))
    classes = durable(classes_of(marked))
    plan, total = band_plan(classes, share)
    held = durable(groups(docs, text_col, plan, total, gram, share).distinct())
    members = durable(distinct_lists(held.join(classes.select("short", "node", "n"), "short").select("sig", "node", "n")))

    def taken(nodes, *take):
        return durable(sets_of(docs, id_col, text_col, durable(classes.join(nodes, "node", "left_semi")), take, gram))

    sketches = taken(members.select("node").distinct(), "head", "sketch")
    found = components(joined(members, sketches, lambda nodes: taken(nodes, "shingles"), share))
    labels = classes.join(found, "node", "left").select("set", "first", F.coalesce("component", "node").alias("label"))
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labels.join(least, "label").select("set", "component_id")
    return marked.join(named, "set", "left").select("id", F.col("n").alias("n_shingles"),
                                                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
