"""Benchmark decontamination by winnowed fingerprints.

Of every window of ``span - k + 1`` consecutive k-gram hashes the least is kept, so two texts
that share ``span`` consecutive words keep a fingerprint in common. Shared fingerprints are
then extended to the windows of ``span`` words around them and compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import ascii_lower, broadcast_if_small, column_texts
from settlespark.session import durable

SPAN, GRAM = 13, 5
FILTER_BITS = 23  # of the membership bitmap that every task gets: 1 MB, whatever the benchmark
MAPPED = 32768  # bits in one bitmap of Spark's bitmap functions

_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_table(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text in UTF-8 with A-Z lowered, and where its words start and end."""
    data = text.encode("utf-8", "surrogatepass").lower()
    inside = np.concatenate(([False], _KEPT[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes and their places in it. Equal words agree."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    spans = ends - starts
    first = np.cumsum(spans) - spans
    place = np.arange(int(spans.sum())) - np.repeat(first, spans)
    chars = raw[np.repeat(starts, spans) + place].astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed((chars + np.uint64(1)) * _ODD + place.astype(np.uint64) * _MIX), first))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = total * _ODD + words[i:i + n]
    return _mixed(total)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the last of equal ones; each place once."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    places = np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(places)


def _seeds(hashes: np.ndarray, short: list[int], span: int, k: int):
    """``(k, places, hashes)`` of the fingerprints: winnowed ones for whole windows, all for short items."""
    grams = gram_hashes(hashes, k)
    places = winnowed(grams, span - k + 1)
    yield k, places, grams[places]
    for size in short:
        grams = gram_hashes(hashes, size)
        yield 0 - size, np.arange(len(grams)), grams


def item_tables(items: DataFrame, id_col: str, text_col: str, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """``(item, size, words, fps)``: every window of every item and the fingerprints in it."""
    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), column_texts(batch.column(1))):
                data, starts, ends = word_table(text)
                n, hashes = len(starts), word_hashes(data, starts, ends)
                words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends)]
                if n >= span:
                    grams = gram_hashes(hashes, k)
                    kept = {int(p): int(grams[p]) for p in winnowed(grams, span - k + 1)}
                    for i in range(n - span + 1):
                        fps = [kept[p] for p in range(i, i + span - k + 1) if p in kept]
                        rows.append((item, span, " ".join(words[i:i + span]), fps))
                elif n:
                    rows.append((item, n, " ".join(words), [int(gram_hashes(hashes, n)[0])]))
            cols = list(zip(*rows)) or [(), (), (), ()]
            fps = pa.array([np.array(f, np.uint64).view(np.int64) for f in cols[3]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), fps],
                                             names=["item", "size", "words", "fps"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        run, "item string, size int, words string, fps array<bigint>")


def membership(fps: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """Bitmap of the low bits of all fingerprints ``fp``; its size is fixed by ``bits`` alone."""
    low = F.col("fp").bitwiseAND((1 << bits) - 1)
    maps = fps.select((low / MAPPED).cast("int").alias("bucket"), (low % MAPPED).alias("bit")).groupBy("bucket").agg(
        F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    out = bytearray(1 << bits - 3)
    for row in maps.toLocalIterator():
        at = row.bucket * MAPPED // 8
        out[at:at + len(row.bitmap)] = row.bitmap
    return bytes(out)


def candidates(docs: DataFrame, id_col: str, text_col: str, bitmap: bytes, short: list[int],
               span: int = SPAN, k: int = GRAM) -> DataFrame:
    """``(id, digest, n_words, seeds)`` of every row.

    A seed is a fingerprint that the bitmap holds, with the words around it that a shared
    window can cover, and the place of the first of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        import hashlib

        held = np.frombuffer(shared.value, np.uint8)
        low = np.uint64(8 * len(held) - 1)
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            digests, counts, found = [], [], []
            for text in column_texts(batch.column(1)):
                data, starts, ends = word_table(text)
                n, hashes = len(starts), word_hashes(data, starts, ends)
                seeds = []
                for size, places, fps in _seeds(hashes, short, span, k):
                    bit = fps & low
                    hit = (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                    for i in np.flatnonzero(hit):
                        p, whole = int(places[i]), size > 0
                        a, b = (max(0, p - (span - k)), min(n, p + span)) if whole else (p, p - size)
                        words = [data[x:y].decode("utf-8", "replace") for x, y in zip(starts[a:b], ends[a:b])]
                        seeds.append({"fp": int(fps[i:i + 1].view(np.int64)[0]), "size": span if whole else -size, "start": a, "words": words})
                digests.append(hashlib.md5(data).digest())
                counts.append(n)
                found.append(seeds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, kind)],
                                             names=["id", "digest", "n_words", "seeds"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, digest binary, n_words bigint, seeds array<struct<fp:bigint,size:int,start:int,words:array<string>>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", span: int = SPAN, k: int = GRAM, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """``(id, digest, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    ``span`` consecutive words of an item; an item of fewer words is one window, whose
    fingerprints are not thinned. A document word inside a window is hit; a document is
    contaminated if at least ``share`` of its words are. Null and empty texts have no words and
    no hits; an empty benchmark hits nothing; repeated rows are judged each, alike; repeated
    items count once by id, and an item with a null id hits but is not listed.

    The scan keeps only fingerprints that a bitmap of fixed size may hold; a join on the
    fingerprint and another on the window decide. Copies of a window in a document and in the
    benchmark are folded before they meet, so a passage shared by many documents costs one
    row for each of them and item.
    """
    found = durable(item_tables(items, item_col, item_text_col, span, k))
    fps = durable(found.select(F.explode("fps").alias("fp")).distinct())
    short = sorted(r.size for r in found.where(F.col("size") < span).select("size").distinct().collect())  # span - 1 sizes at most
    scanned = durable(candidates(docs, id_col, text_col, membership(fps), short, span, k))

    seeds = scanned.select("id", "digest", F.explode("seeds").alias("s")).select("id", "digest", "s.*")
    met = seeds.join(broadcast_if_small(fps, fps.count()), "fp", "left_semi")
    spread = met.select("id", "digest", "size", "start", F.posexplode(F.expr(
        "transform(sequence(0, size(words) - size), i -> array_join(slice(words, i + 1, size), ' '))")).alias("shift", "words")
    ).select("id", "digest", "size", (F.col("start") + F.col("shift")).alias("at"), "words").distinct()
    windows = durable(found.select("size", "words").distinct())
    hits = durable(spread.join(broadcast_if_small(windows, windows.count(), 50_000), ["size", "words"], "left_semi"))
    key = ["id", "digest"]
    covered = hits.groupBy(*key).agg(F.collect_set(F.struct("at", "size")).alias("w")).select(*key, F.expr(
        "CAST(size(array_distinct(flatten(transform(w, x -> sequence(x.at, x.at + x.size - 1))))) AS BIGINT)").alias("n_hit"))
    listed = hits.select(*key, "size", "words").distinct().join(found.where("item IS NOT NULL").select("size", "words", "item").distinct(), ["size", "words"]).groupBy(*key).agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    judged = covered.join(listed, [covered["id"].eqNullSafe(listed["id"]), covered["digest"] == listed["digest"]], "left").select(
        covered["id"].alias("hit_id"), covered["digest"].alias("hit_digest"), "n_hit", "items")
    rows = scanned.select("id", "digest", "n_words")
    joined = rows.join(judged, rows["id"].eqNullSafe(judged["hit_id"]) & (rows["digest"] == judged["hit_digest"]), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("id", "digest", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                         F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                         ((n_hit > 0) & (share[1] * n_hit >= share[0] * F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns and rows of ``docs`` without contaminated documents.

    Rows are told apart by id and lower-cased text: of rows that repeat an id, or have none, those
    with a contaminated text go.
    """
    bad = contamination(docs, items, id_col, text_col, **options).where("contaminated").select(F.col("id").alias("__bad"), F.col("digest").alias("__digest")).distinct()
    own = F.unhex(F.md5(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]) & (own == bad["__digest"]), "left_anti")
