"""Near-duplicates by SimHash: popcounts of fingerprint segments bound the Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from settlespark.llm.common import column_texts, fresh
from settlespark.llm.components import components
from settlespark.session import durable

SEED, STEP = 42, 1 << 16
EVEN = 0x5555555555555555  # the low bit of every two-bit segment


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text.

    A-Z is lower-cased, ASCII white space splits words, shingles count as often as they
    occur; fewer words give one shingle of them all, none gives zero. Long texts are hashed
    in steps, so memory does not grow with them beyond the words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for low in range(0, total, STEP):
        part = words[low:low + STEP + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def text_digest(text: Column) -> Column:
    """What tells rows of one id apart: the MD5 of the text, a null one counting as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(id, fp)`` for every row, with ``digests`` also ``digest``; other columns are not read."""
    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in column_texts(batch.column(1))], pa.int64())
            rest = [batch.column(2)] if digests else []
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *rest], names=["id", "fp", "digest"][:2 + digests])

    kind = docs.schema[id_col].dataType.simpleString()
    extra = [text_digest(F.col(text_col)).alias("digest")] if digests else []
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra).mapInArrow(run, f"id {kind}, fp bigint{', digest binary' if digests else ''}")


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each 0 to 2, packed in the places of the segments."""
    high, even = F.shiftrightunsigned(fp, 1), F.lit(EVEN)
    both, one = fp.bitwiseAND(high).bitwiseAND(even), fp.bitwiseXOR(high).bitwiseAND(even)
    return F.shiftleft(both, 1).bitwiseOR(one)


def _masks(parts: int) -> list[tuple[int, list[int]]]:
    """For each part of the segments: the mask of its bits, and the first bits of its segments."""
    cuts = [32 * i // parts for i in range(parts + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        mask = ((1 << 2 * (high - low)) - 1) << 2 * low
        out.append((mask - (1 << 64) if mask >> 63 else mask, list(range(2 * low, 2 * high, 2))))
    return out


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints, ``fp``, at most ``distance`` bits apart.

    The Manhattan distance of the segment popcounts never exceeds the Hamming distance. With
    the segments in ``distance // 2 + 1`` parts, some part is at most 1 apart there. A
    fingerprint is stored in its own grid cell of each part and looked up in that cell and in
    the cells one step up in one segment; of two neighbouring cells one is the upper, so no
    pair is missed and few are met twice. The exact bit count decides within the join.
    """
    parts = _masks(distance // 2 + 1)
    e = embedding(F.col("fp"))

    def bit(n: int) -> int:
        return 1 << n if n < 63 else -(1 << 63)

    own, looks = [], []
    for k, (mask, places) in enumerate(parts):
        cell = F.col("e").bitwiseAND(F.lit(mask))
        own.append(F.struct(F.lit(k).alias("part"), cell.alias("cell")))
        looks.append(F.struct(F.lit(k).alias("part"), cell.alias("cell"), F.lit(True).alias("same")))
        for p in places:
            low, high = F.lit(bit(p)), F.lit(bit(p + 1))
            # one more bit in the segment: 0 becomes 1, 1 becomes 2; there is nothing above 2
            up = F.when(F.col("e").bitwiseAND(low) != 0, cell.bitwiseXOR(low).bitwiseXOR(high)).when(
                F.col("e").bitwiseAND(high) == 0, cell.bitwiseXOR(low))
            looks.append(F.struct(F.lit(k).alias("part"), up.alias("cell"), F.lit(False).alias("same")))
    base = fps.select("fp", e.alias("e"))
    stored = base.select(F.col("fp").alias("x"), F.explode(F.array(*own)).alias("c")).select("x", "c.*")
    probes = base.select(F.col("fp").alias("y"), F.explode(F.array(*looks)).alias("c")).select("y", "c.*").where("cell IS NOT NULL")
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance) & (~F.col("same") | (F.col("x") < F.col("y")))
    met = stored.withColumnRenamed("cell", "cell_x").withColumnRenamed("part", "part_x").join(
        probes, (F.col("part_x") == F.col("part")) & (F.col("cell_x") == F.col("cell")) & near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``(id, fp, component_id)``, one row per document.

    Equal fingerprints are folded to one before the join, so copies never meet in pairs.
    ``component_id`` is the least id that links reach. A null text counts as empty; texts
    without words share fingerprint zero. A null id belongs to its component but never names
    it: where no member has an id, ``component_id`` is null. An empty table gives no rows.
    """
    marked = durable(fingerprints(docs, id_col, text_col))
    labels = _labels(marked, distance)
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    return marked.join(labels.join(least, "label").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def _labels(marked: DataFrame, distance: int) -> DataFrame:
    """``(fp, first, label)``: each fingerprint with its least id and the fingerprint that names its component."""
    fps = durable(marked.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(fps, distance))
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """The columns of ``docs``, one row of each near-duplicate component: that with the least id, of those the one with the least text digest.

    Rows are told apart by id and text, so rows that repeat an id are judged each by their own
    text, and rows without an id, which come last, are judged too. Of rows that repeat both, any one stays.
    """
    marked = durable(fingerprints(docs, id_col, text_col, digests=True))
    labels = _labels(marked, distance).select("fp", "label")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    # Rows of a fingerprint are folded before they meet their component.
    chosen = marked.groupBy("fp").agg(F.min(order).alias("o")).join(labels, "fp").groupBy("label").agg(F.min("o").alias("o")).select("o.*")
    name = fresh(docs.columns, "text_digest")
    rows = docs.withColumn(name, text_digest(F.col(text_col)))
    kept = rows.join(chosen, rows[id_col].eqNullSafe(chosen["__id"]) & (rows[name] == chosen["__digest"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
