"""A reproducible shuffle: a Feistel permutation of global row numbers gives shard and slot.

Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlespark.session import durable

PRIME = (1 << 31) - 1
ROUNDS, WALK = 6, 64


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. size - 1 that depends on the size and the seed alone.

    A number is split as ``r * a + l`` on a grid of about sqrt(size) times sqrt(size) places.
    Rounds add a function of one half to the other, modulo its range, which can be undone. The
    grid has fewer than ``a`` places beyond the size; a number that lands there walks on.
    """

    size: int
    seed: int = 0

    @property
    def a(self) -> int:
        return max(1, isqrt(max(0, self.size - 1)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.size // self.a))

    def keys(self) -> list[tuple[int, int, int]]:
        """Factor and two summands of each round."""
        digests = [hashlib.sha256(f"{self.seed}:{r}".encode()).digest() for r in range(ROUNDS)]
        return [tuple(int.from_bytes(d[8 * i:8 * i + 8], "big") % (PRIME - 1) + 1 for i in range(3)) for d in digests]

    def _once(self, x: str, back: bool) -> str:
        keys = list(enumerate(self.keys()))[::-1 if back else 1]
        rounds = ", ".join(f"named_struct('odd', {str(r % 2 == 1).lower()}, 'm', {m}L, 'c', {c}L, 'd', {d}L)" for r, (m, c, d) in keys)

        def moved(half: str, other: str, base: int) -> str:
            mixed = f"aggregate(array(k.c, k.d), s.{other} * k.m % {PRIME}L, (f, e) -> (f * f + e) % {PRIME}L)"
            return f"(s.{half} - {mixed} % {base}L + {base}L) % {base}L" if back else f"(s.{half} + {mixed}) % {base}L"

        return (f"aggregate(array({rounds}), named_struct('l', {x} % {self.a}L, 'r', {x} div {self.a}L), (s, k) -> if(k.odd, "
                f"named_struct('l', s.l, 'r', {moved('r', 'l', self.b)}), named_struct('l', {moved('l', 'r', self.a)}, 'r', s.r)), "
                f"s -> s.r * {self.a}L + s.l)")

    def _walked(self, df: DataFrame, number: str, out: str, back: bool) -> DataFrame:
        step = f"{out}__step"
        walk = f"aggregate(sequence(1, {WALK}), {step}, (x, i) -> if(x < {self.size}L, x, {self._once('x', back)}))"
        done = F.expr(f"if({step} < {self.size}L, {step}, {walk})")
        df = df.withColumn(step, F.expr(self._once(number, back))).withColumn(out, done).drop(step)
        lost = F.raise_error(F.lit(f"a walk left the grid {WALK} times and more; choose another seed")).cast("bigint")
        return df.withColumn(out, F.when(F.col(out) < self.size, F.col(out)).otherwise(lost))

    def place(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """Adds ``out``, the place of the row numbered ``number``."""
        return self._walked(df, number, out, False)

    def number(self, df: DataFrame, place: str, out: str) -> DataFrame:
        """Adds ``out``, the number of the row at ``place``."""
        return self._walked(df, place, out, True)


def numbered(df: DataFrame, order_by: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` in the shared folder with gapless global numbers from 0, and the number of rows.

    Rows are dealt by ranges of ``order_by``, counted by partition and offset by the counts
    before. A salt breaks ties, so a third of all rows under one key still spreads; rows equal
    in ``order_by`` may trade numbers. No task sees more than its range.
    """
    salt, pid, at = "__salt", "__pid", "__at"
    order = [*order_by, salt]
    ranged = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(ranged.drop(salt).withColumn(pid, F.spark_partition_id()).withColumn(
        at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy(pid).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row for each partition
    total = counts.agg(F.sum("__n")).first()[0] or 0
    return rows.join(F.broadcast(offsets), pid).withColumn(out, F.col("__before") + F.col(at)).drop(pid, at, "__before"), total


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 8, seed: int = 20240229) -> DataFrame:
    """``(doc_id, size, text_crc32, row_number, shard, slot)``, one row per document.

    Rows are numbered by id, checksum and size, permuted, and dealt in turn: counts of shards
    differ by one at most and slots have no gaps. The same rows give the same shards, however
    they are partitioned. A null text has size 1 and checksum 0, null ids come first, repeated
    rows get a place each, and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = Permutation(total, seed).place(rows, "row_number", "place")
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % count).cast("int").alias("shard"),
                         F.expr(f"place div {count}").alias("slot"))
