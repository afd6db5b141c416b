"""Mixing sources to target weights: token weights are raked to marginals, documents drawn at the resulting rates.

Only DataFrame functions are used.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import broadcast_if_small, fresh
from settlespark.session import durable

DIMENSIONS = ("source", "lang", "topic")
#: Targets are shares of tokens to these powers: below 1 small categories gain.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.95}
ROUNDS, TOLERANCE = 25, 1e-9
#: Share of the tokens that is drawn at least, and the misfit from which on it is reported.
BUDGET, MISFIT = 0.5, 1e-3


def tokens(text: Column) -> Column:
    """Words of a text, at least 1, so that empty documents weigh something."""
    return F.greatest(F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")), F.lit(1)).cast("long")


def topic(text: Column, words: Column) -> Column:
    """A coarse topic from the form of the text: table, markup, loud, note or prose."""
    text = F.coalesce(text, F.lit(""))

    def often(pattern: str, share: float) -> Column:
        return F.regexp_count(text, F.lit(pattern)) > share * words

    return (F.when(often("\\|", 0.2), "table").when(often("[#*$%&<>]", 0.3), "markup").when(often("[A-Z]{2}", 0.5), "loud")
            .when(words < 50, "note").otherwise("prose"))


def cells(docs: DataFrame, weight: str, dims=DIMENSIONS) -> DataFrame:
    """Token totals of every combination that occurs; a null category is one of its own, the empty text."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims]
    return docs.groupBy(*keys).agg(F.sum(weight).cast("double").alias("tokens"))


def tempered(table: DataFrame, dim: str, power: float) -> DataFrame:
    """``(dim, target)``: shares of tokens to a power, summing to 1."""
    sums = table.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("t"))
    total = sums.agg(F.sum("t")).first()[0] or 1.0
    return sums.select(dim, (F.col("t") / total).alias("target"))


def raked(table: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``table`` with ``weight``, and the misfit that the last round met: token totals scaled in turn to each dimension's target shares, until they fit.

    A round scales by every dimension once and is written to the shared folder; sums are folded
    before the shuffle, so a category with most of the cells costs no more than others. It ends
    when no share is off by more than ``tolerance`` of its target, or after ``rounds``. A
    category without a target gets weight 0.
    """
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    columns = [*table.columns, "weight"]
    for dim, goal in targets.items():  # each cell keeps its targets: a round then joins sums alone
        table = table.join(goal.withColumnRenamed("target", f"target_{dim}"), dim, "left")
    table, off = durable(table.withColumn("weight", F.col("tokens"))), 0.0
    for _ in range(rounds):
        now = table.withColumn("off", F.lit(0.0))
        for dim in targets:
            sums = now.groupBy(dim).agg(F.sum("weight").alias("s"))
            f = F.coalesce(F.try_divide(F.col(f"target_{dim}") * total, F.col("s")), F.lit(0.0))
            now = now.join(sums, dim).withColumns({"weight": F.col("weight") * f, "off": F.greatest("off", F.abs(f - 1))}).drop("s")
        done = durable(now)
        off = done.agg(F.max("off")).first()[0] or 0.0
        table = done.drop("off")
        if off <= tolerance:
            break
    return table.select(*columns), off


def rates(table: DataFrame) -> DataFrame:
    """``rate`` of each cell: its raked weight over its tokens, the largest scaled to 1."""
    ratio = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(0.0))
    most = table.agg(F.max(ratio)).first()[0] or 1.0
    return table.withColumn("rate", ratio / most)


def attainable(table: DataFrame, dim: str, target: DataFrame, drawn: float) -> DataFrame:
    """``(dim, goal)``: ``drawn`` tokens by target shares. A category with fewer gives all it has, the others share the rest."""
    sums = durable(table.groupBy(dim).agg(F.sum("tokens").alias("cap")).join(target, dim))
    level, before = drawn, 0
    while True:
        spent = F.col("target") * level >= F.col("cap")
        got = sums.agg(F.count_if(spent).alias("n"), F.sum(F.when(spent, F.col("cap"))).alias("cap"), F.sum(F.when(~spent, F.col("target"))).alias("rest")).first()
        if got.n == before or not got.rest:
            return sums.select(dim, F.least("cap", F.col("target") * level).alias("goal"))
        before, level = got.n, (drawn - got.cap) / got.rest


def filled(table: DataFrame, goals: dict[str, DataFrame], rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``table`` with ``rate`` of at most 1, and the misfit that the last round met: drawn tokens raked to each dimension's goals.

    A category that lacks tokens raises its cells that are not yet drawn whole; one that has too
    many lowers all of its cells.
    """
    columns = [*table.columns, "rate"]
    for dim, goal in goals.items():
        table = table.join(goal.withColumnRenamed("goal", f"goal_{dim}"), dim)
    table, off = durable(table.withColumn("rate", F.lit(rate))), 0.0
    for _ in range(rounds):
        now = table.withColumn("off", F.lit(0.0))
        for dim in goals:
            part, goal = F.col("tokens") * F.col("rate"), F.col(f"goal_{dim}")
            sums = now.groupBy(dim).agg(F.sum(part).alias("s"), F.sum(F.when(F.col("rate") < 1, part).otherwise(0.0)).alias("u"))
            up = F.when((F.col("u") > 0) & (F.col("rate") < 1), (goal - F.col("s") + F.col("u")) / F.col("u")).otherwise(1.0)
            f = F.when(goal > F.col("s"), up).otherwise(goal / F.col("s"))
            now = now.join(sums, dim).withColumns({"rate": F.least(F.col("rate") * f, F.lit(1.0)), "off": F.greatest("off", F.abs(F.col("s") / goal - 1))}).drop("s", "u")
        done = durable(now)
        off = done.agg(F.max("off")).first()[0] or 0.0
        table = done.drop("off")
        if off <= tolerance:
            break
    return table.select(*columns), off


def fitted(table: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET) -> DataFrame:
    """``rate`` of each cell. Where exact shares would draw less than ``budget`` of the tokens, scarce categories fall short of theirs.

    Targets that contradict each other are reported by a warning with the largest misfit left.
    """
    weights, off = raked(table, targets)
    out = rates(weights)
    facts = out.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("drawn")).first()
    if facts.tokens and facts.drawn < budget * facts.tokens:
        out, off = filled(table, {d: attainable(table, d, t, budget * facts.tokens) for d, t in targets.items()}, budget)
    if off > MISFIT:
        warnings.warn(f"mixing: after {ROUNDS} rounds a category is off its goal by {off:.2%} of it", stacklevel=2)
    return out


def draw(id_col: Column, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) from the hash of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          powers: dict[str, float] | None = None, seed: int = 97, budget: float = BUDGET) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, rate, selected)``, one row per document.

    Rows drawn at these rates have, in expectation, the target shares of tokens by source,
    language and topic; nothing is drawn twice. If that would leave less than ``budget`` of the
    tokens, so much is drawn, and categories too scarce for their share are drawn whole. The draw is a hash of seed and id, the same in
    every run; rows that repeat an id share it. Null categories count as one category, null and
    empty texts as one token. An empty table gives no rows.
    """
    powers = powers or POWERS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), tokens(F.col(text_col)).alias("tokens"), F.col(text_col).alias("text"))
    rows = durable(rows.withColumn("topic", topic(F.col("text"), F.col("tokens"))).drop("text"))
    table = durable(cells(rows, "tokens"))
    rate = fitted(table, {d: tempered(table, d, powers[d]) for d in DIMENSIONS}, budget).select(*DIMENSIONS, "rate")
    joined = rows.join(broadcast_if_small(rate, table.count()), list(DIMENSIONS))
    return joined.select("doc_id", *DIMENSIONS, "tokens", "rate", (draw(F.col("doc_id"), seed) < F.col("rate")).alias("selected"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
            powers: dict[str, float] | None = None, seed: int = 97, budget: float = BUDGET) -> DataFrame:
    """The columns of ``docs``, rows drawn as ``mixed`` draws them, each by the rate of its own cell."""
    powers = powers or POWERS
    names = {d: fresh(docs.columns, f"cell_{d}") for d in DIMENSIONS}
    count = fresh(docs.columns, "token_count")
    cell = {names["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit("")), names["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(""))}
    rows = docs.withColumns(cell | {count: tokens(F.col(text_col))})
    rows = rows.withColumn(names["topic"], topic(F.col(text_col), F.col(count)))
    facts = durable(rows.select(*[F.col(n).alias(d) for d, n in names.items()], F.col(count).alias("tokens")))
    table = durable(cells(facts, "tokens"))
    rate = fitted(table, {d: tempered(table, d, powers[d]) for d in DIMENSIONS}, budget)
    share = fresh(docs.columns, "draw_rate")
    rate = rate.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("rate").alias(share))
    on = None
    for d, n in names.items():
        same = rows[n] == rate[f"__{d}"]
        on = same if on is None else on & same
    drawn = rows.join(broadcast_if_small(rate, table.count()), on)
    return drawn.where(draw(F.col(id_col), seed) < F.col(share)).select(*[docs[c] for c in docs.columns])
