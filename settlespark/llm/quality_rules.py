"""Quality rules whose cutoffs carry a guarantee: few good texts are rejected, with stated confidence.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlespark.llm.common import broadcast_if_small, fresh
from settlespark.session import durable

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
GRAM = 5
#: Value of each rule, worse the higher, and its cutoffs, fixed before any label is seen.
RULES = {
    "symbols": ("n_symbols / n_words", [i / 20 for i in range(1, 21)]),
    "capitals": ("n_capitals / word_chars", [i / 20 for i in range(2, 20)]),
    "stutter": ("n_stutter / n_words", [i / 20 for i in range(1, 20)]),
    "repeats": ("n_repeat_words / n_words", [i / 20 for i in range(1, 20)]),
    "duplicate_lines": ("n_dup_lines / n_lines", [i / 20 for i in range(4, 20)]),
    "word_length": ("word_chars / n_words", [i / 2 for i in range(12, 60)]),
}


def measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_stutter)``.

    Each text is measured within its row: nothing is shuffled. Windows of words are compared by
    64-bit hashes, sorted only where some hash occurs twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    rows = rows.select(
        "id", "stratum", F.array_remove(F.split("text", SPACE), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    rows = rows.select(
        "id", "stratum", "n_symbols", "n_capitals", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    following = ", ".join(f"h[i + {k}]" for k in range(1, GRAM))
    rows = rows.select("*", F.expr(f"if(n_words < {GRAM}, array(), transform(slice(h, 1, size(h) - {GRAM - 1}), (x, i) -> xxhash64(x, {following})))").alias("g"),
                       F.expr("CAST(size(filter(h, (x, i) -> i > 0 AND x = get(h, i - 1))) AS BIGINT)").alias("n_stutter")).drop("h")
    rows = rows.withColumn("s", F.expr("if(size(array_distinct(g)) = size(g), NULL, array_sort(transform(g, (x, i) -> named_struct('x', x, 'i', i))))")).drop("g")
    rows = rows.withColumn("p", F.expr("array_sort(transform(filter(s, (e, i) -> e.x = get(s, i - 1).x OR e.x = get(s, i + 1).x), e -> e.i))")).drop("s")
    covered = F.expr(f"coalesce(aggregate(transform(p, (x, i) -> least({GRAM}, coalesce(get(p, i + 1) - x, {GRAM}))), 0L, (a, x) -> a + x), 0L)")
    return rows.withColumn("n_repeat_words", covered).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> Column:
    """The rules' values as an array of ``(rule, value, level)``; level counts the cutoffs below the value."""
    parts = []
    for name, (value, cutoffs) in RULES.items():
        a, b = value.split(" / ")
        parts.append(f"named_struct('rule', '{name}', 'value', coalesce(try_divide({a}, {b}), 0D), 'grid', array({', '.join(f'{c}D' for c in cutoffs)}))")
    return F.expr(f"transform(array({', '.join(parts)}), r -> named_struct('rule', r.rule, 'value', r.value, 'level', size(filter(r.grid, c -> r.value > c))))")


def largest_safe(n: str, risk: float, level: str) -> Column:
    """The most rejections of ``n`` good texts for which the exact binomial test at ``level`` still says that the risk is below ``risk``.

    That is the largest k with P(X <= k) <= level for X of n trials at ``risk``, or -1; the sum
    runs in logarithms over at most risk * n terms, once for each stratum.
    """
    odds = f"ln({risk}D / (1 - {risk}D))"
    return F.expr(f"""aggregate(sequence(0, CAST(ceil({risk}D * {n}) AS INT)), named_struct('lp', {n} * ln(1 - {risk}D), 'lc', -1e300D, 'k', -1),
      (s, i) -> named_struct('lp', s.lp + if(i < {n}, ln(({n} - i) / (i + 1D)) + {odds}, -1e300D),
        'lc', greatest(s.lc, s.lp) + ln(exp(least(s.lc, s.lp) - greatest(s.lc, s.lp)) + 1),
        'k', if(greatest(s.lc, s.lp) + ln(exp(least(s.lc, s.lp) - greatest(s.lc, s.lp)) + 1) <= ln({level}), i, s.k)), s -> s.k)""")


def cutoffs(rows: DataFrame, max_false: float = 0.05, error: float = 0.05) -> DataFrame:
    """``(stratum, rule, level, n_good, good_rejected, bad_rejected)``: the cutoff of each rule, where one is certified.

    ``rows`` are labelled holdouts ``(stratum, rules, quality)``, labels 1 for good. With
    confidence ``1 - error`` no stratum loses more than ``max_false`` of its good texts: rules
    share ``max_false`` equally, ``error`` is shared by all pairs of rule and stratum
    (Bonferroni), and the cutoffs of a rule are tested from the loosest on until one fails,
    which costs nothing further. Of the certified ones, that with the most bad less good
    rejections counts, the looser of equals; it must reject more bad texts than good.
    """
    share = max_false / len(RULES)
    counts = rows.select("stratum", "quality", F.explode("rules").alias("r")).groupBy("stratum", "r.rule", "r.level").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    # one row for each stratum, rule and level: no more than the grid in a window
    beyond = Window.partitionBy("stratum", "rule").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("stratum", "rule")
    curve = counts.select("stratum", "rule", "level", F.sum("good").over(beyond).alias("good_rejected"), F.sum("bad").over(beyond).alias("bad_rejected"),
                          F.sum("good").over(every).alias("n_good"))
    strata = curve.select("stratum", "n_good").distinct()
    tests = strata.agg(F.count(F.lit(1)).alias("m")).first().m * len(RULES)
    safe = strata.select("stratum", largest_safe("n_good", share, f"({error}D / {max(1, tests)})").alias("most"))
    ok = curve.join(safe, "stratum").where((F.col("level") > 0) & (F.col("good_rejected") <= F.col("most")) & (F.col("bad_rejected") > F.col("good_rejected")))
    best = ok.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad_rejected") - F.col("good_rejected")).alias("net"), "level", "n_good", "good_rejected", "bad_rejected")).alias("b"))
    return best.select("stratum", "rule", "b.level", "b.n_good", "b.good_rejected", "b.bad_rejected")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
           max_false: float = 0.05, error: float = 0.05) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules)``, one row per document.

    A text that passes the base rules is rejected if it lies beyond the certified cutoff of a
    rule in its stratum; where labels are too few to certify any, all are kept. Labelled
    texts that pass the base rules are the holdout; of repeated labels the least counts. Null
    and empty texts have no words and fail the base rules; a null stratum is one of its own.
    """
    rows = durable(measured(docs, id_col, text_col, stratum_col).withColumn("base_failed", base_failed()).withColumn("rules", rule_values()))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality IS NOT NULL")
    holdout = rows.where("NOT base_failed").select("id", "stratum", "rules").join(marks, "id")
    chosen = durable(cutoffs(holdout, max_false, error))
    limits = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("limits"))  # an entry for each rule at most
    judged = rows.join(broadcast_if_small(limits, chosen.count()), "stratum", "left")
    failed = F.expr("transform(filter(rules, r -> r.level >= coalesce(limits[r.rule], 2147483647)), r -> r.rule)")
    out = judged.withColumn("failed_rules", F.array_join(F.array_sort(F.coalesce(failed, F.array().cast("array<string>"))), ","))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The columns and rows of ``docs`` whose id is not that of a rejected text; rows without an id stay."""
    bad = fresh(docs.columns, "rejected_id")
    rejected = judged(docs, labels, id_col, **options).where("NOT kept").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(rejected, docs[id_col] == rejected[bad], "left_anti")
