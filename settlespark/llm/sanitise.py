"""Personal data, and the words that give it away.

Patterns find personal data. What the corpus says about the words of the same texts decides which
of them reveal it: the probability of the datum, or of what it shares with others, given the word;
its negative logarithm is the uncertainty that is left to who reads the word. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import broadcast_if_small
from settlespark.session import durable

#: Patterns by kind, with what a text must hold for the pattern to be tried. Lookbehinds and
#: possessive repeats only spare the matcher places where no match can start.
LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": (f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]"),
    "card": ("(?<![0-9])[0-9](?:[\\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]"),
}
DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
#: What a datum shares with others: the mail domain, the network, the card's issuer, the number without its last four digits.
WIDER = {"email": "concat('domain:', lower(substring_index(x.v, '@', -1)))", "ip": "concat('net:', substring_index(x.v, '.', 3))",
         "card": f"concat('issuer:', left({DIGITS}, 6))", "phone": f"concat('area:', left({DIGITS}, length({DIGITS}) - 4))"}
#: Square of the normal quantile behind the lower bound of a share.
Z2 = 1.96 ** 2
TERM = "\\p{L}{3,}+"
SPAN = "array<struct<s:int,e:int,v:string>>"
BLOCK = 256


def matches(text: str, pattern: str, guard: str) -> Column:
    """Leftmost non-overlapping matches of a text column as ``(s, e, v)``, in code points, e exclusive.

    Splitting at the matches gives what lies between them; lengths are summed in blocks of
    matches and then over the blocks, so a text with very many stays far from quadratic work.
    """
    found, parts = f"regexp_extract_all({text}, r'{pattern}', 0)", f"split({text}, r'{pattern}', -1)"
    zipped = f"arrays_zip(transform({parts}, x -> char_length(x)), {found})"
    none = f"CAST(array() AS {SPAN})"
    inner = (f"aggregate(slice(z, c * {BLOCK} + 1, {BLOCK}), named_struct('n', 0, 'o', {none}), (a, x) -> named_struct('n', a.n + x['0'] + char_length(x['1']), "
             f"'o', array_append(a.o, named_struct('s', a.n + x['0'], 'e', a.n + x['0'] + char_length(x['1']), 'v', x['1']))))")
    blocks = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), c -> {inner})"
    outer = (f"flatten(aggregate({blocks}, named_struct('n', 0, 'o', CAST(array() AS array<{SPAN}>)), (a, b) -> named_struct('n', a.n + b.n, 'o', array_append(a.o, "
             f"transform(b.o, y -> named_struct('s', y.s + a.n, 'e', y.e + a.n, 'v', y.v)))), a -> a.o))")
    named = f"transform(slice({zipped}, 1, size({found})), x -> named_struct('0', x.`0`, '1', x.`1`))"
    # the array of gaps and matches is bound once, as the element of an array of one
    return F.expr(f"if({text} RLIKE r'{guard}', coalesce(transform(array({named}), z -> if(size(z) = 0, {none}, {outer}))[0], {none}), {none})")


def _valid(kind: str, spans: str) -> Column:
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    if kind == "ip":
        return F.expr(f"filter({spans}, x -> NOT exists(split(x.v, '[.]'), p -> NOT p RLIKE '^0*(?:[0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$'))")
    if kind == "phone":
        return F.expr(f"filter({spans}, x -> length({digits}) BETWEEN 9 AND 15)")
    if kind == "card":
        luhn = (f"aggregate(transform(array_remove(split(reverse({digits}), ''), ''), (d, i) -> if(i % 2 = 0, CAST(d AS INT), CAST(substr('0246813579', CAST(d AS INT) + 1, 1) AS INT))), "
                f"0, (a, d) -> a + d) % 10 = 0")
        return F.expr(f"filter({spans}, x -> length({digits}) BETWEEN 13 AND 19 AND {luhn})")
    return F.expr(spans)


def detected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, text, email, ip, card, phone)``; ``row`` tells rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *[matches("text", pattern, guard).alias(f"{kind}_all") for kind, (pattern, guard) in KINDS.items()])
    return rows.select("doc_id", "text", "email_all", *[_valid(kind, f"{kind}_all").alias(kind) for kind in KINDS])


def with_terms(rows: DataFrame) -> DataFrame:
    """Adds, for texts with personal data, their entities and the places of their words.

    ``own`` lists each datum with its kind, ``wider`` what it shares with others (``WIDER``), once each;
    ``places`` has ``(t, s, e)`` of every word of three letters or more outside mail addresses, the
    only data with letters, which are blanked out before words are looked for.
    """
    own = {k: f"concat('{k}:', {'lower(x.v)' if k in ('email', 'ip') else _digits()})" for k in KINDS}
    for name, of in (("own", own), ("wider", WIDER)):
        rows = rows.withColumn(name, F.expr("array_distinct(concat(" + ", ".join(f"transform({k}, x -> {of[k]})" for k in KINDS) + "))"))
    pattern = KINDS["email"][0]
    blanks = f"transform(regexp_extract_all(text, r'{pattern}', 0), x -> repeat(' ', char_length(x)))"
    blanked = f"array_join(transform(arrays_zip(split(text, r'{pattern}', -1), {blanks}), x -> concat(x.`0`, coalesce(x.`1`, ''))), '')"
    rows = rows.withColumn("blank", F.expr(f"if(size(own) = 0, '', if(size(email_all) = 0, text, {blanked}))"))
    rows = rows.withColumn("found", matches("blank", TERM, "\\p{L}"))
    return rows.withColumn("places", F.expr("transform(found, x -> named_struct('t', lower(x.v), 's', x.s, 'e', x.e))")).drop("blank", "found")


def _digits() -> str:
    return DIGITS


def at_least(hits: Column, n: Column) -> Column:
    """Wilson's lower bound of a share seen as ``hits`` of ``n``."""
    p = hits / n
    return (p + Z2 / 2 / n - F.sqrt(F.lit(Z2) * (p * (1 - p) + Z2 / 4 / n) / n)) / (1 + Z2 / n)


def disclosures(rows: DataFrame, docs: DataFrame, text_col: str, generalise_at: float) -> DataFrame:
    """``(c, t, ratio)`` of the words that disclose an entity: a datum, or what it shares with others.

    ``ratio`` is the lower bound of the probability that a text with the word concerns the entity.
    A text that holds k entities of a family concerns each with 1/k; n texts with the word give the
    mean of that and, by Wilson's bound, what it is at least. The bound asks for the same evidence
    at every size of the corpus. Counts run over whole distinct texts.

    A word that too few of its texts share with any personal data cannot reach the threshold, which
    leaves out the common ones before they meet entities. And a word can only reach it with an
    entity if some text with both holds at most 1/threshold entities, so pairs come from such
    texts, and texts with more add to pairs that are known: no text gives the product of its
    entities and words.
    """
    least = int(1 / generalise_at + 1e-9)
    once = durable(rows.where(F.size("own") > 0).groupBy("h").agg(
        F.first("own").alias("own"), F.first("wider").alias("wider"), F.first(F.array_distinct(F.transform("places", lambda p: p["t"]))).alias("words")))
    families = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("cs")) for f in ("own", "wider")])
    entities = once.select("h", F.explode(families).alias("x")).select("h", "x.*").withColumn("w", 1 / F.size("cs").cast("double"))
    terms = once.select("h", F.explode("words").alias("t"))
    # Copies of a text share the weight of one; those without copies are not looked up.
    copies = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).join(broadcast_if_small(copies, copies.count()), "h", "left")
    spoken = every.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("t"), (1 / F.coalesce("copies", F.lit(1)).cast("double")).alias("w"))
    # Counted first: common words meet the others as one row each, not once a document.
    counts = spoken.groupBy("t").agg(F.round(F.sum("w")).alias("n")).join(terms.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("n_d")), "t")
    # lower-casing and splitting may part a word otherwise than its place: the count is then the smaller
    counts = counts.select("t", F.greatest("n", "n_d").alias("n_t"), "n_d")
    viable = durable(counts.where(at_least(F.col("n_d"), F.col("n_t")) >= generalise_at).select("t", "n_t"))
    kept = durable(terms.join(broadcast_if_small(viable, viable.count()), "t").select("h", "t"))
    light, heavy = entities.where(F.size("cs") <= least), entities.where(F.size("cs") > least)
    pairs = durable(light.select("h", F.explode("cs").alias("c"), "w").join(kept, "h").groupBy("c", "t").agg(F.sum("w").alias("hits")))
    more = pairs.select("c", "t").join(heavy.select("h", F.explode("cs").alias("c"), "w"), "c").join(kept, ["h", "t"]).groupBy("c", "t").agg(F.sum("w").alias("hits"))
    both = pairs.unionByName(more).groupBy("c", "t").agg(F.sum("hits").alias("hits")).join(viable, "t")
    return both.select("c", "t", at_least(F.least("hits", "n_t"), F.col("n_t")).alias("ratio")).where(F.col("ratio") >= generalise_at)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.2, remove_at: float = 0.5) -> DataFrame:
    """``(row, h, doc_id, email, ip, card, phone, terms)``, one row per document.

    Personal data by kind as arrays of ``(s, e, v)``, and ``terms`` as ``(s, e, action)``: every
    occurrence, in a text with personal data, of a word that discloses one of its entities, to be
    generalised, or removed from ``remove_at`` on. A word seen once, with a datum alone, has a bound of
    0.207; four of four texts give 0.51. Null and empty texts have none; repeated rows are judged
    alike, and equal texts count once. ``h`` is a hash of the text.
    """
    rows = durable(with_terms(detected(docs, id_col, text_col)).withColumn("h", F.xxhash64("text")).drop("text", "email_all").withColumn("row", F.monotonically_increasing_id()))
    known = durable(disclosures(rows, docs, text_col, generalise_at))
    concerned = rows.where(F.size("own") > 0)
    # A word discloses few entities, as their probabilities add up; so words meet entities before texts do.
    words = concerned.select("row", F.explode(F.array_distinct(F.transform("places", lambda p: p["t"]))).alias("t")).join(broadcast_if_small(known, known.count(), 50_000), "t")
    entities = concerned.select("row", F.explode(F.concat("own", "wider")).alias("c"))
    told = words.join(entities, ["row", "c"]).groupBy("row", "t").agg(F.max("ratio").alias("ratio"))
    hits = concerned.select("row", F.explode("places").alias("p")).select("row", "p.*").join(told, ["row", "t"])
    action = F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise")
    terms = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", action.alias("action")))).alias("terms"))
    out = rows.select("row", "h", "doc_id", *KINDS).join(terms, "row", "left")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,action:string>>")))


def listed(kinds) -> Column:
    """Spans as ``kind:start:end``, by kind as given, then start, joined by commas."""
    def texts(kind: str) -> Column:
        name = F.lit("term" if kind == "terms" else kind)
        return F.transform(kind, lambda x: F.concat_ws(":", name, x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*map(texts, kinds)), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms)``, one row per document."""
    rows = found(docs, **options)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(KINDS), 256).alias("base_sha256"),
                       listed([*KINDS, "terms"]).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, text)``: personal data replaced by its kind in brackets, words generalised to ``[word]`` or removed.

    Of overlapping spans the first, and of those the longest, gives the replacement, which stands for
    all they cover together. Rows are told apart by id and text, so rows that repeat an id, or have
    none, keep their own spans; other columns are not returned.
    """
    rows = found(docs, id_col, text_col, **options)

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(f"[{kind}]").alias("r")))

    marks = F.concat(*map(marked, KINDS), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.when(x["action"] == "remove", "").otherwise("[word]").alias("r"))))
    spans = rows.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.array_sort(marks).alias("m")).where("size(m) > 0").dropDuplicates(["__id", "__h"])
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = base.join(spans, base["doc_id"].eqNullSafe(spans["__id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == spans["__h"]), "left")
    step = ("if(x.s < a.n, named_struct('n', greatest(a.n, -x.e), 'o', a.o), named_struct('n', -x.e, 'o', array_append(a.o, concat(substr(text, a.n + 1, x.s - a.n), x.r))))")
    pieces = F.expr(f"aggregate(m, named_struct('n', 0, 'o', CAST(array() AS array<string>)), (a, x) -> {step}, a -> concat(array_join(a.o, ''), substr(text, a.n + 1)))")
    return joined.select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(pieces).alias("text"))
