"""Corpus operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import warnings

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from settlespark.llm import content, decontaminate, mixing, nbsvm, quality_rules, sanitise, sharding, simhash, toxicity, warc
from settlespark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, id string, row_rank int"
ALPHA = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def rows_of(texts, start=1, lang="en", source="s"):
    return [(start + i, t, lang, source, 0, "x", "y", "z", 9) for i, t in enumerate(texts)]


ODD = [(None, None, None, None, None, None, None, None, None), (None, "loose text without id", None, "s", 1, "x", "y", "z", 0),
       (900, None, "en", None, 0, "x", "y", "z", 1), (901, "", "en", "s", 0, "x", "y", "z", 1), (902, " \n\t ", "en", "s", 0, "x", "y", "z", 1),
       (903, LONG, "en", "s", 0, "x", "y", "z", 1), (904, "same row", "en", "s", 0, "x", "y", "z", 1), (904, "same row", "en", "s", 0, "x", "y", "z", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- near-duplicates --------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One two", "A b c", "Ünïcode Ä b c d", " ".join(ALPHA * 3), "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_is_hashed_in_steps(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "STEP", 1000)
    assert simhash.fingerprint(LONG) == whole


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_lose_no_pair(spark, distance):
    import random
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base * 6:
        for _ in range(rng.randint(1, 6)):
            b ^= 1 << rng.randrange(64)
        fps.add(b)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).distinct().collect()
    assert {(r.a, r.b) for r in got} == want


def test_components_of_chains_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_kept(spark, odd, empty):
    near = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame(rows_of([near, near, near + " extra", "quite other words stand here now"], 10), SCHEMA).unionByName(odd)
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).where("id IS NOT NULL").collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect() if r.doc_id is not None}
    for a in fps:
        reach = {a}
        while True:
            more = {b for b in fps for c in reach if bin((fps[b] ^ fps[c]) & (1 << 64) - 1).count("1") <= 3} | reach
            if more == reach:
                break
            reach = more
        assert got[a] == min(reach)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    # The row without id and text is a copy of 900; the other one without id has a text of its own.
    assert ids[904] == 1 and ids[None] == 1 and ids[10] == 1 and ids[11] == 0 and ids[900] == 1
    same = spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z", 1) for d, t in ((None, near), (None, near), (6, near), (5, near), (7, "first text of a repeated id"), (7, near), (None, "stands alone"))], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(same).collect()), key=str) == sorted([(5, near), (7, "first text of a repeated id"), (None, "stands alone")], key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# --- benchmark decontamination ----------------------------------------------------------------


def slow_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(low))
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[i:i + min(13, len(w))])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = word.findall((text or "").translate(low)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark, odd, empty):
    item = " ".join(ALPHA)
    items = [(1, item), (2, "Short item"), (3, None), (4, ""), (5, item), (None, "nameless one"), (6, "x " * 40)]
    texts = ["before " + item.upper() + " after", "a short, ITEM b", "nameless one", " ".join(ALPHA[:13]), " ".join(ALPHA[:12]), LONG + " " + item, "x " * 14, "x " * 12,
             " ".join(ALPHA[3:] + ALPHA), "shorté item"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    rows = sorted([(r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()], key=str)
    assert rows == slow_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("n_hit > 0").count() == 0
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows if not r[5])
    twice = spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z", 1) for d, t in ((None, item), (None, item.upper()), (8, item), (8, "clean text of the same id"), (None, None))], SCHEMA)
    assert sorted(str((r.doc_id, r.text)) for r in decontaminate.clean(twice, bench).collect()) == sorted([str((8, "clean text of the same id")), str((None, None))])


def test_winnowing_keeps_one_of_every_window():
    import numpy as np
    hashes = np.random.default_rng(1).integers(0, 20, 500).astype(np.uint64)
    kept = set(decontaminate.winnowed(hashes, 9).tolist())
    assert all(kept & set(range(i, i + 9)) for i in range(len(hashes) - 8))
    assert len(decontaminate.winnowed(hashes[:5], 9)) == 0


# --- sharding ----------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_a_bijection_and_is_undone(spark, size):
    p = sharding.Permutation(size, 5)
    rows = p.number(p.place(spark.range(size), "id", "at"), "at", "back").collect()
    assert sorted(r["at"] for r in rows) == list(range(size)) and all(r["id"] == r["back"] for r in rows)
    assert size < 1000 or sum(r["id"] == r["at"] for r in rows) < 20


def test_shards_hold_the_law_of_rows_and_do_not_depend_on_partitions(spark, odd, empty):
    docs = spark.createDataFrame(rows_of([f"text {i} ü" for i in range(95)], 1), SCHEMA).unionByName(odd)
    runs = [sorted(map(tuple, sharding.shards(docs.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    by = collections.defaultdict(list)
    for row in runs[0]:
        by[row[4]].append(row[5])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sizes = {r[0]: r[1] for r in runs[0]}
    assert sizes[900] == 1 and sizes[1] == len("text 0 ü".encode()) + 1
    assert sharding.shards(empty).count() == 0


# --- WARC --------------------------------------------------------------------------------------


def test_archives_round_trip(spark, empty):
    pages = [(3, "http://a/x y", "<p>one</p>", 1), (1, "http://b", "<p>one</p>", 1), (2, None, None, 1), (4, "u", "", 1), (5, "u\r\nX: y", "a\r\n\r\nWARC/1.1\r\nü", 1),
             (6, "u", "a\r\n\r\nWARC/1.1\r\nü", 1), (None, "u", "<p>one</p>", 1), (7, "u", LONG, 1), (8, "u", "solo", 1), (8, "u", "solo", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record int")
    got = warc.archived(df).collect()
    import base64
    first = {}
    for i, _, h, _ in pages:
        h = h or ""
        first[h] = min(first.get(h, i) if first.get(h, i) is not None else i, i) if i is not None and first.get(h, i) is not None else first.get(h) or i
    want = sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit",
                    None if i == first[h or ""] else first[h or ""]) for i, _, h, _ in pages), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {r.html for r in got if r.record_type == "response"} == {h or "" for _, _, h, _ in pages}
    assert warc.archived(df.limit(0)).count() == 0
    floor = warc.archived(df, min_bytes=1).where("page_id IN (2, 4)").collect()
    assert {r.record_type for r in floor} == {"response"}


# --- toxicity ----------------------------------------------------------------------------------


def toxic_table(spark, n=240):
    import random
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "sor") for b in ("ran", "den", "fil", "gom", "hup")]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilefoo", "vilebar", "nastyword"]))
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0), int(i % 3 > 0)))
    return spark.createDataFrame(rows_of(texts, 0), SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_words_and_prefixes(spark, odd, empty):
    docs, labels = toxic_table(spark)
    extra = spark.createDataFrame(rows_of(["so Vilebaz is a nastyword here", "ran den fil"], 5000), SCHEMA)
    got = toxicity.scored(docs.unionByName(extra).unionByName(odd), labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(1, None, 1)], labels.schema)))
    rows = {r.doc_id: r for r in got.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(rows[i].predicted == t for i, t in truth.items())
    spans = [(s.start, s.end) for s in rows[5000].spans]
    assert rows[5000].predicted == 1 and ("so Vilebaz is a nastyword here".index("nastyword"), 25) in [(a, b) for a, b in spans]
    assert rows[5001].predicted == 0 and rows[901].predicted == 0 and rows[900].score == rows[901].score and got.count() == docs.count() + 2 + odd.count()
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.scored(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.scored(docs, labels.limit(0)).count() == docs.count()
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == 180


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np
    moves, e = np.array([0.3, -0.7, 1.1]), np.array([0.5, -1.0, 2.0, 0.1])
    weight = {}
    for states in itertools.product((0, 1), repeat=4):
        w = sum(x for x, s in zip(e, states) if s)
        w += sum({(0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2], (0, 0): 0}[p] for p in zip(states, states[1:]))
        weight[states] = np.exp(w)
    total = sum(weight.values())
    want = [sum(v for s, v in weight.items() if s[i]) / total for i in range(4)]
    got = toxicity.marginals([e, np.zeros(0), e[:1]], moves)
    assert np.allclose(got[0], want) and len(got[1]) == 0 and np.allclose(got[2], np.exp(0.5) / (1 + np.exp(0.5)))


# --- quality ------------------------------------------------------------------------------------


def test_quality_classifier(spark, odd, empty):
    docs, labels = toxic_table(spark)
    junk = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", " ", "### ")).otherwise(F.col("text")))
    got = {r.doc_id: r for r in nbsvm.scored(junk.unionByName(odd), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(got[i].predicted == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert got[900].score == got[901].score and 0 <= got[901].score <= 1
    assert nbsvm.scored(empty, labels).count() == 0
    assert {r.predicted for r in nbsvm.scored(docs, labels.where("quality = 1")).collect()} == {1}


def test_dual_coordinate_descent_separates():
    import numpy as np
    rows = [(np.array([i % 2], np.int32), np.array([1.0])) for i in range(40)]
    w, _ = nbsvm.dual_coordinate_descent(rows, np.array([i % 2 for i in range(40)], float))
    assert w[1] + w[-1] > 0.5 and w[0] + w[-1] < -0.5


def slow_measures(text):
    text = text or ""
    word = re.compile("[^\x20\x09-\x0D]+")
    w, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_rules(spark, odd, empty):
    def text(i):
        words = [f"w{i * 31 + j}" for j in range(20)]
        return " ".join(w + "###" * (i % 5 == 0) for w in words)
    texts = [text(i) for i in range(1500)] + ["a b c d e " * 5, "line\nline\nother\n \n\n", "x y z", "a b c d e f a b c d e"]
    docs = spark.createDataFrame(rows_of(texts, 2000), SCHEMA).unionByName(odd)
    labels = spark.createDataFrame([(2000 + i, int(i % 5 != 0)) for i in range(1500)] + [(None, 1), (2000, 0)], "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels).collect()
    known = collections.defaultdict(list)
    for r in docs.collect():
        known[r.doc_id].append(slow_measures(r.text))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in known[r.doc_id]
    verdicts = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert all(verdicts[2000 + i].kept == (i % 5 != 0) for i in range(1500)) and "symbols" in verdicts[2000].failed_rules
    few = quality_rules.judged(docs, labels.limit(50))
    assert few.where("kept").count() == few.where("NOT base_failed").count()
    assert quality_rules.judged(empty, labels).count() == 0


def test_largest_safe_is_the_exact_binomial_quantile(spark):
    from math import comb
    for n, risk, level in ((0, 0.1, 0.05), (10, 0.1, 0.05), (200, 0.05, 0.01), (900, 0.02, 0.001)):
        total, want = 0.0, -1
        for k in range(n + 1):
            total += comb(n, k) * risk ** k * (1 - risk) ** (n - k)
            if total > level:
                break
            want = k
        got = spark.range(1).select(F.lit(n).alias("n")).select(quality_rules.largest_safe("n", risk, f"{level}D").alias("k")).first().k
        assert got == want


# --- personal data -------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and (not 13 <= len(d) <= 19 or sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, odd, empty):
    texts = ["a@b.co_c@d.org x@y z@q..r.st", "1.2.3.4.5.6.7.8 999.1.1.1 0255.010.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111110000", "+1 (499) 555-6503% +12 +1 2345678 +1.......2345678901234567890",
             "\U0001F600 é a@b.cd \U0001F600 1.1.1.1", "@a.b .@c.d", "a.b." * 3000 + "@x.y", "1 " * 4000, "m@n.op " * 700, "+" * 50, "9" * 5000, "a@b-c.d-e.f@g.h"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(odd)
    got = {r.doc_id: r for r in sanitise.report(docs).collect()}
    for r in docs.where("doc_id IS NOT NULL").collect():
        spans = slow_spans(r.text)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and not x.startswith("term")] == spans
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in PATTERNS)
    assert sanitise.report(docs).count() == docs.count() and sanitise.report(empty).count() == 0


def test_disclosing_words_are_removed_and_common_ones_stay(spark):
    texts = [f"number {i} says write to Zebulon at z@corp.org the end" for i in range(6)] + [f"number {i} says the end of it" for i in range(60)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    first = sanitise.report(docs).where("doc_id = 1").first()
    at = texts[0].index("Zebulon")
    assert f"term:{at}:{at + 7}" in first.spans and f"term:{texts[0].index('the')}" not in first.spans
    clean = sanitise.sanitised(docs).where("doc_id = 1").first().text
    assert "Zebulon" not in clean and "[email]" in clean and clean.endswith("the end")
    assert sanitise.report(docs).where("doc_id > 6 AND spans <> ''").count() == 0


def test_unique_data_have_disclosing_words_and_copies_count_once(spark):
    plain = [f"number {i} says the end of it" for i in range(100)]
    texts = ["says the end Zebulon at z@corp.org the end"] + [f"says the end {'Initech' if i else 'Initech now'} at p{i}@initech.org" for i in range(4)]
    docs = spark.createDataFrame(rows_of(texts + plain), SCHEMA)
    got = {r.doc_id: r for r in sanitise.found(docs).collect()}
    for i, word in enumerate(["Zebulon"] + 4 * ["Initech"]):
        terms, at = [(x.s, x.e) for x in got[i + 1].terms], texts[i].index(word)
        assert (at, at + 7) in terms and not any(texts[i][s:e] in ("the", "end", "says") for s, e in terms)
    copies = spark.createDataFrame(rows_of(texts[:1] * 8 + texts[1:] + plain), SCHEMA)
    again = {r.doc_id: r.terms for r in sanitise.found(copies).collect()}
    assert all(again[i] == got[1].terms for i in range(1, 9))


def slow_terms(texts, generalise_at=0.2):
    """Term spans of each text, from the definition: entities and words of whole distinct texts."""
    z2, facts = 1.96 ** 2, {}
    for text in set(texts):
        data = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in slow_spans(text)]
        own, wider, blank = set(), set(), text
        for kind, s, e in data:
            v, d = text[s:e], re.sub("[^0-9]", "", text[s:e])
            own.add(f"{kind}:{v.lower() if kind in ('email', 'ip') else d}")
            wider.add({"email": f"domain:{v.rsplit('@', 1)[-1].lower()}", "ip": f"net:{'.'.join(v.split('.')[:3])}", "card": f"issuer:{d[:6]}", "phone": f"area:{d[:-4]}"}[kind])
        for m in re.finditer(PATTERNS["email"], text):
            blank = blank[:m.start()] + " " * (m.end() - m.start()) + blank[m.end():]
        places = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", blank)]
        facts[text] = (own, wider, places, {m.lower() for m in re.findall(r"[^\W\d_]+", text)})
    n_t, hits = collections.Counter(), collections.Counter()
    for own, wider, places, words in facts.values():
        n_t.update(words)
        for family in (own, wider):
            for c in family:
                for t in {t for t, _, _ in places}:
                    hits[c, t] += 1 / len(family)

    def bound(c, t):
        p, n = hits[c, t] / n_t[t], n_t[t]
        return (p + z2 / 2 / n - (z2 * (p * (1 - p) + z2 / 4 / n) / n) ** 0.5) / (1 + z2 / n)

    return [sorted((s, e) for t, s, e in facts[x][2] if any(bound(c, t) >= generalise_at for c in facts[x][0] | facts[x][1])) for x in texts]


def test_disclosing_words_equal_brute_force(spark):
    import random
    rng, texts = random.Random(8), []
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    for i in range(150):
        text = rng.choices(words, k=20) + [f"rare{'abcdefghij'[i % 10]}{'klmnopqrstuvwxy'[i // 10]}"]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            text.insert(rng.randrange(len(text)), rng.choice([f"p{rng.randrange(12)}@mail{rng.randrange(3)}.org", f"10.0.{rng.randrange(3)}.{rng.randrange(5)}", f"+44 20 7946 0{rng.randrange(100):03d}", f"Wordak{'q' * rng.randrange(2)}"]))
        texts.append(" ".join(text))
    texts += texts[:20]
    got = {r.doc_id: [(x.s, x.e) for x in r.terms] for r in sanitise.found(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)).collect()}
    expected = slow_terms(texts)
    assert sum(map(bool, expected)) > 50 and all(got[i + 1] == x for i, x in enumerate(expected))


def test_evidence_does_not_depend_on_the_size_of_the_corpus(spark):
    texts = ["says the end Zebulon at z@corp.org the end"] + [f"ask the helper at q{i}@desk.org" for i in range(3)]
    terms = []
    for n in (60, 3000):
        docs = spark.createDataFrame(rows_of(texts + [f"number says the end ask the helper {i}" for i in range(n)]), SCHEMA)
        terms.append([r.terms for r in sanitise.found(docs).where("doc_id <= 4").orderBy("doc_id").collect()])
    assert terms[0] == terms[1] and terms[0][0]


def test_sanitised_rows_are_told_apart_by_id_and_text(spark):
    texts = [(1, "write to a@b.co today"), (1, "another text of length here and x"), (None, "mine is n@b.com"), (None, "none here"), (2, "call +1 499 555 6503@x.org 4111 1111 1111 1111"), (2, None), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z", 9) for d, t in texts + texts[:1]], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in sanitise.sanitised(docs, generalise_at=0.99, remove_at=0.995).collect()), key=str)
    assert len(got) == 8 and got.count((1, "write to [email] today")) == 2
    assert (1, "another text of length here and x") in got and (None, "mine is [email]") in got and (None, "none here") in got and (2, None) in got and (3, "") in got
    mixed = next(t for d, t in got if d == 2 and t)
    assert "6503" not in mixed and "x.org" not in mixed and "1111" not in mixed


# --- pages ------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("<p>Hi &amp; bye", "Hi & bye"), ("no markup  at\n all", "no markup at all"),
    ("<nav><a>m</a></nav><article><h1>T</h1><p>one <b>two</b><br>three<p>f&ouml;ur</article><footer>f</footer>", "T\none two three\nföur"),
    ("<article><p>a <script>var t='</p>';</script>b<style>p{}</style></p><aside>x</aside><form>y</form><div class='ad'>z</div></article>", "a b"),
    ("<div id=menu><a>x</a><a>y</a></div><div class=body><p>" + "word " * 50 + "</p><p>ok.</p></div><section class=comments><p>" + "bla " * 60 + "</p></section>", ("word " * 50).strip() + "\nok."),
    ("<header>site</header><main><p>text &#8212; here</main>", "text — here"), ("<script>only()</script>", ""), ("<p>a b c</p>", "a b c"),
]


def test_content(spark):
    df = spark.createDataFrame([(i, "u", p, 3) for i, (p, _) in enumerate(PAGES)] + [(0, "u", None, 3), (None, None, "<p>x", 3)], "page_id long, url string, html string, text int")
    rows = content.extracted(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert {i: got[i] for i in range(len(PAGES))} == {i: want for i, (_, want) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(PAGES) + 2
    assert content.extracted(df.limit(0)).count() == 0


def test_content_in_steps_equals_content_at_once(monkeypatch):
    page = "<article>" + "".join(f"<p>para {i} &amp; more" for i in range(300)) + "</article>"
    whole = content.extract(page)
    monkeypatch.setattr(content, "STEP", 7)
    assert content.extract(page) == whole and whole.count("\n") == 299


# --- mixing -----------------------------------------------------------------------------------------


def test_raking_meets_the_targets(spark, odd, empty):
    texts = [("word " * (5 + i % 90)).strip() for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 5 else "fr", f"s{i % 3 * (i % 2)}", 0, "x", "y", "z", 1) for i, t in enumerate(texts)], SCHEMA)
    got = mixing.mixed(docs).toPandas()
    for dim, power in mixing.POWERS.items():
        now, want = (got.tokens * got.rate).groupby(got[dim]).sum(), got.groupby(dim).tokens.sum() ** power
        assert abs(now / now.sum() - want / want.sum()).max() < 1e-6
    assert got.rate.max() == 1 and got.rate.min() > 0
    again = mixing.mixed(docs.repartition(5)).toPandas().set_index("doc_id").selected
    assert (got.set_index("doc_id").selected.sort_index() == again.sort_index()).all()
    whole = mixing.mixed(docs.unionByName(odd))
    assert whole.count() == docs.count() + odd.count() and whole.where("tokens < 1 OR rate IS NULL").count() == 0
    picked = mixing.sampled(docs.unionByName(odd))
    assert picked.columns == docs.columns and 0 < picked.count() <= docs.count() + odd.count()
    drawn = whole.where("selected").toPandas()
    assert sorted(map(str, drawn.doc_id.astype("Int64"))) == sorted("<NA>" if r.doc_id is None else str(r.doc_id) for r in picked.collect())
    assert mixing.mixed(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_a_scarce_category_does_not_thin_the_others(spark):
    texts = [("word " * (5 + i % 90)).strip() for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 5 else "fr", f"s{i % 3 * (i % 2)}", 0, "x", "y", "z", 1) for i, t in enumerate(texts)], SCHEMA)
    stray = spark.createDataFrame([(1000, "only three words", "xx", "own", 0, "x", "y", "z", 1)], SCHEMA)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.mixed(docs.unionByName(stray)).toPandas()
    drawn = got.tokens * got.rate
    assert abs(drawn.sum() / got.tokens.sum() - 0.5) < 1e-6 and got.rate.max() <= 1
    assert got[got.source == "own"].rate.item() > 1 - 1e-6
    for dim, own in (("source", "own"), ("lang", "xx")):  # the others keep their shares among each other
        rest = got[got[dim] != own]
        now, want = (rest.tokens * rest.rate).groupby(rest[dim]).sum(), rest.groupby(dim).tokens.sum() ** mixing.POWERS[dim]
        assert abs(now / now.sum() - want / want.sum()).max() < 1e-3


def test_targets_that_contradict_each_other_are_reported(spark):
    docs = spark.createDataFrame([(0, "a b c", "en", "p", 0, "x", "y", "z", 1), (1, "a " * 40, "fr", "q", 0, "x", "y", "z", 1)], SCHEMA)
    with pytest.warns(UserWarning, match="off its goal"):
        mixing.mixed(docs, powers={"source": 0.2, "lang": 1.0, "topic": 1.0}, budget=0.0)


def test_articles_are_kept_whole():
    page = ("<body><nav>Home</nav><article><h2 id='legal-aspects'>Legal aspects</h2><section id='related-work'><p>Work text.</p></section><p class='share-price'>Price up.</p>"
            "<div class='share-buttons'>Tweet</div><div id='comments'>Nice!</div></article><article><ul>" + "".join(f"<li><a href=x>item {i}</a>" for i in range(10)) + "</ul></article><footer>End</footer></body>")
    assert content.extract(page).split("\n") == ["Legal aspects", "Work text.", "Price up."] + [f"item {i}" for i in range(10)]


def test_clusters_decide_bare_pages():
    long = "A sentence of some length that an article would hold, with words enough to count. " * 3
    menu = "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(12))
    page = f"<body><ul>{menu}</ul><div>{long}</div><div>Short one.</div><div>{long}</div><ul>{menu}</ul></body>"
    assert content.extract(page).split("\n") == [long.strip(), "Short one.", long.strip()]


def test_hinge_machine_reaches_the_optimum_of_its_dual():
    import numpy as np
    rng, n, d = np.random.default_rng(3), 40, 6
    dense = rng.normal(size=(n, d))
    labels = (dense @ rng.normal(size=d) + rng.normal(0, 0.8, n) > 0.3).astype(float)
    rows = [(np.arange(d), x) for x in dense]
    w, alpha = nbsvm.dual_coordinate_descent(rows, labels, epochs=800)
    y = np.where(labels > 0, 1.0, -1.0)
    most = np.where(labels > 0, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    x = np.hstack([dense, np.ones((n, 1))])
    full = np.append(w[:d], w[-1])
    assert np.allclose(full, (alpha * y) @ x) and (alpha >= 0).all() and (alpha <= most + 1e-12).all()
    primal = full @ full / 2 + (most * np.maximum(0, 1 - y * (x @ full))).sum()
    dual = alpha.sum() - full @ full / 2
    assert abs(primal - dual) < 1e-3 * primal
    # The dual by brute force: projected gradient from many steps.
    q, other = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        other = np.clip(other + step * (1 - q @ other), 0, most)
    assert abs(other.sum() - other @ q @ other / 2 - dual) < 1e-3 * dual
