"""Spelling variants, conversation repair and the Jaccard join against brute force on odd and small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlespark.llm import dialogue, jaccard, variants

SCHEMA = "doc_id long, text string, word string, n string, id string, sig string, node string, label string"


def docs_of(spark, texts, start=1):
    return spark.createDataFrame([(start + i, t, "x", "y", "z", "s", "k", "l") for i, t in enumerate(texts)], SCHEMA)


# --- spelling variants -----------------------------------------------------------------------------


def slow_variants(rows):
    counts = {}
    for doc, text in rows:
        lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, None, n, len(close), None]
        out[w][4] = words[out[w][0]] if out[w][0] else None
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def found_variants(docs, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.grouped(docs, **options).collect()}


def variant_rows():
    rng = random.Random(3)
    base = ["colour", "harbour", "straße", "ÜBERMUT", "aabbaabb", "banana", "çedille", "x" * 30]
    texts = []
    for i in range(60):
        words = []
        for w in base:
            for _ in range(rng.randint(0, 6)):
                v = list(w)
                if rng.random() < 0.3:
                    at, kind = rng.randrange(len(v)), rng.randrange(3)
                    v[at:at + 1] = [[], [rng.choice("abÿ")], [v[at], rng.choice("ab")]][kind]
                words.append("".join(v))
        texts.append((i, " ".join(words) + ". 12 abc Ünder-score"))
    return texts + [(None, "colour colour colouur"), (None, None), (7, ""), (8, " \n\t"), (9, "colour colour"), (9, "colour colour"), (10, "y" * 5000 + " " + "z" * 5000)]


def test_variants_equal_brute_force(spark):
    chain = " ".join(["kettle"] * 4 + ["kettla"] * 10 + ["kottla"] * 30)
    rows = variant_rows() + [(700, chain)] + [(20 + i, "q" * 700 + " " + "q" * 699 + "r") for i in range(6)]
    docs = spark.createDataFrame([(d, t, "x", "y", "z", "s", "k", "l") for d, t in rows], SCHEMA).repartition(3)
    expected = slow_variants(rows)
    assert found_variants(docs) == expected and any(v[0] for v in expected.values()) and any(v[1] != v[0] and v[0] for v in expected.values())


def test_variants_in_many_passes_and_steps(spark, monkeypatch):
    rows = variant_rows()
    docs = spark.createDataFrame([(d, t, "x", "y", "z", "s", "k", "l") for d, t in rows], SCHEMA)
    monkeypatch.setattr(variants, "STEP", 64)
    assert len(variants.passes({5: 1000, 6: 3}, 64)) > 10
    assert found_variants(docs, pass_bytes=16) == slow_variants(rows)


def test_variants_of_nothing(spark):
    assert found_variants(docs_of(spark, [])) == {} and found_variants(docs_of(spark, [None, "", "a b c", "once upon"])) == {}


def test_edits_hash_to_the_words_they_make():
    words = ["banana", "straße"[:6], "aabbab"]
    for _, letters in variants.by_length(words):
        for row, place, h in itertools.chain.from_iterable(zip(*x) for x in variants.deletions(letters)):
            w = bytes(letters[row]).decode("latin-1")
            assert variants.total_hash(np.frombuffer((w[:place] + w[place + 1:]).encode("latin-1"), np.uint8)[None, :])[0] == h
        for row, place, new, h in itertools.chain.from_iterable(zip(*x) for x in variants.substitutions(letters, np.frombuffer(b"abz", np.uint8))):
            w = bytes(letters[row]).decode("latin-1")
            assert variants.total_hash(np.frombuffer((w[:place] + chr(new) + w[place + 1:]).encode("latin-1"), np.uint8)[None, :])[0] == h


# --- conversations -----------------------------------------------------------------------------------


def cheapest(roles, faults):
    """All edits by exhaustive search: least cost, then least audit, with the lines it leaves."""
    best = {(0, ""): (0, "", ())}
    frontier = {0: (0, "", ())}  # grammar state -> cost, audit, choices

    def closed(states):
        out = dict(states)
        for _ in range(6):
            for g, (c, a, l) in list(out.items()):
                h = dialogue.WANTED[g]
                new = (c + 2, a + "I", l + (("insert", dialogue.NAMES[h]),))
                if h not in out or new[:2] < out[h][:2]:
                    out[h] = new
        return out

    for i, (role, fault) in enumerate(zip(roles, faults)):
        nxt = {}
        for g, (c, a, l) in closed(frontier).items():
            ways = [(g, c + 3, "D", l)]
            if fault in "kt":
                cut = fault == "t"
                if (g, role[:1]) in dialogue.LEGAL:
                    ways.append((dialogue.LEGAL[g, role[:1]], c + cut, "K", l + ((i, role),)))
                ways.append((dialogue.WANTED[g], c + 2 + cut, "R", l + ((i, dialogue.NAMES[dialogue.WANTED[g]]),)))
            for h, cost, name, lines in ways:
                new = (cost, a + name, lines)
                if h not in nxt or new[:2] < nxt[h][:2]:
                    nxt[h] = new
        frontier = nxt
    del best
    return min((v for g, v in closed(frontier).items() if g in (0, 3)), key=lambda v: v[:2])


def slow_repair(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, items in groups.items():
        after = []
        for turn, role, text in items:
            mark = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            d, role, text = zlib.crc32(mark.encode()) % 20, " " if role is None else role, " " if text is None else text
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        if not after:
            out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        seen, faults = set(), []
        for _, role, text in after:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "k")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, lines = cheapest([r for _, r, _ in after], faults)
        text = "\n".join(f"{role}:" if i == "insert" else f"{role}:{after[i][2]}" for i, role in lines)
        out[conv] = (gaps, *[faults.count(x) for x in "bdt"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "What?", "cut off", "", " \t", None, "Long one.\n", "Sí. ", "same."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    rows += [(500, i, ["user", "assistant"][i % 2], f"row {i}" + "." * (i % 3 > 0)) for i in range(400)]
    return rows


@pytest.mark.parametrize("chunk, parts", [(64, 2), (3, 7), (1, 3)])
def test_repairs_equal_brute_force(spark, chunk, parts):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, copies int").repartition(parts)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(df, chunk=chunk).collect()}
    assert got == slow_repair(rows)


def test_repair_of_an_empty_table(spark):
    assert dialogue.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_suffixes_are_evaluated_once(monkeypatch):
    calls = []
    real = dialogue.node
    monkeypatch.setattr(dialogue, "node", lambda s, t: calls.append(s) or real(s, t))
    path, spelt, sigs = [dialogue.EMPTY], "", sorted({"AEI", "EI", "BEI", "I", "AAEI"}, key=lambda s: s[::-1])
    for sig in sigs:
        back, same = sig[::-1], 0
        while same < min(len(spelt), len(back)) and spelt[same] == back[same]:
            same += 1
        del path[same + 1:]
        for symbol in back[same:]:
            path.append(dialogue.node(symbol, path[-1]))
        spelt = back
    assert len(calls) == len({s[i:] for s in sigs for i in range(len(s))})


# --- Jaccard join ----------------------------------------------------------------------------------------


def slow_similar(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
        sets.append({" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def similar_rows():
    rng = random.Random(2)
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for family in range(12):
        size = rng.choice([3, 5, 9, 30, 120, 600])
        base = [f"f{family}w{rng.randrange(size)}" for _ in range(size)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10 ** 6)}"
            rows.append(" ".join(text) + (" " + passage if rng.random() < 0.5 else ""))
    rows += [None, "", " \n", "One", "one", "Two Words", "two words", "ü é", rows[0], rows[0].upper(), " ".join(f"w{i % 977}" for i in range(30_000))]
    return [(i + 1, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, "alone here now then"), (5, "same id other text here"), (5, "same id other text here")]


def found_similar(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y", "z", "s", "k", "l") for d, t in rows], SCHEMA).repartition(3)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.similar(df, **options).collect()), key=str)


def test_similar_sets_equal_brute_force(spark):
    rows = similar_rows()
    assert found_similar(spark, rows) == slow_similar(rows)


def test_hot_groups_are_joined_in_rounds(spark, monkeypatch):
    """Near copies of one text, with pivots forced from the start and tasks that hand on little at a time."""
    rng, base = random.Random(4), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(80)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    for name, value in (("CROSS", 0), ("FLUSH", 300), ("SLOT", 200), ("TOGETHER", 500)):
        monkeypatch.setattr(jaccard, name, value)
    assert found_similar(spark, rows) == slow_similar(rows)


def test_no_similar_sets(spark):
    assert found_similar(spark, []) == [] and found_similar(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("size", [1, 2, 7, 13, 60, 400])
def test_sets_near_enough_share_a_signature(size):
    """Every pair at the least similarity allowed shares a signature, whatever the layout."""
    rng = np.random.default_rng(size)
    for choice in jaccard.CHOICES:
        plan = {}
        for band in range(60):
            apart = jaccard.most_apart(jaccard.band_top(band))
            left, pieces = choice
            plan[band] = (1, 1, 0) if apart == 0 else (-(-(apart + 1) // (left + 1)), pieces, left)
        sign = jaccard.Signer(plan)
        for _ in range(20):
            a = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
            lost = rng.integers(0, size * 15 // 100 + 1)
            gained = rng.integers(0, max(1, (100 * (size - lost) - 85 * size) // 85 + 1))
            b = np.concatenate([a[lost:], rng.integers(0, 2 ** 63, gained, dtype=np.uint64)])
            both = size - lost
            if 100 * both >= 85 * (size + len(b) - both):
                assert set(sign(np.unique(a)).tolist()) & set(sign(np.unique(b)).tolist())


@pytest.mark.parametrize("population", [1_000, 50_000, 5_000_000])
def test_signatures_stay_few_in_large_tables(population):
    for top in (400, 600, 1_200, 5_000, 20_000):
        parts, pieces, left = jaccard.layout(top, population)[:3]
        assert parts * math.comb(pieces, left) < 0.3 * top


@pytest.mark.parametrize("size", [9, 20, 45, 100, 200, 700])
def test_sets_near_enough_share_a_signature_that_is_not_thin(size):
    """With spare parts, too, every pair at the least similarity shares a signature."""
    rng = np.random.default_rng(size)
    layouts = [(spare, pieces, left) for spare in (0, 1, 2, 5, 12) for left, pieces in ((0, 1), (1, 3), (2, 5))]
    plans = [{b: jaccard.layout(jaccard.band_top(b), n) for b in range(60)} for n in (100, 50_000, 5_000_000)]
    plans += [{b: (jaccard.most_apart(jaccard.band_top(b)) // (left + 1) + 1 + spare, pieces, left) for b in range(60)} for spare, pieces, left in layouts]
    for sign in map(jaccard.Signer, plans):
        for _ in range(30):
            a = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
            lost = rng.integers(0, size * 15 // 100 + 1)
            gained = rng.integers(0, max(1, (100 * (size - lost) - 85 * size) // 85 + 1))
            b = np.concatenate([a[lost:], rng.integers(0, 2 ** 63, gained, dtype=np.uint64)])
            if 100 * (size - lost) >= 85 * (size + gained):
                assert set(sign(np.unique(a)).tolist()) & set(sign(np.unique(b)).tolist())


def test_long_sets_meet_by_their_sketches(spark, monkeypatch):
    """Only two long sets have sketches to compare; shared passages make unlike sets meet."""
    monkeypatch.setattr(jaccard, "LONG", 100)
    rng, rows = random.Random(7), []
    for family in range(6):
        base = [f"p{i}" for i in range(40)] + [f"f{family}w{i}" for i in range(rng.choice([40, 70, 160, 900]))]
        for i in range(7):
            text = list(base)
            for _ in range(i * len(base) // 150):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    assert found_similar(spark, rows) == slow_similar(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        assert jaccard.parities_apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
