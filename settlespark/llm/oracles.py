"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from settlespark.llm.dialogue import CUT, DAMAGE, DELETE, INSERT, LEGAL, NAMES, REROLE, WANTED
from settlespark.llm.sharding import PRIME, Permutation
from settlespark.llm.warc import ALPHABET

WORDS4 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS4}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS4}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT k, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)),
hit AS (SELECT k, dw.size, i, item FROM dw JOIN bw USING (size, win)),
cov AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT k, i, size FROM hit)) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (k) LEFT JOIN its USING (k)"""

_B32 = (f"array_to_string(list_transform(range(0, 32), lambda i: ('{ALPHABET}')[CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER)"
        " >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1]), '')")
WARC = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def sharding(seed: int, count: int = 8) -> str:
    keys = Permutation(1, seed).keys()
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: {step})"

    def mixed(half: str) -> str:
        h0 = f"((s.{half} * k.m) % {PRIME})"
        h1 = f"(({h0} * {h0} + k.c) % {PRIME})"
        return f"(({h1} * {h1} + k.d) % {PRIME})"

    def permuted(x: str) -> str:
        z = "CAST(0 AS BIGINT)"
        rest = ", ".join(f"{{'l': {z}, 'r': {z}, 'odd': {str(r % 2 == 1).lower()}, 'm': CAST({m} AS BIGINT), 'c': CAST({c} AS BIGINT), 'd': CAST({d} AS BIGINT)}}" for r, (m, c, d) in enumerate(keys))
        first = f"{{'l': {x} % a, 'r': {x} // a, 'odd': false, 'm': {z}, 'c': {z}, 'd': {z}}}"
        out = (f"list_reduce([{first}, {rest}], lambda s, k: {{'l': CASE WHEN k.odd THEN s.l ELSE (s.l + {mixed('r')}) % a END, "
               f"'r': CASE WHEN k.odd THEN (s.r + {mixed('l')}) % b ELSE s.r END, 'odd': false, 'm': {z}, 'c': {z}, 'd': {z}}})")
        return f"struct_extract({out}, 'r') * a + struct_extract({out}, 'l')"

    return f"""
WITH RECURSIVE t AS (SELECT {table} AS tab),
c AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda y: CAST((instr('0123456789ABCDEF', y[1]) - 1) * 16 + instr('0123456789ABCDEF', y[2]) - 1 AS BIGINT))),
    lambda s, y: xor(s >> 8, CAST(tab[CAST(xor(s, y) & 255 AS INTEGER) + 1] AS BIGINT))), 4294967295) AS text_crc32 FROM documents, t),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS x, CAST(count(*) OVER () AS BIGINT) AS total FROM c),
g AS (SELECT *, CAST(ceil(sqrt(total)) AS BIGINT) AS a, CAST(ceil(total / ceil(sqrt(total))) AS BIGINT) AS b FROM n),
w AS (SELECT doc_id, size, text_crc32, total, a, b, {permuted('x')} AS place FROM g
  UNION ALL SELECT doc_id, size, text_crc32, total, a, b, {permuted('place')} FROM w WHERE place >= total)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {count} AS INTEGER) AS shard, place // {count} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM w WHERE place < total"""


def mixing(powers: dict[str, float], seed: int, rounds: int = 25) -> str:
    dims = list(powers)
    ws = r"[\x20\x09-\x0D]+"

    def often(pattern: str, share: float) -> str:
        return f"len(regexp_extract_all(t, '{pattern}')) > {share} * tokens"

    chain, last = [], "c0"
    for i in range(rounds):
        for d in dims:
            name = f"c{i}_{d}"
            chain.append(f"{name} AS (SELECT * REPLACE (w * t_{d} * total / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
            last = name
    goals = ", ".join(f"g_{d} AS (SELECT {d}, p / sum(p) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(tokens), {p}) AS p FROM cells GROUP BY {d}))" for d, p in powers.items())
    joins = " ".join(f"JOIN g_{d} USING ({d})" for d in dims)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  CAST(greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '{ws}'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents),
e AS (SELECT * EXCLUDE (t), CASE WHEN {often('[|]', 0.2)} THEN 'table' WHEN {often('[#*$%&<>]', 0.3)} THEN 'markup' WHEN {often('[A-Z]{2}', 0.5)} THEN 'loud'
  WHEN tokens < 50 THEN 'note' ELSE 'prose' END AS topic FROM d),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL), {goals},
c0 AS (SELECT cells.*, tokens AS w, sum(tokens) OVER () AS total, {', '.join(f't_{d}' for d in dims)} FROM cells {joins}),
{', '.join(chain)},
r AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS rate FROM {last})
SELECT doc_id, source, lang, topic, e.tokens, round(rate, 6) AS rate,
  CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate AS selected
FROM e JOIN r USING (source, lang, topic)"""


def quality_rules(rules: dict, max_false: float = 0.05, error: float = 0.05) -> str:
    risk, ws = max_false / len(rules), r"[\x20\x09-\x0D]+"
    grid = " UNION ALL ".join(f"SELECT '{name}' AS rule, unnest([{', '.join(map(str, cuts))}]) AS cut" for name, (_, cuts) in rules.items())
    values = " UNION ALL ".join(
        f"SELECT k, '{name}' AS rule, CASE WHEN {v.split(' / ')[1]} = 0 THEN 0 ELSE {v.split(' / ')[0]} / {v.split(' / ')[1]} END AS value FROM m" for name, (v, _) in rules.items())
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT k, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, k, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter,
  len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN rep USING (k)),
v AS ({values}), grid AS ({grid}),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, k, quality FROM m JOIN q USING (doc_id) WHERE NOT base_failed),
good AS (SELECT stratum, sum((quality = 1)::INT) AS n FROM h GROUP BY stratum),
tests AS (SELECT count(*) * {len(rules)} AS m FROM good),
curve AS (SELECT stratum, rule, cut, sum((quality = 1)::INT) AS gr, sum((quality <> 1)::INT) AS br FROM h JOIN v USING (k) JOIN grid USING (rule) WHERE value > cut GROUP BY ALL),
sure AS (SELECT curve.*, n, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) FROM unnest(range(0, CAST(gr AS BIGINT) + 1)) u(i)) AS p
  FROM curve JOIN good USING (stratum)),
best AS (SELECT stratum, rule, max_by(cut, (br - gr) * 1000 + cut) AS cut FROM sure, tests WHERE p <= {error} / m AND br > gr GROUP BY ALL),
bad AS (SELECT k, string_agg(rule, ',' ORDER BY rule) AS failed FROM m JOIN v USING (k) JOIN best USING (stratum, rule) WHERE value > cut GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM m LEFT JOIN bad USING (k)"""


def _crc_table() -> str:
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return table


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8; the byte table is column ``tab``."""
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode({text})), '..'),"
            " lambda y: CAST((instr('0123456789ABCDEF', y[1]) - 1) * 16 + instr('0123456789ABCDEF', y[2]) - 1 AS BIGINT))),"
            " lambda s, y: xor(s >> 8, CAST(tab[CAST(xor(s, y) & 255 AS INTEGER) + 1] AS BIGINT))), 4294967295)")


VARIANTS = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS tab),
runs AS (SELECT k, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY k, run),
marked AS (SELECT run, n, {_crc("k || ':' || run")} AS h FROM runs, t),
heard AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM heard WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
holed AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM cut),
pairs AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM holed a JOIN holed b USING (hole) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM holed a JOIN v ON a.less = v.word UNION SELECT v.word, v.n, a.word, a.n FROM holed a JOIN v ON a.less = v.word),
best AS (SELECT a AS word, na AS n, count(*) AS n_near, max(nb) AS top FROM pairs GROUP BY a, na),
forms AS (SELECT word, n_near, min(CASE WHEN nb = top AND top >= 2 * n THEN b END) AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM best JOIN pairs ON a = word GROUP BY word, n_near, top, n),
r AS (SELECT word, word AS root FROM v UNION ALL SELECT r.word, f.form FROM r JOIN forms f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT v.word, forms.form, r.root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN forms USING (word)
JOIN (SELECT r.word, r.root FROM r LEFT JOIN forms f ON f.word = r.root WHERE f.form IS NULL) r USING (word)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT k, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.k < b.k GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT k, k AS m FROM d UNION SELECT r.k, ways.b FROM r JOIN ways ON r.m = ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id FROM d LEFT JOIN n USING (k)
JOIN (SELECT r.k, min(x.doc_id) AS component_id FROM r JOIN d x ON r.m = x.k GROUP BY r.k) l USING (k)"""


def dialogue() -> str:
    """All ways of a conversation, of which the best to each state is kept row by row."""
    steps = []
    for g in range(4):
        for role in "suax":
            for fault in "kbdt":
                state, inserted = g, []
                for _ in range(4):
                    ways = [("D", DELETE, state, "")]
                    if fault in "kt":
                        cut = CUT if fault == "t" else 0
                        ways += [("K", cut, LEGAL[state, role], "")] if (state, role) in LEGAL else []
                        ways.append(("R", REROLE + cut, WANTED[state], NAMES[WANTED[state]]))
                    steps += [f"({g}, '{role}', '{fault}', {to}, {INSERT * len(inserted) + cost}, '{'I' * len(inserted)}{name}', {inserted}::VARCHAR[], '{head}')"
                              for name, cost, to, head in ways]
                    state = WANTED[state]
                    inserted = [*inserted, f"{NAMES[state]}:"]
    ends = "(0, 0, '', []::VARCHAR[]), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', []::VARCHAR[])"
    return f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS tab),
o AS (SELECT coalesce('v' || conv_id, 'n') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % {DAMAGE} AS d FROM conversations, t),
dm AS (SELECT key, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE d <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM dm),
f AS (SELECT key, turn, pos, role, text, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial, role[1] AS first_letter,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault FROM p),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) AS n FROM f GROUP BY key),
odd AS (SELECT key, count(*) AS illegal FROM (SELECT key, lag(first_letter) OVER (PARTITION BY key ORDER BY pos) || first_letter AS pair FROM f) WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY key),
steps(g, initial, fault, h, price, name, before, head) AS (VALUES {', '.join(steps)}),
ends(h, price, name, after) AS (VALUES {ends}),
w AS (SELECT key, CAST(0 AS BIGINT) AS pos, 0 AS h, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL SELECT w.key, f.pos, steps.h, CAST(w.cost + price AS BIGINT), w.audit || name,
    list_concat(w.lines, before, CASE WHEN name LIKE '%D' THEN []::VARCHAR[] WHEN head <> '' THEN [head || ':' || f.text] ELSE [f.role || ':' || f.text] END)
  FROM w JOIN f ON f.key = w.key AND f.pos = w.pos + 1 JOIN steps ON steps.g = w.h AND steps.initial = f.initial AND steps.fault = f.fault
  QUALIFY row_number() OVER (PARTITION BY w.key, steps.h ORDER BY w.cost + price, w.audit || name) = 1),
done AS (SELECT w.key, w.cost + price AS cost, w.audit || name AS audit, array_to_string(list_concat(lines, after), chr(10)) AS lines
  FROM w JOIN counts ON counts.key = w.key AND counts.n = w.pos JOIN ends USING (h) QUALIFY row_number() OVER (PARTITION BY w.key ORDER BY w.cost + price, w.audit || name) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM o) a LEFT JOIN counts USING (key) LEFT JOIN odd USING (key) LEFT JOIN done USING (key)"""
