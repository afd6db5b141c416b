"""Repair of conversation structure at least cost, over suffixes that all conversations share.

Rows become one letter each: their role and their fault. Conversations are cut into chunks of at
most ``CHUNK`` letters. The distinct suffixes of all chunks are the nodes of an automaton read from
the end; each node is evaluated once for every state of the grammar, whatever the number of chunks
that end in it. Long conversations then compose the tables of their chunks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import broadcast_if_small
from settlespark.session import durable

CHUNK = 64
ROLES, FAULTS = "sua", "kbdt"  # other roles count as the fourth; kept, blank, duplicate, truncated
START, SYSTEM, USER, ASSISTANT = range(4)  # states of (s?(ua)+)?: what was emitted last
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = (USER, USER, ASSISTANT, USER)  # what an inserted or changed row becomes in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
DAMAGE = 20
_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def letter(role: str, fault: str) -> str:
    """One letter for a row: four roles by four faults."""
    return chr(ord("A") + 4 * (ROLES.find(role[:1]) % 4 if role[:1] else 3) + FAULTS.index(fault))


# --- costs of suffixes ------------------------------------------------------------------------------


def _better(a, b):
    return b if a is None or b is not None and b < a else a


def with_inserts(table: list[list]) -> list[list]:
    """Costs when rows may be inserted first; three are enough to come back to a state already seen."""
    out = [list(row) for row in table]
    for _ in range(3):
        for g in range(4):
            for h in range(4):
                ahead = out[WANTED[g]][h]
                out[g][h] = _better(out[g][h], ahead and (ahead[0] + INSERT, "I" + ahead[1]))
    return out


def node(symbol: str, tail: list[list]) -> list[list]:
    """``(cost, audit)`` by state before and after, for a row and the suffix that follows it; null where none leads there."""
    role, fault = (ROLES + "x")[(ord(symbol) - 65) // 4], FAULTS[(ord(symbol) - 65) % 4]
    out: list[list] = [[None] * 4 for _ in range(4)]
    for g in range(4):
        ways = [("D", DELETE, g)]
        if fault in "kt":
            cut = CUT if fault == "t" else 0
            if (g, role) in LEGAL:
                ways.append(("K", cut, LEGAL[g, role]))
            ways.append(("R", REROLE + cut, WANTED[g]))
        for name, cost, to in ways:
            for h in range(4):
                rest = tail[to][h]
                out[g][h] = _better(out[g][h], rest and (cost + rest[0], name + rest[1]))
    return with_inserts(out)


#: Nothing follows within the chunk; inserts before the next row belong to the next chunk.
EMPTY = [[(0, "") if g == h else None for h in range(4)] for g in range(4)]
#: At the end a conversation is empty or ends with the assistant.
ENDS = [_better(row[START], row[ASSISTANT]) if g == START else row[ASSISTANT] for g, row in enumerate(with_inserts(EMPTY))]


def suffix_tables(signatures: DataFrame) -> DataFrame:
    """``(sig, costs, audits)`` of distinct signatures: 16 entries, by state before and after.

    Signatures are ordered by their letters from the end, so those that share a suffix follow each
    other. A task keeps the nodes of one path only; a node is evaluated once, when the path first
    reaches it, and a suffix that several tasks share once in each of them.
    """
    def run(batches):
        path, spelt = [EMPTY], ""
        for batch in batches:
            costs, audits = [], []
            for sig in batch.column(0).to_pylist():
                back, same = sig[::-1], 0
                while same < min(len(spelt), len(back)) and spelt[same] == back[same]:
                    same += 1
                del path[same + 1:]
                for symbol in back[same:]:
                    path.append(node(symbol, path[-1]))
                spelt = back
                flat = [x for row in path[-1] for x in row]
                costs.append([x and x[0] for x in flat])
                audits.append([x and x[1] for x in flat])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=["sig", "costs", "audits"])

    back = F.reverse("sig")
    return signatures.repartitionByRange(back).sortWithinPartitions(back).mapInArrow(run, "sig string, costs array<bigint>, audits array<string>")


# --- rows, chunks and conversations -------------------------------------------------------------------


def key_of(conv: Column) -> Column:
    """A text that tells a null from every value."""
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(key, turn, role, text, copies)`` after the stated damage; equal rows of a turn are one, counted."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col).cast("string"), space), F.coalesce(F.col(text_col).cast("string"), space)
    mark = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    named = rows.select(key_of(F.col(conv_col)).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (F.crc32(mark.cast("binary")) % DAMAGE).alias("d")).where("d <> 0")
    changed = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select("key", "turn", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                        F.when(F.col("d") == 3, 2).otherwise(1).alias("c")).groupBy("key", "turn", "role", "text").agg(F.sum("c").alias("copies"))


def faulty(texts: DataFrame) -> DataFrame:
    """One narrow row for each copy, with its first fault; texts are named by their digest."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_turn"))
    first = texts.groupBy("key", "role", "digest").agg(F.min(turn).alias("first"))
    narrow = texts.select("key", "turn", "role", "digest", "blank", "ended", "copies").join(first, ["key", "role", "digest"])
    each = narrow.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    seen = ~F.col("turn").eqNullSafe(F.col("first.first_turn")) | (F.col("copy") > 1)
    fault = F.when(F.col("blank"), "b").when(seen, "d").when(~F.col("ended"), "t").otherwise("k")
    return each.select("key", F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "copy", fault.alias("fault"))


_CHUNK = ("key string, part int, seq bigint, sig string, n_turns bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, "
          "illegal bigint, blank bigint, duplicate bigint, truncated bigint, members array<struct<turn:bigint,role:string,digest:binary>>")


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Consecutive rows of a conversation in chunks, numbered by (part, seq). A long conversation lies in several partitions."""
    order = ["key", "known", "turn", "role", "digest", "copy"]

    def run(batches):
        from pyspark import TaskContext

        part, seq, chunk, key = TaskContext.get().partitionId(), 0, [], None

        def closed():
            turns = [r[0] for r in chunk]
            roles = [r[1][:1] for r in chunk]
            faults = [r[3] for r in chunk]
            known = [t for t in turns if t is not None]
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
            return (key, part, seq, "".join(letter(r, f) for r, f in zip(roles, faults)), len(set(known)), known[0] if known else None, known[-1] if known else None,
                    roles[0], roles[-1], pairs, faults.count("b"), faults.count("d"), faults.count("t"), [{"turn": t, "role": r, "digest": d} for t, r, d, _ in chunk])

        kind = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("sig", pa.string()), ("n_turns", pa.int64()), ("first_turn", pa.int64()),
                          ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()),
                          ("duplicate", pa.int64()), ("truncated", pa.int64()),
                          ("members", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())])))])

        def handed(done):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kind)], schema=kind)

        for batch in batches:
            done = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if chunk and (row[0] != key or len(chunk) == size):
                    done.append(closed())
                    seq, chunk = seq + 1, []
                key = row[0]
                chunk.append(row[1:])
            if done:
                yield handed(done)
        if chunk:
            yield handed([closed()])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("key", "turn", "role", "digest", "fault").mapInArrow(run, _CHUNK)


def folded(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, least cost and audit, and the piece of the audit in each chunk with the state before it.

    Chunks stream in order. Of the ways to a state only the best is held; of equal costs the audit
    that is less, which stays less whatever follows.
    """
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = pa.schema([("key", pa.string()), *[(n, pa.int64()) for n in numbers], ("audit", pa.string()),
                      ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32()), ("piece", pa.string())])))])

    def run(batches):
        one: dict = {}

        def ended():
            ways = [(c[0] + ENDS[h][0], c[1] + ENDS[h][1]) for h, c in enumerate(one["best"]) if c is not None]
            cost, audit = min(ways)
            pieces, at, state = [], 0, START
            for i, (part, seq, n) in enumerate(one["chunks"]):
                start, before = at, state
                while n:
                    name, role = audit[at], None
                    at += 1
                    if name == "K":
                        role = one["roles"][i][len(one["roles"][i]) - n]
                    state = LEGAL[state, role] if role else state if name == "D" else WANTED[state]
                    n -= name != "I"
                pieces.append({"part": part, "seq": seq, "state": before, "piece": audit[start:at]})
            pieces[-1]["piece"] += audit[at:]
            gaps = one["last"] - one["first"] + 1 - one["turns"] if one["first"] is not None else 0
            return (one["key"], gaps, one["blank"], one["duplicate"], one["truncated"], one["illegal"], cost, audit, pieces)

        def handed(done):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kind)], schema=kind)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if one and one["key"] != r["key"]:
                    done.append(ended())
                    one = {}
                if not one:
                    one = {"key": r["key"], "best": [(0, ""), None, None, None], "chunks": [], "roles": [], "first": None, "last": None, "turns": 0,
                           "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}
                costs, audits, best = r["costs"], r["audits"], [None] * 4
                for g, way in enumerate(one["best"]):
                    for h in range(4) if way else ():
                        if costs[4 * g + h] is not None:
                            best[h] = _better(best[h], (way[0] + costs[4 * g + h], way[1] + audits[4 * g + h]))
                one["best"] = best
                one["chunks"].append((r["part"], r["seq"], len(r["sig"])))
                one["roles"].append("".join((ROLES + "x")[(ord(c) - 65) // 4] for c in r["sig"]))
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    one[name] += r[name]
                if one["role"] is not None:
                    one["illegal"] += one["role"] + r["first_role"] not in ("su", "ua", "au")
                one["role"] = r["last_role"]
                if r["first_turn"] is not None:
                    one["turns"] += r["n_turns"] - (one["last"] == r["first_turn"])
                    one["first"] = r["first_turn"] if one["first"] is None else one["first"]
                    one["last"] = r["last_turn"]
            if done:
                yield handed(done)
        if one:
            yield handed([ended()])

    ready = chunks.drop("members").join(broadcast_if_small(tables, tables.count(), 20_000), "sig")
    spread = ready.repartition("key").sortWithinPartitions("key", "part", "seq")
    return spread.mapInArrow(run, "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
                                  "pieces array<struct<part:int,seq:bigint,state:int,piece:string>>")


def edited(chunks: DataFrame, repaired: DataFrame) -> DataFrame:
    """``(key, part, seq, at, turn, role, digest, before, head, after)`` of rows that give lines: rows inserted around them and the role they take."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, at, before, rows = r["state"], 0, [], []
                for name in r["piece"]:
                    if name == "I":
                        state = WANTED[state]
                        before.append(f"{NAMES[state]}:")
                        continue
                    m, head = r["members"][at], None
                    if name == "K":
                        head, state = m["role"], LEGAL[state, m["role"][:1]]
                    elif name == "R":
                        state = WANTED[state]
                        head = NAMES[state]
                    rows.append([r["key"], r["part"], r["seq"], at, m["turn"], m["role"], m["digest"], before, head, []])
                    at, before = at + 1, []
                rows[-1][-1] = before
                out += [row for row in rows if row[7] or row[8] is not None or row[9]]
            cols = list(zip(*out)) or [()] * 10
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            names = ["key", "part", "seq", "at", "turn", "role", "digest", "before", "head", "after"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    pieces = repaired.select("key", F.explode("pieces").alias("p")).select("key", "p.*")
    return pieces.join(chunks.select("key", "part", "seq", "members"), ["key", "part", "seq"]).mapInArrow(
        run, "key string, part int, seq bigint, at int, turn bigint, role string, digest binary, before array<string>, head string, after array<string>")


def repaired_rows(chunks: DataFrame, repaired: DataFrame, texts: DataFrame) -> DataFrame:
    """``(key, part, seq, at, lines)``: the lines of the repaired conversations, joined by line ends, in the order of the first four columns."""
    own = texts.select("key", F.col("turn").alias("t"), "role", "digest", "text")
    rows = edited(chunks, repaired)
    met = rows.join(own, (rows["key"] == own["key"]) & rows["turn"].eqNullSafe(own["t"]) & (rows["role"] == own["role"]) & (rows["digest"] == own["digest"]))
    line = F.when(F.col("head").isNotNull(), F.array(F.concat("head", F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    return met.select(rows["key"], "part", "seq", "at", F.array_join(F.concat("before", line, "after"), "\n").alias("lines"))


def hashed(lines: DataFrame) -> DataFrame:
    """``(key, repaired_sha256)`` of the lines of each conversation, which stream through the hash one by one."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                if state is not None and k == key:
                    state.update(b"\n" + data)
                else:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(data)
            cols = list(zip(*done)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    return lines.repartition("key").sortWithinPartitions("key", "part", "seq", "at").select("key", "lines").mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of ``rows``: faults after the stated damage, the cheapest edits and a hash of what they leave.

    Rows follow each other by turn, null turns first; rows of one turn by role, then by the MD5 digest
    of their text, so copies are adjacent. Null roles and texts, and nulls in the mark that decides
    the damage, count as one space; rows with a null conversation id are one conversation. Rows that
    repeat count each. A role is known by its first letter. A conversation without rows after the damage has zeros,
    an empty audit and the hash of nothing. Other columns are not read; an empty table gives no rows.

    No task holds a conversation: rows are range-partitioned, chunks are folded as they stream, and
    lines stream through the hash, which has to see those of one conversation in turn.
    """
    texts = durable(damaged(rows, conv_col, turn_col, role_col, text_col).withColumns({
        "digest": F.unhex(F.md5("text")), "blank": ~F.col("text").rlike(_BLANK), "ended": F.col("text").rlike(_ENDED)}))
    chunks = durable(chunked(durable(faulty(texts)), chunk))
    tables = durable(suffix_tables(chunks.select("sig").distinct()))
    repaired = durable(folded(chunks, tables))
    hashes = hashed(repaired_rows(chunks, repaired, texts))
    known = rows.groupBy(key_of(F.col(conv_col)).alias("key")).agg(F.first(conv_col).alias(conv_col))
    nothing = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(repaired.drop("pieces"), "key", "left").join(hashes, "key", "left").select(
        conv_col, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
