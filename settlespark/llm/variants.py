"""Spelling variants: words one edit apart, found by probing Bloom filters of the vocabulary.

Every word generates its edits as hashes. The hashes are probed against blocked Bloom filters,
one for each word length, which tasks get as a broadcast of bounded size; a vocabulary beyond the
bound is probed in several passes. Only positives are shuffled, as narrow rows, to an exact join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import batches_of, column_texts
from settlespark.session import durable

RUN = re.compile("[a-zÀ-ÿ]{5,}")
LEAST_LENGTH, LEAST_COUNT, DAMAGE = 5, 3, 97
PASS_BYTES = 32 << 20  # of filters in one broadcast
KEY_BITS = 16  # of a filter for each word in it
PIECE = 1 << 16  # blocks of 8 bytes that are assembled together
STEP = 1 << 20  # edits hashed at a time
HELD = 300_000  # words counted by a task before it hands them on

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_BACK = pow(_BASE, -1, 1 << 64)


def run_counts(texts: list[str], ids: list[str], counts: Counter) -> None:
    """Add the words of texts to ``counts``, damaged ones without the deleted letter."""
    for key, text in zip(ids, texts):
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        start = zlib.crc32(f"{key}:".encode())
        for run, n in Counter(RUN.findall(lowered)).items():
            h = zlib.crc32(run.encode(), start)
            if h % DAMAGE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < LEAST_LENGTH:
                    continue
            counts[run] += n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h, length, word, n)`` of all words of at least ``LEAST_COUNT`` occurrences; h is the word's hash."""
    def run(batches):
        counts: Counter = Counter()

        def handed():
            words = sorted(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids, texts = [x or "" for x in batch.column(0).to_pylist()], column_texts(batch.column(1))
            for a, b in batches_of(texts):
                run_counts(texts[a:b], ids[a:b], counts)
                if len(counts) > HELD:
                    yield handed()
        yield handed()

    def hashed(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = np.zeros(len(words), np.uint64)
            for places, letters in by_length(words):
                hashes[places] = total_hash(letters)
            lengths = pa.array([len(w) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), lengths, batch.column(0), batch.column(1)], names=["h", "length", "word", "n"])

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    kept = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return durable(kept.mapInArrow(hashed, "h bigint, length int, word string, n bigint"))


# --- hashes of words and of their edits -----------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_LETTER = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def by_length(words: list[str]):
    """Places of the words of each length, with their letters as a matrix of code points, all below 256."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        raw = b"".join(words[i].encode("latin-1") for i in places)
        yield np.array(places), np.frombuffer(raw, np.uint8).reshape(len(places), length)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _terms(letters: np.ndarray) -> np.ndarray:
    return _LETTER[letters] * _powers(letters.shape[1])


def total_hash(letters: np.ndarray) -> np.ndarray:
    """Sum of a letter's number times a power of its place, modulo 2^64: an edit changes it in closed form."""
    return _terms(letters).sum(axis=1, dtype=np.uint64)


def deletions(letters: np.ndarray):
    """``(row, place, hash)`` of each distinct word with one letter less; of a run of equal letters only the first goes."""
    terms = _terms(letters)
    total, width = terms.sum(axis=1, dtype=np.uint64), max(1, STEP // len(letters))
    before = np.zeros(len(letters), np.uint64)
    for low in range(0, letters.shape[1], width):
        part = terms[:, low:low + width]
        upto = before[:, None] + np.cumsum(part, axis=1, dtype=np.uint64)
        hashes = (upto - part) + (total[:, None] - upto) * np.uint64(_BACK)
        before = upto[:, -1]
        fresh = np.ones(part.shape, bool)
        known = letters[:, max(0, low - 1):low + width]
        fresh[:, 0 if low else 1:] = known[:, 1:] != known[:, :-1]
        rows, places = np.nonzero(fresh)
        yield rows, places + low, hashes[rows, places]


def substitutions(letters: np.ndarray, alphabet: np.ndarray):
    """``(row, place, letter, hash)`` of each word with one letter replaced by a greater one; the pair's other word meets it there."""
    total, powers = total_hash(letters), _powers(letters.shape[1])
    width = max(1, STEP // (len(letters) * len(alphabet)))
    for low in range(0, letters.shape[1], width):
        part = letters[:, low:low + width]
        rows, places, nth = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        new, old = _LETTER[alphabet[nth]], _LETTER[part[rows, places]]
        yield rows, places + low, alphabet[nth], total[rows] + (new - old) * powers[places + low]


# --- blocked Bloom filters -------------------------------------------------------------------------


def blocks_of(words: int) -> int:
    """Blocks of 64 bits in the filter of so many words."""
    return max(1, -(-words * KEY_BITS // 64))


def block_and_mask(hashes: np.ndarray, blocks: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of its length that a hash belongs to, its block there and the four bits it sets."""
    x = _mixed(hashes)
    block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    one, six = np.uint64(1), np.uint64(63)
    mask = (one << (x & six)) | (one << ((x >> np.uint64(6)) & six)) | (one << ((x >> np.uint64(12)) & six)) | (one << ((x >> np.uint64(18)) & six))
    return _mixed(x) % np.uint64(parts), block, mask


def passes(sizes: dict[int, int], limit: int = PASS_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """Filters ``(length, part, parts, blocks)``, dealt into passes of at most ``limit`` bytes each."""
    out: list[list[tuple[int, int, int, int]]] = [[]]
    room = limit
    for length, words in sorted(sizes.items()):
        parts = -(-8 * blocks_of(words) // limit)
        blocks = min(blocks_of(-(-words // parts)), limit // 8)
        for part in range(parts):
            if 8 * blocks > room:
                out.append([])
                room = limit
            out[-1].append((length, part, parts, blocks))
            room -= 8 * blocks
    return [x for x in out if x]


def built_filters(vocab: DataFrame, shards: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one pass by (length, part). Their total size is what ``passes`` allowed."""
    wanted = {length: (parts, blocks) for length, _, parts, blocks in shards}
    held = {(length, part) for length, part, _, _ in shards}

    def run(batches):
        for batch in batches:
            lengths, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for length in np.unique(lengths):
                parts, blocks = wanted[int(length)]
                part, block, mask = block_and_mask(hashes[lengths == length], blocks, parts)
                keep = np.isin(part, [p for n, p in held if n == length])
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length, np.int32)), pa.array(part[keep].astype(np.int32)), pa.array(block[keep].astype(np.int64)),
                                                  pa.array(mask[keep].view(np.int64))], names=["length", "part", "block", "mask"])

    def piece(pdf):
        first = int(pdf["block"].iloc[0]) // PIECE
        out = np.zeros(PIECE, np.int64)
        out[pdf["block"].to_numpy() - first * PIECE] = pdf["mask"].to_numpy()
        return pdf[["length", "part"]].head(1).assign(piece=first, bits=out.tobytes())

    keys = vocab.where(F.col("length").isin(list(wanted))).select("length", "h").mapInArrow(run, "length int, part int, block bigint, mask bigint")
    merged = keys.groupBy("length", "part", "block").agg(F.bit_or("mask").alias("mask"))
    pieces = merged.groupBy("length", "part", (F.col("block") / PIECE).cast("int").alias("p")).applyInPandas(
        lambda pdf: piece(pdf), "length int, part int, piece bigint, bits binary")
    out = {(length, part): np.zeros(blocks, np.uint64) for length, part, _, blocks in shards}
    for row in pieces.toLocalIterator():
        own = out[row.length, row.part]
        low = row.piece * PIECE
        own[low:low + PIECE] = np.frombuffer(row.bits, np.uint64)[:len(own) - low]
    return out


def probed(vocab: DataFrame, shards: list[tuple[int, int, int, int]], alphabet: bytes) -> DataFrame:
    """``(a, edit, place, letter)``: edits of a word, by hash, that a filter of this pass may hold; letter 0 is a deletion."""
    wanted = {length: (parts, blocks) for length, _, parts, blocks in shards}
    shared = vocab.sparkSession.sparkContext.broadcast(built_filters(vocab, shards))

    def run(batches):
        filters, letters_known = shared.value, np.frombuffer(alphabet, np.uint8)

        def positive(length, hashes):
            parts, blocks = wanted[length]
            part, block, mask = block_and_mask(hashes, blocks, parts)
            hit = np.zeros(len(hashes), bool)
            for p in range(parts):
                own = filters.get((length, p))
                if own is not None:
                    at = part == np.uint64(p) if parts > 1 else slice(None)
                    hit[at] = (own[block[at]] & mask[at]) == mask[at]
            return hit

        def rows(own, places, letters, hashes):
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(places.astype(np.int32)),
                                               pa.array(letters.astype(np.int16))], names=["a", "edit", "place", "letter"])

        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, all_letters in by_length(words):
                length = all_letters.shape[1]
                count = max(1, STEP // (length * len(alphabet)))
                for low in range(0, len(all_letters), count):
                    letters = all_letters[low:low + count]
                    own = total_hash(letters)
                    if length - 1 in wanted:
                        for row, place, hashes in deletions(letters):
                            hit = positive(length - 1, hashes)
                            yield rows(own[row[hit]], place[hit], np.zeros(int(hit.sum())), hashes[hit])
                    if length in wanted:
                        for row, place, new, hashes in substitutions(letters, letters_known):
                            hit = positive(length, hashes)
                            yield rows(own[row[hit]], place[hit], new[hit], hashes[hit])

    near = sorted({n for length in wanted for n in (length, length + 1)})
    return vocab.where(F.col("length").isin(near)).select("word").mapInArrow(run, "a bigint, edit bigint, place int, letter smallint")


def near_pairs(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(a, n_a, b, n_b)``: each pair of words that differ by one edit, once."""
    sizes = {r["length"]: r["count"] for r in vocab.groupBy("length").count().collect()}

    def letters(batches):
        for batch in batches:
            found = sorted(set(b"".join(w.encode("latin-1") for w in batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int16())], names=["letter"])

    alphabet = bytes(sorted(r.letter for r in vocab.select("word").mapInArrow(letters, "letter smallint").distinct().collect()))  # 90 letters at most
    found = None
    for shards in passes(sizes, pass_bytes):
        part = durable(probed(vocab, shards, alphabet))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vocab.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).limit(0)
    ends = vocab.select(F.col("h").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    starts = vocab.select(F.col("h").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    met = found.join(ends, "edit").join(starts, "a")
    rest = F.expr("substring(word_a, place + 2)")
    # char() gives the code point of one byte, which is what all letters are
    edited = F.concat(F.expr("substring(word_a, 1, place)"), F.when(F.col("letter") > 0, F.expr("char(letter)")).otherwise(F.lit("")), rest)
    return met.where(edited == F.col("b")).select(F.col("word_a").alias("a"), "n_a", "b", "n_b")


def followed(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the rows ``(word, form)``: forms are followed to the last, in steps that double."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = durable(at.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: every word with its more common spelling and the last of its chain.

    Words are maximal runs of Latin letters, A-Z lower-cased, of at least five letters and three
    occurrences in the whole table; a run whose checksum with the document's id is divisible by
    97 counts without one letter. Two words are near if one letter inserted, deleted or replaced
    turns one into the other. The form is the near word with the most occurrences, of ties the
    least, if it has at least twice as many; the root follows forms to the last.

    A null text has no words, a null id counts as an empty one, repeated rows count each, and
    other columns are not read. An empty table gives no rows. A word of any length is handled: its
    edits are hashed in closed form, in steps, and only matches are spelt out.
    """
    vocab = vocabulary(docs, id_col, text_col)
    pairs = durable(near_pairs(vocab, pass_bytes))
    ways = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = ways.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    above = -F.col("best.less") >= 2 * F.col("n")
    known = durable(best.select("word", "n_near", F.when(above, F.col("best.near")).alias("form"), F.when(above, -F.col("best.less")).alias("form_n")))
    roots = followed(known.where("form IS NOT NULL"))
    return vocab.select("word", "n").join(known, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
