"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import batches_of, column_texts, held_out, labelled
from settlespark.session import durable

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 256  # words of a training sequence
PREFIXES = (4, 5)


def features(word: str) -> list[str]:
    """The lower-cased word and its prefixes, each with a mark of its kind."""
    low = word.lower()
    return [f"w{low}", *(f"{n}{low[:n]}" for n in PREFIXES if len(low) > n)]


# --- the chain: odds of state 1 against state 0 --------------------------------------------


@dataclass
class Chain:
    """Weights of the chain. Potentials of state 0 are 1; ``moves`` are the log weights of 0-1, 1-0 and 1-1."""

    bias: float = -3.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))


def messages(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray):
    """Forward and backward odds of rows of ``emission``, which are sorted by falling length."""
    up, down, stay = np.exp(moves)
    e = np.exp(np.clip(emission, -30, 30))
    rows, width = e.shape
    active = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows longer than each place
    ahead, behind = e.copy(), np.ones_like(e)
    for t in range(1, width):
        n = active[t]
        r = ahead[:n, t - 1]
        ahead[:n, t] *= (up + r * stay) / (1 + r * down)
    for t in range(width - 2, -1, -1):
        n = active[t + 1]
        x = e[:n, t + 1] * behind[:n, t + 1]
        behind[:n, t] = (down + stay * x) / (1 + up * x)
    return ahead, behind, e


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as one matrix, ragged ends at a very low weight, and their lengths."""
    lengths = np.array([len(r) for r in rows])
    matrix = np.full((len(rows), max(1, lengths.max(initial=0))), -30.0)
    for i, r in enumerate(rows):
        matrix[i, :len(r)] = r
    return matrix, lengths


def marginals(sequences: list[np.ndarray], moves: np.ndarray, cells: int = 1_000_000) -> list[np.ndarray]:
    """Probability of state 1 at each place of each emission sequence, in blocks of bounded size."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    out: list = [np.zeros(0)] * len(sequences)
    at = 0
    while at < len(order) and len(sequences[order[at]]):
        block = order[at:at + max(1, cells // len(sequences[order[at]]))]
        block = [i for i in block if len(sequences[i])]
        matrix, lengths = padded([sequences[i] for i in block])
        ahead, behind, _ = messages(matrix, lengths, moves)
        odds = ahead * behind
        p = odds / (1 + odds)
        for k, i in enumerate(block):
            out[i] = p[k, :lengths[k]]
        at += len(block)
    return out


def fit_chain(ids: list[np.ndarray], tags: list[np.ndarray], n_features: int, steps: int = 60, ridge: float = 0.02, rate: float = 0.3,
              block: int = 1024):
    """Weights, bias and moves that make the tags likely, by Adam on the exact gradient.

    ``ids`` holds for each sequence an array of shape (length, features of a word) of feature
    numbers; number 0 stands for none. Sequences pass in blocks, so memory stays that of a block.
    """
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    blocks = []
    for k in range(0, len(order), block):
        part = order[k:k + block]
        lengths = np.array([len(ids[i]) for i in part])
        real = np.arange(int(lengths[0])) < lengths[:, None]
        blocks.append((lengths, real, np.concatenate([ids[i] for i in part]), np.concatenate([tags[i] for i in part]).astype(float)))
    params = np.concatenate([np.zeros(n_features), [-3.0], np.zeros(3)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    total = sum(len(b[3]) for b in blocks)
    for step in range(1, steps + 1):
        grad = -ridge * params
        for b in blocks:
            _add_gradient(grad, params, n_features, *b)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        params = params + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6 * total)
    params[0] = 0
    return params[:n_features], params[n_features], params[-3:]


def _add_gradient(grad: np.ndarray, params: np.ndarray, n_features: int, lengths: np.ndarray, real: np.ndarray, flat: np.ndarray, tags: np.ndarray) -> None:
    """Adds the log-likelihood's gradient of one block: true counts less expected ones."""
    w = params[:n_features].copy()
    w[0] = 0
    truth, emission = np.zeros(real.shape), np.full(real.shape, -30.0)
    truth[real] = tags
    emission[real] = params[n_features] + w[flat].sum(axis=1)
    ahead, behind, e = messages(emission, lengths, params[-3:])
    odds = ahead * behind
    gap = (truth - odds / (1 + odds))[real]
    for c in range(flat.shape[1]):
        grad[:n_features] += np.bincount(flat[:, c], weights=gap, minlength=n_features)
    grad[n_features] += gap.sum()
    # joint of neighbours, over the pairs of states, from the messages on either side
    up, down, stay = np.exp(params[-3:])
    r, x, both = ahead[:, :-1], e[:, 1:] * behind[:, 1:], real[:, 1:]
    z = 1 + up * x + r * down + r * stay * x
    before, after = truth[:, :-1], truth[:, 1:]
    true = ((1 - before) * after, before * (1 - after), before * after)
    for k, (t, q) in enumerate(zip(true, (up * x, r * down, r * stay * x))):
        grad[n_features + 1 + k] += ((t - q / z) * both).sum()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Intercept and slopes of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ beta
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta = beta + change * min(1.0, 5 / max(1e-9, np.abs(change).max()))
    return beta


# --- the operator ---------------------------------------------------------------------------


@dataclass
class Tagger:
    """Weights by feature, chain and the logistic that turns marginals into a document's score."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emissions(self, words: list[str], seen: dict[str, float]) -> np.ndarray:
        get = seen.get
        out = [get(w) for w in words]
        if None in out:
            for i, e in enumerate(out):
                if e is None:
                    w = words[i]
                    if w not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
                    out[i] = seen.get(w, self.bias) if w in seen else self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
        return np.array(out, float)

    def measures(self, texts: list[str], seen: dict[str, float], spans: bool = True):
        """For each text: the largest marginal, log of one plus their sum, their mean, and spans of words likelier toxic."""
        for low, high in batches_of(texts):
            part = texts[low:high]
            found = marginals([self.emissions(WORD.findall(t), seen) for t in part], self.moves)
            for text, p in zip(part, found):
                if not len(p):
                    yield 0.0, 0.0, 0.0, []
                    continue
                most, total, hit = float(p.max()), float(p.sum()), []
                if spans and most >= 0.5:
                    hit = [m.span() for m, q in zip(WORD.finditer(text), p) if q >= 0.5]
                yield most, float(np.log1p(total)), total / len(p), hit


def _counts(rows: DataFrame, only: dict | None = None) -> DataFrame:
    """``(feature, n)``: in how many texts a feature occurs, of those in ``only`` if given."""
    def run(batches):
        from collections import Counter

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in column_texts(batch.column(0)):
                found = {f for w in set(WORD.findall(text)) for f in features(w)}
                seen.update(found if only is None else found & only.keys())
                if len(seen) > 300_000:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    return rows.select("text").mapInArrow(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _one_of_copies(rows: DataFrame, size: int = 3) -> DataFrame:
    """``rows`` with one text for each set of its ``size`` least word hashes, which near copies mostly share and others hardly."""
    def least(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = {w.lower() for w in set(WORD.findall(t or ""))}
            few = heapq.nsmallest(size, (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words))
            out.append(zlib.crc32(np.array(few, np.int64).tobytes()))
        return pd.Series(out, dtype="int64")

    least.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    sketch = F.pandas_udf("bigint")(least)("text")
    return rows.groupBy(sketch.alias("sketch")).agg(F.min("text").alias("text")).select("text")


def _windows(rows: DataFrame, rates: tuple[float, float], seed: int, number: dict[str, int], evidence: set[str]) -> DataFrame:
    """``(ids, tags)``: windows of the texts, drawn by hash at the rate of their label.

    ``ids`` has the feature numbers of every word, as many for each, 0 where there is none;
    ``tags`` is 1 for the words of toxic texts that have a feature of the ``evidence``.
    """
    width = 1 + len(PREFIXES)

    def run(batches):
        for batch in batches:
            ids, tags = [], []
            for text, label in zip(column_texts(batch.column(0)), batch.column(1).to_pylist()):
                base = zlib.crc32(text.encode("utf-8", "surrogatepass"), seed)
                found = WORD.findall(text)
                for i in range(0, len(found), WINDOW):
                    if zlib.crc32(i.to_bytes(8, "little"), base) < rates[label] * 2 ** 32:
                        names = [features(w) for w in found[i:i + WINDOW]]
                        ids.append([n for fs in names for n in [number.get(f, 0) for f in fs] + [0] * (width - len(fs))])
                        tags.append([int(label and not evidence.isdisjoint(fs)) for fs in names])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int8()))], names=["ids", "tags"])

    return rows.mapInArrow(run, "ids array<int>, tags array<tinyint>")


def fit(rows: DataFrame, support: float = 0.01, ratio: float = 20.0, fit_windows: int = 3000, fit_rows: int = 20_000, seed: int = 7) -> Tagger:
    """A tagger from ``(text, label)`` rows, label 1 for toxic texts.

    Words are labelled first: a word of a toxic text is toxic where it, or a prefix, occurs in
    at least ``support`` of all toxic texts and ``ratio`` times as often as in the others; other
    words are not. Of toxic texts that are near copies one counts, else the words that make a
    copied text peculiar would pass for toxic. Those counts cover all rows. What ``support``
    leaves is at most the features of a mean text over ``support``, however many texts there are. The chain is then
    fitted on about ``fit_windows`` windows of words of each label, and its score on about
    ``fit_rows`` rows; both are drawn by hash and bound the fit, not the counts. Without toxic
    texts, or without others, every score is the share of toxic ones.
    """
    sizes = {r.label: (r.n, r.chars) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") / 5 / WINDOW + 1).alias("chars")).collect()}
    n1, n0 = sizes.get(1, (0, 0))[0], sizes.get(0, (0, 0))[0]
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Tagger({}, -30.0, np.zeros(3), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    own = durable(_one_of_copies(rows.where("label = 1")))
    n1 = own.count()
    least = max(min(5, n1), support * n1)
    toxic = {r.feature: r.n for r in _counts(own).where(F.col("n") >= least).toLocalIterator()}
    clean = {r.feature: r.n for r in _counts(rows.where("label = 0"), toxic).toLocalIterator()}
    evidence = {f for f, n in toxic.items() if n / n1 >= ratio * (clean.get(f, 0) + 0.5) / n0}
    number = {f: i for i, f in enumerate(sorted(toxic), 1)}

    rates = tuple(min(1.0, fit_windows / max(1.0, sizes[k][1])) for k in (0, 1))
    sample = _windows(rows, rates, seed, number, evidence).toArrow()
    ids = [np.asarray(x.values).reshape(-1, 1 + len(PREFIXES)) for x in sample.column("ids")]
    tags = [np.asarray(x.values) for x in sample.column("tags")]
    del sample
    if not ids:
        return fit(rows.limit(0))
    weights, bias, moves = fit_chain(ids, tags, len(number) + 1)
    tagger = Tagger({f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-9}, float(bias), moves)

    drawn = rows.where(F.abs(F.xxhash64("text", F.lit(seed)) % 1_000_000) < int(1e6 * min(1.0, fit_rows / (n0 + sizes[1][0]))))
    del ids, tags
    points = drawn.select(_measure(tagger)("text").alias("m"), "label").select("m.*", "label").toPandas()
    if points["label"].nunique() == 2:
        tagger.calibration = fit_logistic(points[["most", "total", "mean"]].to_numpy(float), points["label"].to_numpy(float))
    else:
        tagger.calibration = np.array([-4.0, 8.0, 0.0, 0.0])
    pa.default_memory_pool().release_unused()
    return tagger


def _measure(tagger: Tagger):
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = tagger.measures([t or "" for t in texts], {}, False)
        return pd.DataFrame([r[:3] for r in rows], columns=["most", "total", "mean"])

    return F.pandas_udf("most double, total double, mean double")(_typed(run))


def _typed(run):
    """``run`` with its annotations as types, which Spark reads, not as the texts they are here."""
    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return run


def verdict(tagger: Tagger):
    """A column function of a text: its score and the spans of toxic words, as code point offsets, end exclusive.

    A null or empty text has no words; its score is the logistic's intercept.
    """
    shared: dict = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        beta, out = tagger.calibration, []
        for most, total, mean, spans in tagger.measures([t or "" for t in texts], shared):
            z = beta[0] + beta[1] * most + beta[2] * total + beta[3] * mean
            out.append((1 / (1 + np.exp(-np.clip(z, -30, 30))), [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["score", "spans"])

    return F.pandas_udf("score double, spans array<struct<start:int,end:int>>")(_typed(run))


def tagger_for(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger from labelled rows outside the held-out fifth."""
    return fit(labelled(docs, labels, "toxic", ~held_out(F.col(id_col), 5, 0), id_col, text_col))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)``, one row per document. Repeated rows are scored alike."""
    judge = verdict(tagger_for(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 5, 0).alias("held_out"), judge(F.col(text_col)).alias("v"))
    return rows.select("doc_id", "held_out", "v.score", (F.col("v.score") >= 0.5).cast("int").alias("predicted"), "v.spans")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns and rows of ``docs`` that score below ``threshold``."""
    judge = verdict(tagger_for(docs, labels, id_col, text_col))
    return docs.where(judge(F.col(text_col))["score"] < threshold)
