"""Text quality by support vectors on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import column_texts, held_out, labelled
from settlespark.llm.toxicity import fit_logistic
from settlespark.session import durable

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS = 18  # of the hashed feature space; the last place is the constant


def _shape(token: str) -> str:
    """Capitals, title case, lower case or digits; a run of signs stands for itself, up to three of them."""
    if token[0].isdigit():
        return "d"
    if not token[0].isalpha():
        return token[:3]
    return "U" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "l"


def indicators(text: str, shapes: dict[str, str]) -> np.ndarray:
    """Hashed features that occur in the text, sorted, each once.

    Lower-cased words, numbers and runs of signs; pairs of neighbouring shapes; tenths of the
    word triples that occurred before and of the words that repeat the one before. An empty
    text has none. ``shapes`` remembers shapes between calls.
    """
    tokens = TOKEN.findall(text)
    kinds = [shapes.get(t) for t in tokens]
    for i, kind in enumerate(kinds):
        if kind is None:
            if len(shapes) > 500_000:
                shapes.clear()
            kinds[i] = shapes[tokens[i]] = _shape(tokens[i])
    found = {t.lower() for t in set(tokens)}
    found.update(f"{a} {b}" for a, b in set(zip(kinds, kinds[1:])))
    words = text.split()
    n = len(words)
    if n > 2:
        found.add(f"triples {10 * (n - 2 - len(set(zip(words, words[1:], words[2:])))) // (n - 2)}")
        found.add(f"again {10 * sum(map(eq, words, words[1:])) // (n - 1)}")
    mask = (1 << BITS) - 2
    return np.unique(np.fromiter((zlib.crc32(f.encode("utf-8", "surrogatepass")) % mask for f in found), np.int32, len(found)))


def encoded(rows: DataFrame, seed: int = 11) -> DataFrame:
    """``(label, ids, draw)`` of ``(text, label)`` rows in the shared folder; ``draw`` is a hash of the text from 0 to 1."""
    def run(batches):
        shapes: dict[str, str] = {}
        for batch in batches:
            texts = column_texts(batch.column(0))
            draws = [zlib.crc32(t.encode("utf-8", "surrogatepass"), seed) / 2 ** 32 for t in texts]
            ids = pa.array([indicators(t, shapes) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), ids, pa.array(draws, pa.float64())], names=["label", "ids", "draw"])

    return durable(rows.select("text", "label").mapInArrow(run, "label int, ids array<int>, draw double"))


def log_count_ratios(rows: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """For each place, the log of the share of label-1 texts with it over that of label-0 texts, over all rows.

    Smoothing adds ``alpha`` texts in the proportion of the labels, so an unseen place has ratio 0.
    """
    n1, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    counts = rows.select(F.explode("ids").alias("id"), "label").groupBy("id").agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).toPandas()
    one, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    one[counts["id"]], every[counts["id"]] = counts["n1"], counts["n"]
    n0 = n - n1
    return np.log((one + alpha * n1 / n) / n1) - np.log((every - one + alpha * n0 / n) / n0)


def scaled(ids: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Values of the indicators: their ratios, to unit length."""
    x = ratios[ids]
    size = float(np.sqrt(x @ x))
    return x / size if size > 0 else x


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the linear hinge-loss machine, the constant's in the last place, and the dual variables.

    One dual variable at a time takes its exact minimum, kept between 0 and the cost of its row,
    and moves the weights with it. Labels are 0 or 1; each class weighs half.
    """
    w = np.zeros(1 << BITS)
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())]) * 2 / len(y)
    most = cost / share[(y > 0).astype(int)]
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    norms = np.array([x @ x + 1 for _, x in rows])
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            ids, x = rows[i]
            gradient = y[i] * (w[ids] @ x + w[-1]) - 1
            new = min(most[i], max(0.0, alpha[i] - gradient / norms[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * x
                w[-1] += step
                alpha[i] = new
    return w, alpha


@dataclass
class Judge:
    """Ratios, weights, and the logistic from a margin to a score."""

    ratios: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids] @ scaled(ids, self.ratios) + self.weights[-1])

    def scores(self, texts: list[str], shapes: dict[str, str]) -> list[float]:
        a, b = self.calibration
        return [1 / (1 + float(np.exp(-np.clip(a + b * self.margin(indicators(t, shapes)), -30, 30)))) for t in texts]


def fit(rows: DataFrame, fit_rows: int = 16_000, check_rows: int = 8_000) -> Judge:
    """A judge from ``(text, label)`` rows.

    Ratios count all rows. The machine is fitted on about ``fit_rows`` rows and its scores on
    about ``check_rows`` others, both drawn by a hash of the text. With one label only, every
    score is that label's smoothed share.
    """
    codes = encoded(rows)
    sizes = {r.label: r["count"] for r in codes.groupBy("label").count().collect()}
    total, ones = sum(sizes.values()), sizes.get(1, 0)
    if not ones or ones == total:
        share = (ones + 0.5) / (total + 1)
        return Judge(np.zeros(1 << BITS), np.zeros(1 << BITS), np.array([np.log(share / (1 - share)), 0.0]))
    ratios = log_count_ratios(codes)
    rate = min(0.7, fit_rows / total)
    train = codes.where(F.col("draw") < rate).select("label", "ids").toPandas()
    check = codes.where((F.col("draw") >= rate) & (F.col("draw") < rate + min(1 - rate, check_rows / total))).select("label", "ids").toPandas()
    weights, _ = dual_coordinate_descent([(ids, scaled(ids, ratios)) for ids in train["ids"]], train["label"].to_numpy(float))
    judge = Judge(ratios, weights, np.array([0.0, 3.0]))
    if check["label"].nunique() == 2:
        margins = np.array([[judge.margin(ids)] for ids in check["ids"]])
        judge.calibration = fit_logistic(margins, check["label"].to_numpy(float), ridge=0.1)
    return judge


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document.

    Learns from rows outside the held-out quarter. A null text counts as empty; an empty text
    has no indicators and gets the score of the constant; repeated rows score alike.
    """
    out = held_out(F.col(id_col), 4, 2)
    judge = fit(labelled(docs, labels, "quality", ~out, id_col, text_col))
    parts = (judge.ratios.astype(np.float32), judge.weights.astype(np.float32), judge.calibration)  # sizes are fixed by BITS
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    shapes: dict[str, str] = {}

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(Judge(*shared.value).scores([t or "" for t in texts], shapes), dtype=float)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    score = F.pandas_udf("double")(run)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
