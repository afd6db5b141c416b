"""Gradient boosting of many models on one table, side by side.

All models of all groups (say the folds of each target) share rows that are binned once. A level of
all their trees is one Spark job: tasks add up histograms of (model, node, feature, bin), a shuffle by
model sums them, and only the chosen splits come to the driver. So the number of jobs is that of
one model, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from settlespark.errors import GuardError
from settlespark.session import durable

BINS = 32
BLOCK_ROWS = 4096
MARGINS_EVERY = 10  # rounds after which the margins of all rows are written; trees since then are evaluated anew
PARAMS = {"maxIter": 60, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.85, "seed": 42}


@dataclass
class Ensemble:
    """Trees of one model over binned features. A tree is complete: a node's children are 2i+1 and 2i+2.

    A row goes left where its bin is at most the node's cut; a null value counts as the largest.
    """

    edges: list[list[float]]
    base: float = 0.0
    features: list[list[int]] = field(default_factory=list)
    cuts: list[list[int]] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)
    loss: str = "squared"

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from ``first`` on, without the base."""
        out, rows = np.zeros(len(bins)), np.arange(len(bins))
        for f, c, v in zip(self.features[first:], self.cuts[first:], self.leaves[first:]):
            out += np.asarray(v)[leaf_of(np.asarray(f), np.asarray(c), bins, rows)]
        return out

    def predict(self, values: np.ndarray) -> np.ndarray:
        """The target, or for the log loss its probability."""
        x = self.base + self.margin(binned(values, self.edges))
        return x if self.loss == "squared" else 1.0 / (1.0 + np.exp(-x))

    def facts(self) -> dict:
        return vars(self)


def binned(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of a matrix of features: how many edges lie below a value."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(e, float), values[:, j], "left")
    return out


def leaf_of(features: np.ndarray, cuts: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place of each row below the given complete levels of nodes."""
    at = np.zeros(len(rows), np.int64)
    for _ in range(int(len(features) + 1).bit_length() - 1):
        at = 2 * at + 1 + (bins[rows, features[at]] > cuts[at])
    return at - len(features)


def sampled(block: int, turn: int, rows: int, rate: float, seed: int) -> np.ndarray:
    """Rows of a block that a round uses: drawn by hash, so that a task that runs again draws the same."""
    if rate >= 1:
        return np.ones(rows, bool)
    mix, step = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
    start = np.array([(block * 1_000_003 + turn * 7_919 + seed) % 2**64], np.uint64) * step
    x = (np.arange(rows, dtype=np.uint64) + start) * mix
    x = (x ^ (x >> np.uint64(31))) * step
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < rate


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of histograms ``[node, feature, bin, (gradient, weight)]``: feature, cut and the sums left and right of it, by node.

    A node that no split improves sends all its rows to the left.
    """
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[..., 0] ** 2 / total[..., 1]
    gain = np.where((left[..., 1] > 1e-9) & (right[..., 1] > 1e-9), gain, -np.inf)
    flat = gain.reshape(len(hist), -1)
    nodes, at = np.arange(len(hist)), flat.argmax(axis=1)
    feature, cut = at // hist.shape[2], at % hist.shape[2]
    none = ~(flat[nodes, at] > 1e-12)
    feature[none], cut[none] = 0, 255
    a = np.where(none[:, None], total[:, 0, 0], left[nodes, feature, np.minimum(cut, hist.shape[2] - 1)])
    return feature, cut, a, np.where(none[:, None], 0.0, total[nodes, feature, 0] - a)


def feature_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Upper bounds of all bins but the last, at even shares of each feature; one scan."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(x) for x in (found[i] or [])}) for i in range(len(features))]


def _blocks(rows: DataFrame, features: Sequence[str], edges, models: int, group: str, label: str, use: str) -> DataFrame:
    """Rows of a group packed into blocks: bins, labels, and the models each row trains."""
    def run(batches):
        held: dict = {}

        def closed(name):
            parts = held.pop(name)
            bins, labels, uses = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([len(labels)], pa.int32()), pa.array([bins.tobytes()], pa.binary()),
                                               pa.array([labels.tobytes()], pa.binary()), pa.array([uses.tobytes()], pa.binary())], names=["model_group", "n", "bins", "labels", "uses"])

        for batch in batches:
            pdf = batch.to_pandas()
            bins = binned(pdf[list(features)].to_numpy(float), edges)
            uses = np.array(pdf["_uses"].tolist(), bool).reshape(len(pdf), models)
            labels = pdf["_label"].to_numpy(float)
            for name, at in pdf.groupby("model_group").indices.items():
                held.setdefault(name, []).append((bins[at], labels[at], uses[at]))
                if sum(len(p[1]) for p in held[name]) >= BLOCK_ROWS:
                    yield closed(name)
        for name in list(held):
            yield closed(name)

    packed = rows.select(F.col(group).cast("string").alias("model_group"), *[F.col(f).cast("double").alias(f) for f in features],
                         F.col(label).cast("double").alias("_label"), F.col(use).alias("_uses"))
    blocks = packed.mapInArrow(run, "model_group string, n int, bins binary, labels binary, uses binary")
    return blocks.withColumns({"block": F.monotonically_increasing_id(), "margins": F.lit(None).cast("binary")})


def boost(rows: DataFrame, features: Sequence[str], models: int, group: str = "model_group", label: str = "label", use: str = "use",
          params: dict | None = None, loss: dict[str, str] | None = None) -> dict[tuple[str, int], Ensemble]:
    """Train ``models`` ensembles for every group of ``rows``: ``(group, number) -> Ensemble``.

    ``use`` is an array of booleans that says which models a row trains; ``label`` must not be null.
    ``loss`` names groups with the log loss of a 0/1 label. Null features are allowed. A model that no row
    trains is an error. Rounds, depth, step, sampling rate and seed come from ``params``; the first
    tree of a squared loss takes a whole step.
    """
    p = PARAMS | (params or {})
    features, loss = list(features), loss or {}
    edges = feature_edges(rows, features)
    blocks = durable(_blocks(rows, features, edges, models, group, label, use))
    held = _held(blocks)
    width, depth = len(features), p["maxDepth"]

    def matrices(block):
        n = block["n"]
        bins = np.frombuffer(block["bins"], np.uint8).reshape(n, width)
        uses = np.frombuffer(block["uses"], bool).reshape(n, models)
        margins = np.zeros((n, models)) if block["margins"] is None else np.frombuffer(block["margins"]).reshape(n, models)
        return bins, np.frombuffer(block["labels"]), uses, margins

    def totals(batches):
        found: dict = {}
        for batch in batches:
            for block in batch.to_pylist():
                _, labels, uses, _ = matrices(block)
                for m in range(models):
                    own = found.setdefault((block["model_group"], m), np.zeros(2))
                    own += labels[uses[:, m]].sum(), uses[:, m].sum()
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(g, m, *s) for (g, m), s in found.items()], columns=["g", "m", "s", "n"]).astype({"m": "int32"}), preserve_index=False)

    out: dict[tuple[str, int], Ensemble] = {}
    for r in blocks.mapInArrow(totals, "g string, m int, s double, n double").groupBy("g", "m").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        if not r.n:
            raise GuardError(f"no rows to train model {r.m} of {r.g}")
        kind, mean = loss.get(r.g, "squared"), r.s / r.n
        if kind == "log":
            mean = float(np.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6))))
        out[r.g, r.m] = Ensemble(edges, mean, loss=kind)
    if not out:
        raise GuardError("no rows to train on")

    written = 0
    for turn in range(p["maxIter"]):
        open_nodes = {key: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for key in out}
        for level in range(depth):
            splits = _level(held, matrices, out, open_nodes, written, turn, level, p)
            for key, (feature, cut, a, b) in splits.items():
                f, c = open_nodes[key]
                open_nodes[key] = np.concatenate([f, feature]), np.concatenate([c, cut])
                if level == depth - 1:
                    sums = np.stack([a, b], axis=1).reshape(-1, 2)
                    value = np.divide(sums[:, 0], sums[:, 1], out=np.zeros(len(sums)), where=sums[:, 1] > 1e-9)
                    out[key].features.append(open_nodes[key][0].tolist())
                    out[key].cuts.append(open_nodes[key][1].tolist())
                    step = 1.0 if turn == 0 and out[key].loss == "squared" else p["stepSize"]
                    out[key].leaves.append((step * value).tolist())
        if (turn + 1) % MARGINS_EVERY == 0 and turn + 1 < p["maxIter"]:
            blocks, written = durable(_with_margins(blocks, matrices, out, written)), turn + 1
            held.unpersist()
            held = _held(blocks)
    held.unpersist()
    return out


def _held(blocks: DataFrame) -> RDD:
    """Blocks kept by the executors; one that is lost is read again from the shared folder."""
    return blocks.rdd.map(lambda block: block).persist(StorageLevel.MEMORY_AND_DISK)


def _level(blocks: RDD, matrices, out, open_nodes, written, turn, level, p) -> dict:
    """The splits of one level of all trees: ``key -> (feature, cut, sums left, sums right)``.

    Levels are many and short, and each depends on the one before, so they run as plain jobs on the
    held blocks: planning a query for each would take longer than the work.
    """
    known = {key: Ensemble([], e.base, *([np.asarray(x) for x in part[written:]] for part in (e.features, e.cuts, e.leaves)), e.loss) for key, e in out.items()}

    def histograms(rows):
        found: dict = {}
        for block in rows:
            bins, labels, uses, margins = matrices(block)
            drawn = sampled(block["block"], turn, len(labels), p["subsamplingRate"], p["seed"])
            for m in range(uses.shape[1]):
                key = (block["model_group"], m)
                at = np.flatnonzero(drawn & uses[:, m])
                model, some = known[key], bins[at]
                margin = model.base + margins[at, m] + model.margin(some)
                if model.loss == "log":
                    chance = 1.0 / (1.0 + np.exp(-margin))
                    gradient, weight = labels[at] - chance, chance * (1 - chance)
                else:
                    gradient, weight = labels[at] - margin, np.ones(len(at))
                node = leaf_of(*open_nodes[key], some, np.arange(len(at)))
                width = some.shape[1]
                cell = ((node[:, None] * width + np.arange(width)) * BINS + some).ravel()
                size = (1 << level) * width * BINS
                hist = np.stack([np.bincount(cell, np.repeat(gradient, width), size), np.bincount(cell, np.repeat(weight, width), size)], axis=1)
                found[key] = found[key] + hist if key in found else hist
        return found.items()

    sums = blocks.mapPartitions(histograms)
    if blocks.getNumPartitions() > 1:  # else the sums of the one partition are those of all blocks
        sums = sums.reduceByKey(lambda x, y: x + y, min(len(out), blocks.getNumPartitions()))
    return dict(sums.mapValues(lambda hist: best_splits(hist.reshape(1 << level, -1, BINS, 2))).collect())


def _with_margins(blocks, matrices, out, written) -> DataFrame:
    known = {key: Ensemble([], 0.0, e.features[written:], e.cuts[written:], e.leaves[written:]) for key, e in out.items()}

    def run(batches):
        for batch in batches:
            sums = []
            for block in batch.to_pylist():
                bins, _, uses, margins = matrices(block)
                sums.append(np.stack([margins[:, m] + known[block["model_group"], m].margin(bins) for m in range(uses.shape[1])], axis=1).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(sums, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


def predicted(ensembles: dict, features: Sequence[str], key: Column) -> Column:
    """The prediction of the ensemble that ``key`` names, as a column; null where there is none of this name."""
    features = list(features)

    @F.pandas_udf("double")
    def run(name: pd.Series, values: pd.DataFrame) -> pd.Series:
        out = np.full(len(name), np.nan)
        x = values.to_numpy(float)
        for k, at in name.groupby(name).indices.items():
            if k in ensembles:
                out[at] = ensembles[k].predict(x[at])
        return pd.Series(out).where(~np.isnan(out), None).astype("float64")

    value = run(key.cast("string"), F.struct(*[F.col(f).cast("double").alias(f) for f in features]))
    return F.when(~F.isnan(value), value)
