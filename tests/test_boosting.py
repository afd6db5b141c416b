"""Joint boosting against numpy, Spark ML and itself under other partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from settlespark.errors import GuardError
from settlespark.operators import boosting
from settlespark.plans import models


def table(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    x, z = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n)
    y = np.where(x > 0.5, 4 * np.sin(2 * x), x) + z * (x < -1) + rng.normal(0, 0.3, n)
    return pd.DataFrame({"i": np.arange(n), "x": x, "z": z, "y": y})


def test_best_split_equals_enumeration():
    rng = np.random.default_rng(1)
    hist = np.stack([rng.normal(size=(3, 2, boosting.BINS)), rng.integers(0, 4, size=(3, 2, boosting.BINS)).astype(float)], axis=-1)
    hist[..., 0] *= hist[..., 1] > 0
    hist[:, 1] *= hist[:, :1].sum(axis=(2, 3), keepdims=True)[:, 0] * 0 + 1
    feature, cut, a, b = boosting.best_splits(hist)
    for n in range(3):
        best, found = -np.inf, None
        for f in range(2):
            for c in range(boosting.BINS):
                left, right = hist[n, f, :c + 1].sum(0), hist[n, f, c + 1:].sum(0)
                if left[1] > 0 and right[1] > 0:
                    gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - (left + right)[0] ** 2 / (left + right)[1]
                    if gain > best + 1e-12:
                        best, found = gain, (f, c, left)
        assert (feature[n], cut[n]) == found[:2] and np.allclose(a[n], found[2])


def test_one_deep_tree_is_the_mean_of_its_leaves(spark):
    pdf = table(400)
    rows = spark.createDataFrame(pdf).select("x", "z", F.lit("g").alias("model_group"), F.col("y").alias("label"), F.array(F.lit(True)).alias("use"))
    fitted = boosting.boost(rows, ["x", "z"], 1, params={"maxIter": 1, "maxDepth": 3, "subsamplingRate": 1.0})["g", 0]
    x = pdf[["x", "z"]].to_numpy()
    bins = boosting.binned(x, fitted.edges)
    leaf = boosting.leaf_of(np.array(fitted.features[0]), np.array(fitted.cuts[0]), bins, np.arange(len(x)))
    assert np.allclose(fitted.predict(x), pdf["y"].groupby(leaf).transform("mean"))


def test_models_of_one_table_do_not_mix(spark):
    """A model trained beside others predicts what it predicts alone, and blocks and partitions do not matter."""
    pdf = table(900)
    df = spark.createDataFrame(pdf)
    half = F.col("i") < 450
    together = df.select("x", "z", "i", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("model_group"), "y").withColumn(
        "label", F.when(F.col("model_group") == "up", F.col("y")).otherwise(-F.col("y"))).withColumn("use", F.array(F.lit(True), half))
    params = {"maxIter": 12, "maxDepth": 3, "subsamplingRate": 1.0}
    many = boosting.boost(together.repartition(5), ["x", "z"], 2, params=params)
    x = pdf[["x", "z"]].to_numpy()
    # All rows are given, as bins come from all rows of a call; the model trains on half of them.
    alone = df.select("x", "z", F.lit("up").alias("model_group"), F.col("y").alias("label"), F.array(half).alias("use"))
    assert set(many) == {("up", 0), ("up", 1), ("down", 0), ("down", 1)}
    one = boosting.boost(alone, ["x", "z"], 1, params=params)["up", 0]
    assert np.allclose(many["up", 1].predict(x), one.predict(x), atol=1e-6)
    assert np.allclose(many["up", 0].predict(x), -many["down", 0].predict(x), atol=1e-6)
    again = boosting.boost(together.coalesce(1), ["x", "z"], 2, params=params)
    assert np.allclose(many["up", 0].predict(x), again["up", 0].predict(x), atol=1e-6)


def test_holdout_error_is_that_of_spark_ml(spark):
    pdf = table(3000)
    df = spark.createDataFrame(pdf)
    train, test = df.where("i < 2400"), df.where("i >= 2400").toPandas()
    ours = models.fit_regressor(train, ["x", "z"], "y").predict(df.where("i >= 2400"), "p").toPandas()
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="v")
    theirs = GBTRegressor(featuresCol="v", labelCol="y", maxIter=60, stepSize=0.1, maxDepth=5, subsamplingRate=0.85, seed=42).fit(vectors.transform(train))
    theirs = theirs.transform(vectors.transform(df.where("i >= 2400"))).toPandas()
    mae = [(f["y"] - f[c]).abs().mean() for f, c in ((ours, "p"), (theirs, "prediction"))]
    assert len(test) == 600 and mae[0] <= 1.05 * mae[1]


def test_log_loss_gives_probabilities(spark):
    pdf = table(1200)
    rows = spark.createDataFrame(pdf).select("x", "z", F.lit("g").alias("model_group"), (F.col("x") > 0.5).cast("double").alias("label"), F.array(F.lit(True)).alias("use"))
    fitted = boosting.boost(rows, ["x", "z"], 1, params={"maxIter": 20, "maxDepth": 2}, loss={"g": "log"})["g", 0]
    p = fitted.predict(pdf[["x", "z"]].to_numpy())
    assert ((p > 0.5) == (pdf["x"] > 0.5)).mean() > 0.97 and 0 < p.min() < p.max() < 1


def test_nulls_constants_and_models_without_rows(spark):
    rows = spark.createDataFrame([(None, 1.0, 3.0), (1.0, 1.0, 3.0), (2.0, None, 3.0)], "x double, z double, label double").withColumns(
        {"model_group": F.lit("g"), "use": F.array(F.lit(True))})
    fitted = boosting.boost(rows, ["x", "z"], 1, params={"maxIter": 3, "maxDepth": 2})["g", 0]
    assert np.allclose(fitted.predict(np.array([[np.nan, 1.0], [5.0, np.nan]])), 3.0)
    with pytest.raises(GuardError, match="no rows to train model 0"):
        boosting.boost(rows.withColumn("use", F.array(F.lit(False))), ["x", "z"], 1)
    with pytest.raises(GuardError):
        boosting.boost(rows.limit(0), ["x", "z"], 1)
