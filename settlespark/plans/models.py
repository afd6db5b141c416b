"""Model training and forecasting. Boosted trees of all folds and targets are trained together
(``operators.boosting``); their numbers differ from other libraries, so they are judged by metrics, not by value."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from settlespark import constants as K
from settlespark.errors import GuardError
from settlespark.functions.features import arcsinh_price, balance_layers, numeric_features, price_from_arcsinh
from settlespark.functions.values import number
from settlespark.operators import risk, scoring
from settlespark.operators.boosting import Ensemble, boost, predicted
from settlespark.operators.point_in_time import timestamp_lags
from settlespark.operators.quality import clip_counts, component_profile, physical_bounds
from settlespark.operators.series import expanding_folds, holdout_split
from settlespark.session import durable

PRICE = "price_gbp_mwh"
TS = "timestamp"


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def complete_rows(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    clean = df.dropna(subset=list(columns))
    if clean.isEmpty():
        raise GuardError(f"no complete rows for {label}")
    return clean


@dataclass
class Regressor:
    """A fitted tree ensemble with its feature list and target transform."""

    ensemble: Ensemble
    features: list[str]
    target: str
    transform: str = "identity"
    scale: float = 50.0

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        value = predicted({"": self.ensemble}, self.features, F.lit(""))
        return df.withColumn(out, price_from_arcsinh(value, self.scale) if self.transform == "arcsinh" else value)

    def save(self, path: str) -> None:
        save_json(SparkSession.active(), vars(self) | {"ensemble": self.ensemble.facts()}, path)

    @staticmethod
    def load(path: str) -> "Regressor":
        facts = load_json(SparkSession.active(), path)
        return Regressor(Ensemble(**facts.pop("ensemble")), **facts)


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document as a text table, on any file system Spark can reach."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def _label(value, transform: str, scale: float):
    if transform not in ("identity", "arcsinh"):
        raise ValueError(f"unknown transform {transform}")
    return arcsinh_price(value, scale) if transform == "arcsinh" else F.col(value).cast("double")


def fit_regressor(
    df: DataFrame, features: Sequence[str], target: str, transform: str = "identity", scale: float = 50.0, params: dict | None = None,
) -> Regressor:
    """Fit on rows complete in features and target, optionally on the arcsinh of the target."""
    label = _label(target, transform, scale)
    clean = complete_rows(df, [*features, target], target)
    rows = clean.select(*features, F.lit(target).alias("model_group"), label.alias("label"), F.array(F.lit(True)).alias("use"))
    return Regressor(boost(rows, features, 1, params=params)[target, 0], list(features), target, transform, scale)


@dataclass
class Study:
    """Rows of several targets in one table, with the models each row trains, and the models trained.

    Model 0 is scored on the holdout, the next ones belong to the folds, the last one has seen all rows.
    """

    rows: DataFrame
    features: list[str]
    targets: list[str]
    splits: int
    transform: str
    scale: float
    models: dict

    def _predicted(self, rows: DataFrame, model, out: str) -> DataFrame:
        named = {f"{t}:{m}": e for (t, m), e in self.models.items()}
        value = predicted(named, self.features, F.concat_ws(":", "target", model.cast("string")))
        return rows.withColumn(out, price_from_arcsinh(value, self.scale) if self.transform == "arcsinh" else value)

    def scores(self) -> dict[str, dict]:
        """Metrics of each target on its last rows, against the value 24 hours before."""
        tested = self._predicted(self.rows.where("is_test"), F.lit(0), "_model")
        found = {r.target: r.asDict() for r in scoring.holdout_score(tested, "value", "_model", "_baseline", ["target"]).collect()}
        for t in self.targets:
            if t not in found or not found[t]["comparison_rows"]:
                raise GuardError(f"no comparable rows for {t}")
            del found[t]["target"]
        return found

    def out_of_fold(self) -> DataFrame:
        """``(timestamp, oof_<target> ...)``: a prediction for each row by the model that has seen the rows before its fold."""
        rows = self._predicted(self.rows.where("fold IS NOT NULL"), F.col("fold") + 1, "_model")
        wide = rows.groupBy(TS).pivot("target", self.targets).agg(F.max("_model"))
        return wide.withColumnsRenamed({t: f"oof_{t}" for t in self.targets})

    def final(self, target: str) -> Regressor:
        return Regressor(self.models[target, self.splits + 1], self.features, target, self.transform, self.scale)


def study(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], splits: int = 0, holdout_rows: int | None = None, transform: str = "identity",
    scale: float = 50.0, params: dict | None = None, full: bool = True,
) -> Study:
    """Train, for all targets at once, a holdout model, a model for each expanding fold, and a model of all rows.

    A row counts for a target if the target and all features are known. The rows are written once;
    every model of every target reads this table.
    """
    features, targets = list(features), list(targets)
    known = df.select(TS, *features, *[number(t).alias(f"_t{i}") for i, t in enumerate(targets)]).dropna(subset=features)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_t{i}").alias("value")) for i, t in enumerate(targets)]))
    rows = known.select(TS, *features, each.alias("_x")).select(TS, *features, "_x.*").where("value IS NOT NULL")
    rows = rows.withColumn("label", _label("value", transform, scale))
    found = {r.target for r in rows.select("target").distinct().collect()}
    for t in targets:
        if t not in found:
            raise GuardError(f"no complete rows for {t}")
    rows = expanding_folds(rows, ["target"], TS, splits) if splits else rows.withColumn("fold", F.lit(None).cast("int"))
    if holdout_rows is None:
        rows = rows.withColumn("is_test", F.lit(False))
    else:
        rows = timestamp_lags(holdout_split(rows, ["target"], TS, holdout_rows), ["target"], TS, "value", {"_baseline": 86400})
    uses = [~F.col("is_test") & F.lit(holdout_rows is not None), *[F.col("fold").isNull() | (F.col("fold") < k) for k in range(splits)], F.lit(full)]
    wanted = [i for i in range(splits + 2) if (i > 0 or holdout_rows is not None) and (i <= splits or full)]
    rows = durable(rows.withColumn("use", F.array(*[uses[i] for i in wanted])))
    made = boost(rows, features, len(wanted), group="target", params=params)
    return Study(rows, features, targets, splits, transform, scale, {(t, wanted[m]): e for (t, m), e in made.items()})


def holdout(
    df: DataFrame, features: Sequence[str], target: str, rows: int, transform: str = "identity", scale: float = 50.0, params: dict | None = None,
) -> dict:
    """Score the last ``rows`` complete rows against the value exactly 24 hours earlier."""
    return study(df, features, [target], holdout_rows=rows, transform=transform, scale=scale, params=params, full=False).scores()[target]


def out_of_fold(
    df: DataFrame, features: Sequence[str], target: str, splits: int = 5, transform: str = "identity", scale: float = 50.0, params: dict | None = None,
) -> DataFrame:
    """``timestamp`` and an honest prediction per row; the first block has none. Each fold trains on all rows before it."""
    return study(df, features, [target], splits, transform=transform, scale=scale, params=params, full=False).out_of_fold()


def train(df: DataFrame, model_dir: str, holdout_rows: int = 4320, splits: int = 5, params: dict | None = None) -> dict:
    """Train component models, then the price model on their out-of-fold predictions.

    The models of all components and folds grow side by side, so the jobs are those of two models.
    Writes models, the component error table and metadata; returns the holdout metrics.
    """
    spark = df.sparkSession
    profile, targets = component_profile(df)
    features = numeric_features(df)
    if not features:
        raise GuardError("no model features")
    df = durable(df)
    parts = study(df, features, targets, splits, holdout_rows, params=params)
    metrics = parts.scores()
    for target in targets:
        parts.final(target).save(f"{model_dir}/{target}")
    oof = durable(parts.out_of_fold())
    stacked = df.drop(*targets).join(oof.withColumnsRenamed({f"oof_{t}": t for t in targets}), TS, "left")
    errors = df.select(TS, *targets).join(oof, TS, "left").select(TS, *[(F.col(t) - F.col(f"oof_{t}")).alias(t) for t in targets])

    pricing = durable(balance_layers(stacked))
    price_features = [*features, *targets, *K.BALANCE_LAYERS]
    prices = study(pricing, price_features, [PRICE], holdout_rows=holdout_rows, transform="arcsinh", params=params)
    metrics |= prices.scores()
    prices.final(PRICE).save(f"{model_dir}/{PRICE}")
    if "marginal_technology" in df.columns:
        labelled = pricing.dropna(subset=[*price_features, "marginal_technology"])
        if not labelled.isEmpty():
            fit_classes(labelled, price_features, "marginal_technology").write().overwrite().save(f"{model_dir}/marginal_technology")
    errors.dropna().write.mode("overwrite").parquet(f"{model_dir}/component_errors")
    save_json(spark, {
        "model_profile": profile, "component_targets": targets, "features": features, "price_features": price_features,
        "metrics": metrics, "stacking": "expanding_window_out_of_fold", "time_series_splits": splits,
        "training_rows": df.count(), "price_training_rows": prices.rows.count(),
        "baseline_definition": "value exactly 24 hours before delivery",
    }, f"{model_dir}/metadata")
    return metrics


def prepare_bundle(df: DataFrame, model_dir: str, holdout_rows: int = 4320, min_rows: int = K.MIN_OPERATIONAL_ERROR_ROWS) -> dict:
    """Choose each component's operational source and write the matching error history."""
    spark = df.sparkSession
    meta = load_json(spark, f"{model_dir}/metadata")
    targets = meta["component_targets"]
    df = durable(df.select(TS, *[F.col(t).cast("double").alias(t) for t in targets]))
    split = holdout_split(df.withColumn("_all", F.lit(0)), ["_all"], TS, holdout_rows)
    cut = split.where("is_test").agg(F.min(TS)).first()[0]
    mae = {t: meta["metrics"].get(t, {}).get("model_mae") for t in targets}
    choice = scoring.fallback_choice(df, TS, targets, F.col(TS) >= F.lit(cut), {t: m for t, m in mae.items() if m is not None})
    strategy = {r.target: r.asDict() for r in choice.collect()}
    model_errors = spark.read.parquet(f"{model_dir}/component_errors")
    switched = [t for t in targets if strategy[t]["source"] == "fallback_d7"]
    errors = df.select(TS).join(model_errors.select(TS, *[t for t in targets if t not in switched]), TS, "left")
    for t in switched:
        lagged = timestamp_lags(df.withColumn("_all", F.lit(0)).select("_all", TS, t), ["_all"], TS, t, {"_before": K.FALLBACK_LAG_S})
        errors = errors.join(lagged.select(TS, (F.col(t) - F.col("_before")).alias(t)), TS, "left")
    whole = durable(errors.select(TS, *targets).dropna(subset=targets))
    count = whole.count()
    if count < min_rows:
        raise GuardError(f"operational error history has only {count} complete rows")
    whole.write.mode("overwrite").parquet(f"{model_dir}/operational_errors")
    meta |= {"operational_bundle_ready": True, "operational_component_strategy": strategy, "component_error_table": "operational_errors",
             "operational_error_rows": count, "fallback_policy": "the value 168 hours before delivery, where its holdout error is below the model's"}
    save_json(spark, meta, f"{model_dir}/bundle")
    return {"model_profile": meta["model_profile"], "component_strategy": strategy, "operational_error_rows": count}


def bundle_metadata(spark: SparkSession, model_dir: str, operational: bool = True) -> dict:
    return load_json(spark, f"{model_dir}/{'bundle' if operational else 'metadata'}")


def point_forecasts(df: DataFrame, model_dir: str, meta: dict) -> DataFrame:
    """Component point forecasts by the chosen source, within physical bounds."""
    point, strategy = df, meta.get("operational_component_strategy", {})
    targets = meta["component_targets"]
    for target in targets:
        source = strategy.get(target, {}).get("source", "model")
        if source == "fallback_d7":
            if f"fallback_d7_{target}" not in point.columns:
                raise KeyError(f"strategy needs column fallback_d7_{target}")
            point = point.withColumn(target, number(f"fallback_d7_{target}"))
        elif source == "model":
            point = Regressor.load(f"{model_dir}/{target}").predict(point, target)
        else:
            raise ValueError(f"unknown source {source} for {target}")
        point = point.withColumn(f"component_source_{target}", F.lit(source))
    return point


def price_paths(points: DataFrame, errors: DataFrame, components: Sequence[str], price_model: Regressor, scenarios: int, seed: int = 42, draw=None) -> DataFrame:
    """Scenario prices: error draws, balance layers and the price model on one long table."""
    moved = risk.error_scenarios(points, errors, components, scenarios, seed, draw=draw)
    return price_model.predict(balance_layers(moved), "price")


def forecast(
    df: DataFrame, model_dir: str, scenarios: int = 1000, position_mwh: float = 100.0, operational: bool = True, seed: int = 42,
) -> dict[str, DataFrame]:
    """Points, price quantiles, daily summary and risk of one or many delivery days."""
    from settlespark.functions import clock

    spark = df.sparkSession
    meta = bundle_metadata(spark, model_dir, operational)
    targets = meta["component_targets"]
    raw = point_forecasts(df, model_dir, meta)
    price_model = Regressor.load(f"{model_dir}/{PRICE}")
    point = durable(price_model.predict(balance_layers(physical_bounds(raw, targets)), "price_point_gbp_mwh"))
    errors = spark.read.parquet(f"{model_dir}/{meta.get('component_error_table', 'component_errors')}")
    # The paths feed three outputs; they are computed once.
    paths = durable(
        price_paths(point, errors, targets, price_model, scenarios, seed)
        .select(clock.delivery_date(TS).alias("delivery_date"), TS, "scenario", "price", "price_point_gbp_mwh"))
    quantiles = risk.price_quantiles(paths, ["delivery_date", TS], "price")
    return {
        "points": point,
        "prices": quantiles.join(point.select(TS, F.col("price_point_gbp_mwh").alias("point")), TS),
        "summary": risk.daily_distribution(paths, quantiles, ["delivery_date"], "price"),
        "risk": risk.scenario_risk(paths, ["delivery_date"], "price", "price_point_gbp_mwh", position_mwh),
        "clipped": clip_counts(raw, targets),
    }


def fit_curtailment(df: DataFrame, features: Sequence[str], curtailed: str, params: dict | None = None) -> tuple[Regressor, Regressor]:
    """Event classifier and conditional volume model, grown side by side."""
    clean = complete_rows(df, [*features, curtailed], curtailed)
    seen = clean.agg(F.count_if(F.col(curtailed) > 0).alias("event"), F.count_if(F.col(curtailed) <= 0).alias("none")).first()
    if not seen.event or not seen.none:
        raise GuardError("curtailment needs both event and non-event rows")
    happened = F.col(curtailed) > 0
    cases = F.array(F.struct(F.lit("event").alias("model_group"), happened.cast("double").alias("label")),
                    F.when(happened, F.struct(F.lit("volume").alias("model_group"), F.col(curtailed).cast("double").alias("label"))))
    rows = clean.select(*features, F.explode(F.array_compact(cases)).alias("_c")).select(*features, "_c.*", F.array(F.lit(True)).alias("use"))
    made = boost(rows, features, 1, params=params, loss={"event": "log"})
    return Regressor(made["event", 0], list(features), curtailed), Regressor(made["volume", 0], list(features), curtailed)


def predict_curtailment(models: tuple[Regressor, Regressor], df: DataFrame) -> DataFrame:
    """Probability, conditional volume and their product."""
    classifier, volume = models
    out = volume.predict(classifier.predict(df, "curtailment_probability"), "_volume")
    out = out.withColumn("conditional_curtailed_mw", F.greatest(F.lit(0.0), "_volume")).drop("_volume")
    return out.withColumn("expected_curtailed_mw", F.col("curtailment_probability") * F.col("conditional_curtailed_mw"))


def fit_classes(df: DataFrame, features: Sequence[str], label: str, trees: int = 60, seed: int = 42) -> PipelineModel:
    """Class probabilities of a label, e.g. the marginal technology."""
    rows = complete_rows(df, [*features, label], label).withColumn(label, F.col(label).cast("string"))
    indexer = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", probabilityCol="_probability", predictionCol="_class", rawPredictionCol="_raw", numTrees=trees, seed=seed)
    named = IndexToString(inputCol="_class", outputCol=f"predicted_{label}", labels=indexer.labels)
    fitted = Pipeline(stages=[_assembled(features), forest]).fit(indexer.transform(rows))
    return PipelineModel([*fitted.stages, named])


def class_probabilities(model: PipelineModel, df: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """One probability column per class that was trained; one of ``classes`` that no training row had is 0."""
    labels = model.stages[-1].getLabels()
    scored = model.transform(df).withColumn("_p", vector_to_array("_probability"))
    unseen = {f"probability_{c}": F.lit(0.0) for c in classes if c not in labels}
    return scored.withColumns({f"probability_{c}": F.col("_p")[i] for i, c in enumerate(labels)} | unseen).drop("_features", "_probability", "_class", "_raw", "_p")
