"""Training, measuring, ranking, storing and applying models."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tableloom.functions.scalars import to_number
from tableloom.operators.features import class_weights
from tableloom.operators.numbering import running_sums

REGRESSORS = {
    "gbt": lambda seed: GBTRegressor(maxIter=20, maxDepth=4, seed=seed),
    "random_forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed),
    "linear": lambda seed: LinearRegression(regParam=0.01),
}
CLASSIFIERS = {
    "gbt": lambda seed: GBTClassifier(maxIter=20, maxDepth=4, seed=seed),
    "random_forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed),
    "logistic": lambda seed: LogisticRegression(regParam=0.01),
}
# Which metric ranks the models of a kind, which breaks ties, and whether more is better.
RANKING = {"classification": (("auc", True), ("f1", True)), "regression": (("r2", True), ("mae", False)), "forecast": (("mape", False), ("rmse", False))}


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    features: list[str]
    failed: dict[str, str] = field(default_factory=dict)


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as numbers; what is no number counts as 0."""
    return df.withColumns({f: F.coalesce(to_number(F.col(f)), F.lit(0.0)) for f in features})


def train(
    df: DataFrame, target: str, kind: str, features: Sequence[str], models: Sequence[str] | None = None,
    split: str = "split", seed: int = 42, threshold: float = 0.5,
) -> Trained:
    """Fit on the train rows, measure on the valid rows. A model that fails is skipped; none left is an error."""
    builders = {"regression": REGRESSORS, "classification": CLASSIFIERS}[kind]
    known = df.where(F.col(target).isNotNull() & F.col(split).isin("train", "valid"))
    data = numeric_inputs(known, features).withColumn("label", F.col(target).cast("double"))
    fit_on, weight = data.where(F.col(split) == "train"), None
    if kind == "classification":
        weights = class_weights(fit_on, "label").select("label", F.col("weight").alias("class_weight"))
        fit_on, weight = fit_on.join(F.broadcast(weights), "label"), "class_weight"  # one row per class
    fit_on, check_on = fit_on.persist(), data.where(F.col(split) == "valid").persist()
    fitted, rows, failed = {}, [], {}
    for name in models or builders:
        try:
            estimator = builders[name](seed).setLabelCol("label").setFeaturesCol("features")
            if weight:
                estimator = estimator.setWeightCol(weight)
            model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator]).fit(fit_on)
            scored = score(check_on, model, kind, features, threshold)
            if kind == "regression":
                found = regression_metrics(scored, "label", "Predicted")
            else:
                confusion = classification_metrics(scored, "label", "predicted_class")
                found = confusion.withColumn("auc", auc(scored, "label", "predicted_probability").scalar())
            rows.append({"model": name, **found.first().asDict()})
            fitted[name] = model
        except Exception as problem:  # noqa: BLE001 - one model must not stop the others
            failed[name] = str(problem).splitlines()[0]
    if not fitted:
        fit_on.unpersist()
        check_on.unpersist()
        raise RuntimeError(f"no model could be trained: {failed}")
    fit_on.unpersist()
    check_on.unpersist()
    # One row per model.
    names = ["n", "r2", "mse", "mae", "rmsle"] if kind == "regression" else ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "auc"]
    schema = "model string, " + ", ".join(f"{m} {'bigint' if m in ('n', 'tp', 'fp', 'fn', 'tn') else 'double'}" for m in names)
    metrics = df.sparkSession.createDataFrame([(r["model"], *[r[m] for m in names]) for r in rows], schema)
    return Trained(fitted, metrics, list(features), failed)


def score(df: DataFrame, model: PipelineModel, kind: str, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Input columns plus `Predicted`, or plus `predicted_probability` of class 1 and `predicted_class`."""
    keep = [c for c in df.columns if c not in features]
    raw = df.select(*keep, *[F.col(f).alias(f"__in_{f}") for f in features], *[F.coalesce(to_number(F.col(f)), F.lit(0.0)).alias(f) for f in features])
    out = model.transform(raw)
    inputs = [F.col(f"__in_{c}").alias(c) if c in features else F.col(c) for c in df.columns]
    if kind == "regression":
        return out.select(*inputs, F.col("prediction").alias("Predicted"))
    p = vector_to_array("probability")[1]
    return out.select(*inputs, p.alias("predicted_probability"), F.when(p >= threshold, 1).otherwise(0).alias("predicted_class"))


def _squares(y: Column, p: Column) -> dict[str, Column]:
    error = y - p
    return {"n": F.count(error), "mse": F.avg(error * error), "mae": F.avg(F.abs(error))}


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """n, R2, MSE, MAE and RMSLE (over rows where both sides exceed -1) in one pass."""
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    m = _squares(a, p)
    logs = F.when((a > -1) & (p > -1), F.pow(F.log1p(a) - F.log1p(p), 2))
    return pairs.agg(
        m["n"].alias("n"), (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))).alias("r2"),
        m["mse"].alias("mse"), m["mae"].alias("mae"), F.sqrt(F.avg(logs)).alias("rmsle"),
    )


def forecast_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """n, MAPE in percent (rows with y = 0 skipped), RMSE, MAE."""
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    m = _squares(a, p)
    share = F.when(a != 0, F.abs((a - p) / F.when(a != 0, a)))
    return pairs.agg(m["n"].alias("n"), (F.avg(share) * 100).alias("mape"), F.sqrt(m["mse"]).alias("rmse"), m["mae"].alias("mae"))


def classification_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Confusion matrix, precision, recall and F1 of class 1."""
    pairs = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    is1, says1 = F.col(y) == 1, F.col(predicted) == 1
    counts = pairs.agg(
        F.count_if(is1 & says1).alias("tp"), F.count_if(~is1 & says1).alias("fp"),
        F.count_if(is1 & ~says1).alias("fn"), F.count_if(~is1 & ~says1).alias("tn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select(
        "*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def auc(df: DataFrame, y: str, score_col: str) -> DataFrame:
    """Exact ROC AUC as one row (`auc`): the chance that a positive outranks a negative, ties count half.

    Rows are first counted per distinct score; the negatives below each come from sums over ranges of scores.
    """
    counts = (
        df.where(F.col(y).isNotNull() & F.col(score_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    )
    ranked = running_sums(counts, ["s"], {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def records_info(df: DataFrame, split: str, needed: Sequence[str]) -> DataFrame:
    """Rows per part and how many of them are complete in the needed columns."""
    complete = F.count_if(~F.greatest(*[F.col(c).isNull() for c in needed], F.lit(False)))
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("total"), complete.alias("used"))


def rank_models(metrics: DataFrame, kind: str, segment: Sequence[str] = ()) -> DataFrame:
    """Rank per segment by the leading metric of the kind, then the second, then the name."""
    order = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_last() for c, up in RANKING[kind]]
    rank = F.row_number().over(Window.partitionBy(*(segment or [F.lit(0)])).orderBy(*order, "model"))
    return metrics.withColumn("rank", rank).withColumn("recommended", F.col("rank") == 1)


def save_model(model: PipelineModel, root: str, name: str, metrics: dict, features: Sequence[str], spark: SparkSession) -> str:
    """Write the fitted pipeline and append a registry row; returns the model id."""
    now = datetime.now(timezone.utc)
    model_id = f"{name}_{now:%Y%m%d_%H%M%S_%f}"
    path = f"{root.rstrip('/')}/models/{model_id}"
    model.write().overwrite().save(path)
    row = [(model_id, name, now.isoformat(), path, json.dumps(metrics), list(features), f"{now:%Y-%m-%d}")]
    schema = "model_id string, model_name string, created_at string, model_path string, metrics string, features array<string>, training_date string"
    spark.createDataFrame(row, schema).write.mode("append").parquet(f"{root.rstrip('/')}/registry")
    return model_id


def load_model(spark: SparkSession, root: str, model_id: str) -> tuple[PipelineModel, dict]:
    entry = spark.read.parquet(f"{root.rstrip('/')}/registry").where(F.col("model_id") == model_id).first()
    if entry is None:
        raise KeyError(f"unknown model: {model_id}")
    return PipelineModel.load(entry["model_path"]), entry.asDict()
