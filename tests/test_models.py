import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.operators import aggregate, forecast, splits, supervised


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    rows = [(i, float(a[i]), str(round(b[i], 3)), float(3 * a[i] - b[i] + 10), int(a[i] + b[i] > 0.8)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b string, y double, c int")
    return splits.split(df, "id", "random")


def test_regression_round_trip(spark, training, tmp_path):
    found = supervised.train(training, "y", "regression", ["a", "b"], ["linear", "random_forest"])
    best = supervised.rank_models(found.metrics, "regression").where("recommended").first()
    assert best["model"] == "linear" and best["r2"] > 0.99
    model_id = supervised.save_model(found.models["linear"], str(tmp_path), "linear", {"r2": best["r2"]}, ["a", "b"], spark)
    model, entry = supervised.load_model(spark, str(tmp_path), model_id)
    assert entry["model_name"] == "linear" and entry["features"] == ["a", "b"]
    scored = supervised.score(training, model, "regression", ["a", "b"])
    assert scored.columns == training.columns + ["Predicted"] and scored.count() == 400 and dict(scored.dtypes)["b"] == "string"
    with pytest.raises(KeyError):
        supervised.load_model(spark, str(tmp_path), "nope")


def test_classification(training):
    found = supervised.train(training, "c", "classification", ["a", "b"], ["logistic"])
    assert found.metrics.first()["auc"] > 0.95
    scored = supervised.score(training, found.models["logistic"], "classification", ["a", "b"])
    assert scored.where("(predicted_probability >= 0.5) <> (predicted_class = 1)").count() == 0
    assert aggregate.prediction_stats(scored, "predicted_probability", 0.5).first()["n"] == 400


def test_failing_models_are_skipped(training, monkeypatch):
    def broken(seed):
        raise RuntimeError("no such booster")

    monkeypatch.setitem(supervised.REGRESSORS, "broken", broken)
    found = supervised.train(training, "y", "regression", ["a", "b"], ["broken", "linear"])
    assert list(found.models) == ["linear"] and "booster" in found.failed["broken"]
    with pytest.raises(RuntimeError):
        supervised.train(training, "y", "regression", ["a"], ["broken"])


@pytest.mark.parametrize("scores", [np.random.default_rng(1).normal(size=300), np.random.default_rng(1).integers(0, 4, 300) / 4, np.zeros(300)])
def test_auc_equals_all_pairs(spark, scores):
    y = (np.random.default_rng(2).random(300) < 0.3).astype(int)
    pos, neg = scores[y == 1], scores[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))
    df = spark.createDataFrame([(int(a), float(s)) for a, s in zip(y, scores)], "y int, s double")
    assert supervised.auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    assert supervised.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (4.0, 4.0), (None, 1.0)], "y double, p double")
    m = supervised.regression_metrics(df, "y", "p").first()
    assert (m["n"], m["mae"], m["mse"]) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    f = supervised.forecast_metrics(df, "y", "p").first()
    assert f["mape"] == pytest.approx(50.0) and f["rmse"] == pytest.approx((2 / 3) ** 0.5)
    c = supervised.classification_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["precision"], c["recall"]) == (1, 0, 1, 1, 1.0, 0.5)


def test_records_info(spark):
    df = spark.createDataFrame([("train", 1, None), ("train", 2, 3)], "split string, a int, b int")
    assert tuple(supervised.records_info(df, "split", ["a", "b"]).first()) == ("train", 2, 1)


def test_horizon():
    assert [forecast.horizon(p) for p in (None, 4, 9, "abc")] == [3, 4, 6, 3]


def test_month_grid_and_held_inputs(spark):
    df = spark.createDataFrame([("2024-01-31", "5", 1), ("2024-01-31", "x", 2), ("2024-03-01", "9", 3)], "d string, x string, k int").withColumn("d", F.to_date("d"))
    assert [str(r["date"]) for r in forecast.month_grid(df, "d").orderBy("step").collect()] == ["2024-01-31", "2024-02-29", "2024-03-31"]
    held = forecast.exog_hold(df, "d", ["x"], ["k"], 2).orderBy("step").collect()
    assert [(str(r["date"]), r["x"]) for r in held] == [("2024-01-31", 5.0), ("2024-02-29", 5.0)]


def test_trend_and_season_are_recovered(spark):
    start = 2020 * 12 + 1
    rows = [("s", start + i, 100.0 + 2 * i + (30 if (start + i) % 12 == 0 else 0)) for i in range(48)] + [("one", start, 7.0)]
    series = spark.createDataFrame(rows, "k string, t int, y double")
    out = {(r["k"], r["step"]): r for r in forecast.forecast_trend_season(series, "y", ["k"], 6).collect()}
    assert len(out) == 12 and str(out["s", 1]["date"]) == "2024-01-31" and out["one", 3]["Predicted y"] == pytest.approx(7.0)
    assert out["s", 1]["Predicted y"] == pytest.approx(196, abs=6)
    whole = forecast.forecast_trend_season(series.where("k = 's'").drop("k"), "y", periods=1)
    assert whole.columns == ["step", "date", "Predicted y"] and whole.first()["Predicted y"] == pytest.approx(out["s", 1]["Predicted y"])


def test_autoregression_follows_its_rule(spark):
    values = [1.0, 2.0, 1.5]
    inputs = [float(i % 4) for i in range(40)]
    for i in range(3, 40):
        values.append(0.5 * values[-1] + 0.2 * values[-3] + inputs[i])
    rows = [("a", 24000 + i, v, x) for i, (v, x) in enumerate(zip(values, inputs))] + [("short", 24000, 4.0, 0.0)]
    series = spark.createDataFrame(rows, "k string, t int, y double, x double")
    out = {(r["k"], r["step"]): r["Predicted y"] for r in forecast.forecast_ar(series, "y", ["k"], ["x"], (1, 3), 2).collect()}
    first = 0.5 * values[-1] + 0.2 * values[-3] + inputs[-1]
    assert out["a", 1] == pytest.approx(first) and out["a", 2] == pytest.approx(0.5 * first + 0.2 * values[-2] + inputs[-1])
    assert out["short", 1] == 4.0


def test_lags(spark):
    series = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)], "k string, t int, y double")
    got = {(r["k"], r["t"]): r["y_lag1"] for r in forecast.lag_features(series, "y", [1], ["k"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 1.0, ("b", 1): None}


def test_trees_forecast_all_series_month_by_month(spark):
    # A steady rise, a season of its own, a missing month and a series of one month.
    rows = [("up", t, 10.0 * t) for t in range(24240, 24288)] + [("wave", t, 100.0 + 50 * (t % 12 < 6)) for t in range(24240, 24288)]
    rows += [("gap", t, 5.0 * t) for t in range(24240, 24288) if t != 24280] + [("one", 24287, 7.0), ("none", 24287, None)]
    df = spark.createDataFrame(rows, "who string, t bigint, y double")
    found = forecast.forecast_trees(df, "y", ["who"], periods=6)
    got = {(r["who"], r["step"]): r["Predicted y"] for r in found.collect()}
    assert len(got) == 4 * 6
    assert all(got["up", k] == pytest.approx(10.0 * (24287 + k), rel=0.001) for k in range(1, 7))
    assert all(abs(got["wave", k] - (150 if (24287 + k) % 12 < 6 else 100)) < 15 for k in range(1, 7))
    assert all(abs(got["gap", k] - 5.0 * (24287 + k)) < 60 for k in range(1, 7))
    table = forecast.forecast_table(found, "y", ["who"], "trees").where("who = 'up'").first()
    assert (str(table["period_from"]), str(table["period_to"]), table["periods"]) == ("2023-12-31", "2024-05-31", 6)
    short = spark.createDataFrame([("a", 24240, 1.0), ("a", 24241, 3.0)], "who string, t bigint, y double")
    assert [r["Predicted y"] for r in forecast.forecast_trees(short, "y", ["who"], periods=2).collect()] == [3.0, 3.0]
    assert forecast.forecast_trees(df.drop("who").where("t < 24260").groupBy("t").agg(F.sum("y").alias("y")), "y", [], periods=2).columns == ["step", "date", "Predicted y"]
