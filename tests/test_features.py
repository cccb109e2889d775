import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.operators import features as ops


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "a"), (3, None, None), (4, 9.0, "c"), (5, 3.0, "a")], "id int, x double, p string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_impute(gaps):
    filled = ops.impute(gaps)
    assert column(filled, "x") == [1.0, 2.0, 2.5, 9.0, 3.0] and column(filled, "p")[2] == "a"
    assert column(ops.impute(gaps, numeric="mean"), "x")[2] == 3.75
    whole = gaps.dropna()
    assert ops.impute(whole).schema == whole.schema
    # Fitted where nothing is missing, the value still serves elsewhere.
    assert ops.fill_values(gaps.where("id < 3"), columns=["x"])["x"] is not None


def test_one_hot(gaps):
    dropped = ops.one_hot(gaps, ["p"], drop_first=True)
    assert dropped.columns == ["id", "x", "p_b", "p_c"]
    assert column(dropped, "p_b") == [1, 0, 0, 0, 0] and column(dropped, "p_c") == [0, 0, 0, 1, 0]
    assert column(ops.one_hot(gaps, ["p"]), "p_a") == [0, 1, 0, 0, 1]


def test_scaling_uses_population_spread(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(1, 5)], "id int, x double, same double")
    scaled = ops.standard_scale(df, ["x", "same"])
    assert column(scaled, "x") == pytest.approx(list((np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4]))) and column(scaled, "same") == [0.0] * 4
    assert column(ops.standard_scale(df, ["same"], guard=True), "same") == [5.0] * 4


def test_weights():
    assert ops.normalise_weights({"a": 1, "b": 3.0, "c": 0, "d": "x", "e": True}) == {"a": 0.25, "b": 0.75}
    assert ops.normalise_weights({"a": None, "b": 0.5}) == {"a": 0.5, "b": 0.5}
    assert ops.checked_importance("great") == "medium" and ops.checked_importance("high") == "high"


def test_user_vectors_are_means_of_prepared_rows(spark):
    rows = [(1, 2.0, "a"), (1, None, "b"), (2, 4.0, "a"), (3, 6.0, None), (None, 8.0, "a")]
    df = spark.createDataFrame(rows, "u int, x double, c string")
    got = {r["id"]: r["vec"] for r in ops.entity_vectors(df, "u", ["x", "c"], {"c": 2.0}).collect()}
    x = np.array([2.0, 4.0, 4.0, 6.0])
    z = (x - x.mean()) / x.std()
    assert got[1] == pytest.approx([z[:2].mean(), 1.0, 1.0]) and got[2] == pytest.approx([z[2], 2.0, 0.0])
    assert got[3] == pytest.approx([z[3], 2.0, 0.0]) and set(got) == {1, 2, 3}


def test_item_vectors_take_the_first_row_in_order(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 1.0, 1), (2, 3.0, 1)], "i int, x double, seq int")
    got = {r["id"]: r["vec"] for r in ops.entity_vectors(df, "i", ["x"], how="first", order_by=["seq"]).collect()}
    x = np.array([5.0, 1.0, 3.0])
    assert got[1] == pytest.approx([(1 - x.mean()) / x.std()])
    with pytest.raises(ValueError):
        ops.entity_vectors(df, "i", ["x"], how="first")


def test_encoding_by_cardinality(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"v{i % 12}") for i in range(24)] + [(24, None, None)], "id int, few string, many string")
    out, report = ops.encode_by_cardinality(df, ["few", "many"])
    assert {r["column_name"]: r["encoding_type"] for r in report.collect()} == {"few": "one_hot", "many": "frequency"}
    assert column(out, "few_a")[:2] == [1, 0] and column(out, "many")[0] == pytest.approx(2 / 25) and column(out, "many")[24] == 0.0
    assert out.count() == 25


def test_leakage(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float((i * 7919) % 13), "hi" if i > 10 else "lo", f"id{i}") for i in range(21)],
                               "id int, y double, copy double, noise double, band string, name string")
    got = {r["column_name"]: (r["verdict"], r["reason"]) for r in ops.leakage_scan(df, "y", review=0.7, exclude=["id"]).collect()}
    assert got["copy"] == ("severe", "copies the target") and got["noise"][0] == "ok" and got["band"][0] == "review"
    assert got["name"][0] == "ok"
    assert ops.drop_features(df, ["copy", "id"], mapped=["id"]).columns == ["id", "y", "noise", "band", "name"]
    assert ops.training_features(df, ["y", "id"]) == ["copy", "noise"]


def test_classes(spark):
    df = spark.createDataFrame([("train", 0), ("train", 1), ("train", 0), ("valid", 1)], "split string, y int")
    assert {r["split"]: r["ok"] for r in ops.class_check(df, "split", "y").collect()} == {"train": True, "valid": False}
    assert {r["y"]: r["weight"] for r in ops.class_weights(df, "y").collect()} == {0: 1.0, 1: 1.0}


def test_cleaning(spark):
    df = spark.createDataFrame([(1, " a ", "1.5"), (2, "NA", "oops"), (3, "a", "2.5"), (4, None, None)], "id int, t string, n string")
    out = ops.clean_table(df, {"t": {"trim": True, "nullify": ["NA"], "missing": "constant", "constant": "?"}, "n": {"type": "double", "missing": "mean"}})
    assert column(out, "t") == ["a", "?", "a", "?"] and column(out, "n") == [1.5, 2.0, 2.5, 2.0]
    assert ops.clean_table(df, {"n": {"type": "double", "missing": "drop"}}).count() == 2


def test_noise_is_seeded_and_small(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("x"))
    a, b = column(ops.noisy(df, ["x"], 1), "x"), column(ops.noisy(df, ["x"], 1), "x")
    assert a == b and all(1e-4 <= v - 1 <= 1.001e-3 for v in a) and len(set(a)) == 50
