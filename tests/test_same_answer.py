"""The same answer whatever the size of the data and the way taken, and inputs that are odd but real."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.functions.stats import global_quantiles, group_quantiles
from tableloom.operators import aggregate, cluster, features, forecast, pairwise, profile, splits

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, INF], [1.0, 2.0, 3.0, NAN], [-INF, -INF, 5.0, 5.0, 5.0, INF, NAN], [2.0, 2.0, 2.0, INF], [NAN], [INF, -INF], [None, 4.0], [0.1 * i for i in range(97)] + [NAN, INF]])
def test_quantiles_by_search_are_those_of_the_small_path(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(v, "k") for v in values], "`a.b` double, k string")
    small, large = global_quantiles(df, ["a.b"], probs), global_quantiles(df, ["a.b"], probs, hot_rows=0)
    same = lambda a, b: (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)
    assert all(same(a, b) for a, b in zip(small["a.b"], large["a.b"]))
    by_key = group_quantiles(df.withColumnRenamed("a.b", "v"), ["k"], "v", probs, "q", hot_rows=0).first()["q"]
    assert all(same(a, b) for a, b in zip(small["a.b"], by_key))


def test_similarity_is_compared_in_full(spark):
    # 0.2999996 is not 0.3, and the nearer of two near copies is the nearest.
    almost = 0.2999996
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [almost, math.sqrt(1 - almost**2)])], "id bigint, vec array<double>")
    assert pairwise.cosine_pairs(df, 0.3).isEmpty() and pairwise.cosine_pairs(df, 0.2999).count() == 1
    angle = lambda a: [math.cos(a), math.sin(a)]
    near = spark.createDataFrame([(9, angle(0.0)), (1, angle(2e-4)), (3, angle(1e-4))], "id bigint, vec array<double>")
    best = {r["id"]: r["other"] for r in pairwise.cosine_topn(near, 1).collect()}
    assert best[9] == 3


def test_small_distances_in_many_dimensions():
    x = np.ones((1, 40)) * 3
    y = x.copy()
    y[0, 7] += 1e-5
    assert math.isclose(pairwise._distance(x, y)[0, 0], 1e-5, rel_tol=1e-6)


def test_density_clusters_agree_at_the_boundary(spark):
    eps = 2.122003770024926
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.7, 1.27), (3, 50.0, 0.0)], "id bigint, x double, y double")
    got = [sorted(tuple(r) for r in cluster.dbscan(df, "id", ["x", "y"], eps=eps, min_samples=2, method=m).collect()) for m in ("grid", "tiles")]
    assert got[0] == got[1]


def test_silhouette_takes_text_labels(spark):
    rows = [(i, float(i % 2) * 10 + i / 10, "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, x double, label string")
    numbered = df.withColumn("label", F.when(F.col("label") == "a", 0).otherwise(1))
    text, number = (cluster.silhouette(d, "id", ["x"], "label").first()["silhouette"] for d in (df, numbered))
    assert math.isclose(text, number) and text > 0.9


def test_a_thousand_categories(spark):
    df = spark.createDataFrame([(i % 50, f"c{i % 300}") for i in range(600)], "id bigint, kind string")
    vectors = features.entity_vectors(df, "id", ["kind"])
    row = vectors.where("id = 7").first()["vec"]
    assert len(row) == 300 and math.isclose(sum(row), 1.0)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (4.0, 5.0, 8.0), (None, 5.0, 1.0)], "a double, flat double, b double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.corr_matrix(df, ["a", "flat", "b"]).collect()}
    assert got["a", "flat"] is None and math.isclose(got["a", "b"], 1.0)
    assert features.leakage_scan(df, "b").where("column_name = 'flat'").first()["verdict"] == "ok"


def test_leakage_in_text_flags_and_dates(spark):
    rows = [(i % 2 * 1.0, str(i % 2), i % 2 == 1, f"id{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "y double, spelled string, flag boolean, name string, n int").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("y") * 9).cast("int")))
    got = {r["column_name"]: r["verdict"] for r in features.leakage_scan(df, "y").collect()}
    assert got["spelled"] == got["flag"] == got["day"] == "severe"
    assert got["name"] == "ok"


def test_mode_of_numbers_goes_to_the_smaller_number(spark):
    df = spark.createDataFrame([(10,), (10,), (9,), (9,), (None,)], "v int")
    assert sorted(r["v"] for r in features.clean_table(df, {"v": {"missing": "mode"}}).collect()) == [9, 9, 9, 10, 10]


def test_fills_fit_elsewhere(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a")], "x double, t string")
    other = spark.createDataFrame([(None, None)], "x double, t string")
    fills = features.fill_values(train)
    assert fills == {"x": 2.0, "t": "a"} and tuple(features.impute(other, fills=fills).first()) == (2.0, "a")


def test_lags_go_by_the_calendar(spark):
    series = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 4, 40.0), ("b", 2, 7.0)], "s string, t bigint, y double")
    got = {(r["s"], r["t"]): r["y_lag1"] for r in forecast.lag_features(series, "y", [1], ["s"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 10.0, ("a", 4): None, ("b", 2): None}


def test_every_known_target_trains_or_validates(spark):
    df = spark.createDataFrame([(None, 1.0), ("k", 2.0), ("m", None)], "key string, y double")
    got = {r["key"]: r["split"] for r in splits.split(df, "key", "missing_target", target="y").collect()}
    assert got[None] in ("train", "valid") and got["m"] == "infer"


def test_named_columns_are_all_described(spark):
    df = spark.createDataFrame([(0, *map(float, range(7)))], "c int, a double, b double, d double, e double, f double, g double, h double")
    assert {f"{x}_mean" for x in "abdefgh"} <= set(aggregate.cluster_stats(df, "c", list("abdefgh")).columns)
    assert len([x for x in aggregate.cluster_stats(df, "c").columns if x.endswith("_mean")]) == 5


def test_columns_with_dots_aggregate(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 4.0, "a"), (2, 9.0, None)], "`k.x` int, `a.b` double, `t.t` string")
    out = aggregate.aggregate(df, ["k.x"], {"a.b": ["Sum", "Median"], "t.t": ["Mode"]})
    assert out.columns == ["k.x", "a.b_sum", "a.b_median", "t.t_mode"]
    assert sorted(map(tuple, out.collect())) == [(1, 6.0, 3.0, "a"), (2, 9.0, 9.0, None)]
    hot = aggregate.aggregate(df, ["k.x"], {"a.b": ["Median"], "t.t": ["Mode", "Unique Count"]}, hot_rows=0)
    assert sorted(map(tuple, hot.collect())) == [(1, 3.0, "a", 1), (2, 9.0, None, 0)]
