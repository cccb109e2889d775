import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.functions import stats
from tableloom.operators import numbering, aggregate, profile, roles, splits, target

GROUPS = [("x", None, "b", 1), ("x", None, "a", 2), ("y", 2, None, 1), (None, 5, "z", 1)]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, "k string, v int, s string, seq int")


@pytest.mark.parametrize("hot_rows", [None, 1, 0])
def test_group_rules(groups, hot_rows):
    """The same answers by the one-pass way and, with tiny limits, by the way for large groups."""
    out = aggregate.aggregate(groups, ["k"], {"v": ["Sum", "Median", "Mode"], "s": ["Unique Count", "Mode", "Last Value"]}, ["seq"], hot_rows=hot_rows)
    rows = {r["k"]: r for r in out.collect()}
    assert set(rows) == {"x", "y"}
    x, y = rows["x"], rows["y"]
    assert (x["v_sum"], x["v_median"], x["v_mode"], x["s_unique_count"], x["s_mode"], x["s_last_value"]) == (0, None, None, 2, "a", "a")
    assert (y["v_sum"], y["v_median"], y["v_mode"], y["s_unique_count"], y["s_mode"], y["s_last_value"]) == (2, 2.0, 2, 0, None, None)


def test_null_keys_can_stay(groups):
    kept = aggregate.aggregate(groups, ["k"], {"v": ["Sum", "Median"]}, keep_null_keys=True, hot_rows=0)
    assert {r["k"]: (r["v_sum"], r["v_median"]) for r in kept.collect()} == {"x": (0, None), "y": (2, 2.0), None: (5, 5.0)}


def test_methods_are_checked(groups):
    with pytest.raises(ValueError):
        aggregate.aggregate(groups, ["k"], {"s": ["Mean"]})
    with pytest.raises(ValueError):
        aggregate.aggregate(groups, ["k"], {"s": ["Last Value"]})
    assert profile.allowed_methods(groups, ["k"])["v"][0] == "Min"


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=997), np.repeat([1.0, 2.0, 3.0], [500, 1, 500]), np.array([7.0]), np.array([1.0, 2.0]),
    np.concatenate([np.zeros(400), [1e300, -1e300], np.random.default_rng(2).integers(0, 9, 300) / 7]), np.array([0.1] * 50 + [0.1 + 1e-16] * 50),
], ids=["normal", "heavy", "one", "two", "outliers", "close"])
def test_narrowed_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = stats.global_quantiles(df, ["v"], probs, hot_rows=0)["v"]
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=1e-12)


def test_group_quantiles_with_one_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else int(i % 3 > 0), float(v)) for i, v in enumerate(rng.exponential(size=600))]
    df = spark.createDataFrame(rows, "k int, v double")
    for limit in (10_000, 100, 0):
        got = {r["k"]: r["q"] for r in stats.group_quantiles(df, ["k"], "v", [0.25, 0.5], "q", hot_rows=limit).collect()}
        assert set(got) == {0, 1, None}
        for k in got:
            assert np.allclose(got[k], np.quantile([v for kk, v in rows if kk == k], [0.25, 0.5]))


def test_quantiles_of_very_many_hot_groups(spark):
    # Column names that the search uses itself, and a null key.
    rows = [(None if i % 40 == 0 else i % 40, float(i * i % 37)) for i in range(400)]
    got = stats.group_quantiles(spark.createDataFrame(rows, "n int, v double"), ["n"], "v", [0.3, 0.5], "j", hot_rows=1).collect()
    assert len(got) == 40
    for r in got:
        assert np.allclose(r["j"], np.quantile([v for k, v in rows if k == r["n"]], [0.3, 0.5]))


def test_numbering_over_ranges(spark):
    rows = [(i % 3 if i % 10 else None, i * 7919 % 101, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, number string").repartition(5)
    got = sorted((r["v"], r["nth"]) for r in numbering.numbered(df, ["v"], "nth").collect())
    assert [n for _, n in got] == list(range(300))
    by_group = {}
    for r in numbering.running_sums(df, ["v"], {"upto": F.col("v")}, ["g"]).collect():
        by_group.setdefault(r["g"], []).append((r["upto"], r["v"]))
    for found in by_group.values():
        total = 0
        for upto, v in sorted(found):
            assert upto == total
            total += v
    assert numbering.numbered(df.limit(0), ["v"]).count() == 0


def test_profile_and_eligibility(spark):
    df = spark.createDataFrame([(1, "a", True, None), (2, "a", False, None), (None, None, True, None)], "n int, t string, b boolean, e double")
    rows = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert (rows["n"]["type_class"], rows["n"]["n_distinct"], rows["n"]["has_nulls"], rows["n"]["mean_value"]) == ("NUMERIC", 2, True, 1.5)
    assert (rows["e"]["n_distinct"], rows["e"]["min_value"]) == (0, None)
    assert rows["b"]["type_class"] == "OTHER"
    use = {r["column_name"]: r["can_use"] for r in profile.feature_eligibility(df, 0).collect()}
    assert use == {"n": True, "t": False, "b": True, "e": True}


def test_strict_datetime_fails(spark):
    df = spark.createDataFrame([("nope",)], "at string")
    assert profile.parse_datetime(df, "at").first()["at"] is None
    with pytest.raises(Exception):
        profile.parse_datetime(df, "at", strict=True).collect()


def test_validation_counts(spark):
    df = spark.createDataFrame([(None, 1), (2, 1)], "id int, x int")
    found = {r["rule"]: r["violations"] for r in profile.validate_tables({"t": df}, {"t": {"id": "id", "target": "y"}}, {"t": ["id"]}).collect()}
    assert found == {"non_empty": 0, "unique_columns": 0, "role:id": 0, "role:target": 1, "key_not_null": 1}
    empty = profile.validate_tables({"t": df.limit(0)}, {}).where("rule = 'non_empty'").first()
    assert empty["violations"] == 1


def test_role_requirements():
    assert roles.requirements("classification", time_series=True)["mandatory"] == ["id", "timestamp"]
    assert roles.requirements("regression", product_level=True, final=True)["mandatory"] == ["id", "product_id"]
    assert roles.requirements("forecasting", final=True)["mandatory"] == ["timestamp", "target"]
    assert roles.requirements("recommendation", user_based=True)["mandatory"] == ["product_id", "id"]
    assert roles.grain_keys({"id": "a", "timestamp": "b", "product_id": "c"}, True, True) == ["a", "b", "c"]
    assert roles.fallback_column(["x", "user_id"], roles.ID_FALLBACKS) == "user_id"
    assert roles.fallback_column(["x", "y"], roles.ID_FALLBACKS, default_first=True) == "x"
    with pytest.raises(ValueError):
        roles.requirements("poetry")


def test_suggested_roles(spark):
    df = spark.createDataFrame([("u1", 3, "2024-01-01", 9.5, 0.1), ("u2", 4, "2024-01-02", 8.5, 0.2)],
                               "user_id string, item_code int, event_date string, sales_amount double, engagement_score double")
    got = {r["role"]: r["column_name"] for r in roles.suggest_roles(df, "recommendation").collect()}
    assert got["id"] == "user_id" and got["product_id"] == "item_code" and got["timestamp"] == "event_date"
    assert got["interaction_value"] == "engagement_score"
    shop = {r["role"]: r["column_name"] for r in roles.suggest_roles(df, "classification").collect()}
    assert shop["revenue"] == "sales_amount"


def test_mapping_merge_and_missing(spark):
    frame = roles.mapping_frame(spark, {"a": {"id": "x", "target": None, "prediction_level": "ID"}, "b": {"id": "y", "target": "t"}})
    assert {r["role"]: r["column_name"] for r in roles.merge_mappings(frame).collect()} == {"id": "y", "target": "t"}
    assert {r["role"]: r["column_name"] for r in roles.merge_mappings(frame, "a").collect()} == {"id": "x", "target": "t"}
    missing = roles.missing_roles(frame, "forecasting", final=True).collect()
    assert {tuple(r) for r in missing} == {("a", "timestamp"), ("a", "target"), ("b", "timestamp")}


def test_apply_and_restore(spark):
    df = spark.createDataFrame([(1, 2.0, "z")], "cust int, amount double, other string")
    named = roles.apply_roles(df, {"id": "cust", "revenue": "amount", "target": None}, keep_rest=True)
    assert named.columns == ["id", "revenue", "other"]
    assert roles.restore_names(named, {"id": "cust", "revenue": "amount"}).columns == ["cust", "amount", "other"]


def test_sample_target(spark):
    df = spark.createDataFrame([(50000,), (75000,), (60000,), (30000,), (90000,)], "income int")
    assert [r["target"] for r in target.add_target(df, "case when income > 60000 then 1 else 0 end").collect()] == [0, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        target.add_target(df.withColumn("target", F.lit(1)), "1")
    assert target.target_needed("regression", {"target": None}, ["a"]) and not target.target_needed("clustering", {}, [])
    assert target.constant_target(df).first()["target"] == 0


def test_targets_with_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None), (None, "a")], "x double, c string")
    assert [r["target"] for r in target.target_median(df, "x").collect()] == [0, 0, 1, 0]
    assert [r["target"] for r in target.target_bins(df, "x").collect()] == ["low", "medium", "high", None]
    assert [r["target"] for r in target.target_combo(df, "c", ["a"], "x", 1.5).collect()] == [1, 1, 1, 1]
    assert [r["target"] for r in target.target_ratio(df.withColumn("z", F.lit(0)), "x", "z").collect()] == [None] * 4
    with pytest.raises(ValueError):
        target.target_wsum(df, {})


def test_time_split_by_month(spark):
    df = spark.sql("select m as id, last_day(make_date(2023, m, 1)) as d from (select explode(sequence(1, 6)) as m)")
    got = {r["id"]: r["split"] for r in splits.split(df, "id", "time", date="d").collect()}
    assert got == {1: "train", 2: "train", 3: "valid", 4: "valid", 5: "valid", 6: "infer"}


@pytest.mark.parametrize("strategy", splits.STRATEGIES)
def test_splits_cover_every_row_once(spark, strategy):
    df = spark.sql("select id, date_add(date'2024-01-01', cast(id as int)) as d, if(id % 7 = 0, null, id) as y from range(400)")
    out = splits.split(df, "id", strategy, date="d", target="y", infer_months=2, cutoff="2024-11-01")
    assert out.count() == 400 and out.where("split not in ('train', 'valid', 'infer') or split is null").count() == 0
    assert out.select("split").distinct().count() == 3
    again = splits.split(df.repartition(7), "id", strategy, date="d", target="y", infer_months=2, cutoff="2024-11-01")
    assert out.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    assert splits.split_summary(out, "d").agg(F.sum("n_rows")).first()[0] == 400


def test_cluster_stats_and_top_n(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "c int, x double")
    rows = {r["c"]: r for r in aggregate.cluster_stats(df, "c").collect()}
    assert rows[0]["n"] == 2 and rows[0]["x_std"] == pytest.approx(2**0.5) and rows[1]["pct"] == pytest.approx(100 / 3)
    assert aggregate.top_n(df, ["c"], [F.col("x").desc()], 1).count() == 2
