"""Workflows on tables of any names; what is fitted is fitted on the training rows."""

import pytest
from pyspark.sql import functions as F

from tableloom import pipeline
from tableloom.operators.joins import JoinStep


def test_fills_and_codes_come_from_the_training_rows(spark):
    rows = [(f"k{i}", float(i) if i % 3 else None, "rare" if i == 7 else "ab"[i % 2], float(i)) for i in range(60)]
    ready = pipeline.prepared(spark.createDataFrame(rows, "who string, x double, kind string, y double"), "who", "y")
    got = ready.rows.collect()
    train = sorted(r["x"] for r in got if r["split"] == "train" and int(r["who"][1:]) % 3)
    middle = (train[(len(train) - 1) // 2] + train[len(train) // 2]) / 2
    assert all(r["x"] == middle for r in got if int(r["who"][1:]) % 3 == 0)
    assert "x" in ready.inputs and "y" not in ready.inputs and "who" not in ready.inputs
    seen = {rows[int(r["who"][1:])][2] for r in got if r["split"] == "train"}
    assert {n for n in ready.inputs if n.startswith("kind_")} == {f"kind_{v}" for v in seen}


def test_modelling_table_checks_before_it_works(spark):
    left = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "u int, spent double")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "who int, name string")
    known = {"buys": pipeline.Roles({"id": "u"}, {"spent": ["Sum"]}), "people": pipeline.Roles({"id": "who"})}
    step = JoinStep("people", "buys", (("who", "u"),), "left")
    out = pipeline.modelling_table({"buys": left, "people": right}, known, "classification", [step], lambda df: df.withColumn("target", F.col("spent_sum") > 4))
    assert sorted((r["who"], r["spent_sum"], r["target"]) for r in out.collect() if r["spent_sum"]) == [(1, 5.0, True), (2, 5.0, True)]
    with pytest.raises(ValueError, match="roles without a column"):
        pipeline.modelling_table({"buys": left}, {"buys": pipeline.Roles({"revenue": "spent"})}, "classification")
    with pytest.raises(ValueError, match="validation"):
        pipeline.modelling_table({"buys": left.limit(0)}, {"buys": pipeline.Roles({"id": "u"})}, "classification")


def test_clusters_and_their_notes(spark):
    rows = [(i, float(i % 3) * 100 + (i // 3) % 5) for i in range(90)]
    found = pipeline.clusters(spark.createDataFrame(rows, "id int, x double"), "id", ["x"], eps=0.1, min_samples=3)
    assert found.rows.groupBy(f"{found.best}_cluster").count().count() == 3
    assert {r["model"] for r in found.metrics.collect()} == {"kmeans", "dbscan"}


def test_recommendation_takes_items_where_there_are_no_users(spark):
    rows = [(f"i{n % 12}", float(n % 12), "ab"[n % 2]) for n in range(120)]
    found = pipeline.recommend(spark.createDataFrame(rows, "item string, price double, kind string"), "item", ["price", "kind"])
    assert found.best == "item_based" and found.rows.count() > 0
