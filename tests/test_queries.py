"""Every query beside its SQL on the smallest tables, and the shape of the plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tableloom.plans import load_queries
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_queries()
# Queries that multiply blocks of vectors or fit small series with numpy inside tasks.
NUMPY = {
    "cooccurrence_large_baskets", "cosine_pairs", "similar_users", "similar_items", "similarity_stats", "reco_param_impact", "reco_preview",
    "recommend_user", "recommend_item", "reco_metrics", "reco_text", "reco_evidence", "wf_recommend", "knn_distance", "silhouette",
    "forecast_ar", "wf_forecast",
}
SLOW = {"wf_event_users", "train_regressors", "train_classifiers", "wf_classification", "wf_regression", "wf_clustering", "kmeans_choose_k"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in NUMPY:
        assert "Pandas" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
    relation = db.execute(ORACLE[name])
    columns, want = [d[0] for d in relation.description], relation.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_scans_read_only_what_is_needed(spark):
    def scans(name):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return [line for line in text.splitlines() if "FileScan" in line]

    assert any("PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,250000.0)]" in s for s in scans("parquet_scan"))
    assert all("l_tax" not in s and "l_shipdate" not in s for s in scans("join_plan_fold"))
    assert any("ReadSchema: struct<o_orderpriority:string>" in s for s in scans("value_distribution"))
