"""The pipeline stage by stage, and the queries beside their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tableloom.llm import decontaminate, language, lines
from tableloom.llm.queries import load_queries
from tableloom.session import cut_lineage
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, SF)
    relation = db.execute(SQL[name])
    columns, want = [d[0] for d in relation.description], relation.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_over_all_documents(spark, name):
    found = QUERIES[name](spark, SF)
    ids = found.select("doc_id").distinct().count()
    assert ids == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([
        (90_001, None, None, "s", None), (90_002, "123 456", "en", None, 7), (90_003, "", None, None, 0),
        *[(90_010 + i, docs.where("doc_id = 5").first()["text"], None, "copy", 1) for i in range(3)], (None, docs.where("doc_id = 7").first()["text"], "en", "copy", 1),
    ], docs.schema)
    docs = cut_lineage(docs.unionByName(odd))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert 0 < docs.count() <= before.count()
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert not {90_001, 90_002, 90_003} & ids("language_id")
    assert seen["language_id"].where("lang is null").isEmpty()
    # Copies lose all their lines to the first of them.
    assert not {90_010, 90_011, 90_012, None} & ids("near_dedup")
    assert lines.dropped_lines(seen["line_dedup"]).count() <= 0.02 * seen["line_dedup"].count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(seen["decontamination"], bench).where("n_hit > 0").isEmpty()
    assert ids("packing") == ids("decontamination")
    assert language.words_of(seen["decontamination"].first()["text"])


def test_line_dedup_keeps_what_is_left(spark):
    shared = [f"the shared line number {w} of many pages stands here and there" for w in ("alpha", "beta", "gamma", "delta", "omega")]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["a clean line of its own stays"] + shared)), (3, "\n".join(shared[:2]) + "\n ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert set(got) == {1, 2} and got[1] and got[2] == "a clean line of its own stays"


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.isEmpty()


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 100
