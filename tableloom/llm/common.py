"""What the operators share: registration of their queries, input columns, batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Rows that Spark hands to a Python worker at once, and the bytes at which it cuts a batch sooner.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that a run of very long texts does not fill a worker."""
    configure(spark)
    # Steps that are written take less of the shared folder.
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(spark, sf_dir)`, with an equal DuckDB statement where SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(batches(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, also where the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
