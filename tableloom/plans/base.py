"""Registration of queries with their SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableloom.functions.scalars import rounded
from tableloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(spark, sf_dir)` under `name`, with an equal DuckDB statement where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def r(expr: str, digits: int) -> str:
    """SQL twin of `rounded`."""
    return f"round({expr} + 1e-{digits + 3:02d}, {digits})"


def money(expr: str) -> str:
    """SQL twin of `money_sum`."""
    return f"sum(({expr})::decimal(18,2))::double"


def round_all(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns, or every double column."""
    names = cols or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: rounded(F.col(c), digits) for c in names})


def day(col: str | Column) -> Column:
    """Date as text, which compares alike on every engine."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd")


def sql_day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# --- facts about the columns of a table, for SQL that must not name them ---

_KINDS = "case when t similar to '(TINYINT|SMALLINT|INTEGER|BIGINT|HUGEINT|FLOAT|DOUBLE|DECIMAL.*)' then 'NUMERIC' when t = 'VARCHAR' then 'TEXT' when t = 'DATE' or t like 'TIMESTAMP%' then 'DATETIME' else 'OTHER' end"


def sql_columns(*names: str) -> str:
    """SQL: (table_name, place, column_name, t, kind) for every column of the named tables; `place` counts the tables."""
    parts = " union all ".join(f"select '{n}' as table_name, {i} as place, column_name, column_type as t from (describe {n})" for i, n in enumerate(names))
    return f"(select *, {_KINDS} as kind from ({parts}))"


def sql_cells(*names: str, where: str = "true") -> str:
    """SQL: (table_name, column_name, value text) for every non-null cell of the named tables."""
    return "(" + " union all ".join(
        f"select '{n}' as table_name, column_name, value from (unpivot (select columns(*)::varchar from {n} where {where}) on columns(*) into name column_name value value)" for n in names) + ")"
