"""Profiles of whole tables: types, nulls, distinct values, distributions, correlations, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.functions.scalars import named, to_number
from tableloom.functions.stats import global_quantiles, value_counts

NUMERIC, TEXT, DATETIME, OTHER = "NUMERIC", "TEXT", "DATETIME", "OTHER"
# Aggregation methods each type class allows.
ALLOWED_METHODS = {
    NUMERIC: ("Min", "Max", "Sum", "Mean", "Median", "Mode", "Last Value"),
    TEXT: ("Mode", "Last Value", "Unique Count"),
    DATETIME: ("Min", "Max", "Last Value"),
    OTHER: ("Last Value",),
}


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.StringType):
        return TEXT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def numeric_columns(df: DataFrame, boolean: bool = False) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) or (boolean and isinstance(f.dataType, T.BooleanType))
    ]


def allowed_methods(df: DataFrame, keys: Sequence[str] = ()) -> dict[str, tuple[str, ...]]:
    """Methods offered per column; grain keys are never aggregated."""
    return {f.name: ALLOWED_METHODS[type_class(f.dataType)] for f in df.schema.fields if f.name not in keys}


def _one_row_to_long(df: DataFrame, aggs: dict[str, dict[str, Column]], lead: str = "column_name") -> DataFrame:
    """Run all aggregates of all columns in one pass, then turn the single row into one row per column."""
    wide = df.agg(*[F.struct(*[e.alias(n) for n, e in fields.items()]).alias(c) for c, fields in aggs.items()])
    rows = [F.struct(F.lit(c).alias("__c"), F.col(f"`{c}`").alias("__s")) for c in aggs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select(F.col("r.__c").alias(lead), "r.__s.*")


def profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: type class, rows, distinct values, has_nulls and, for numbers, min, max and mean."""
    columns = list(columns or df.columns)
    classes = {f.name: type_class(f.dataType) for f in df.schema.fields}
    # Distinct counts run on their own: next to them the plain aggregates would be expanded per column too.
    distinct = distinct_counts(df, columns, approx)
    aggs = {}
    for c in columns:
        col = F.col(f"`{c}`")
        number = classes[c] == NUMERIC
        value = col.cast("double") if number else F.lit(None).cast("double")
        aggs[c] = {
            "type_class": F.lit(classes[c]),
            "n_rows": F.count(F.lit(1)),
            "has_nulls": F.count(col) < F.count(F.lit(1)),
            "min_value": F.min(value),
            "max_value": F.max(value),
            "mean_value": F.avg(value),
        }
    return _one_row_to_long(df, aggs).join(distinct, "column_name").select(
        "column_name", "type_class", "n_rows", "n_distinct", "has_nulls", "min_value", "max_value", "mean_value")


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """(column_name, n_distinct), nulls not counted."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return _one_row_to_long(df, {c: {"n_distinct": count(F.col(f"`{c}`"))} for c in columns})


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear) and max of every numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = global_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = {}
    for c in columns:
        col = F.col(f"`{c}`").cast("double")
        q25, q50, q75 = (F.lit(q).cast("double") for q in quartiles[c])
        aggs[c] = {
            "n": F.count(col), "mean_value": F.avg(col), "std_value": F.stddev_samp(col),
            "min_value": F.min(col), "q25": q25, "q50": q50, "q75": q75, "max_value": F.max(col),
        }
    return _one_row_to_long(df, aggs)


def feature_stats(df: DataFrame, features: Sequence[str], top: int = 3) -> DataFrame:
    """Null share, distinct share and the `top` most frequent values per feature, from one count of values."""
    counts = value_counts(df, features)
    rank = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    )
    best = (
        counts.where(F.col("value").isNotNull()).withColumn("rk", rank).where(F.col("rk") <= top)
        .groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("rk", "value", "n"))).alias("t"))
        .select("column_name", F.array_join(
            F.transform("t", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ", ").alias("top_values"))
    )
    totals = counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
    )
    share = F.col("n_null") / F.col("n_rows")
    return totals.join(best, "column_name", "left").select(
        "column_name", "n_distinct", share.alias("null_percentage"), (share * 100).alias("missing_pct"),
        (F.col("n_distinct") / F.col("n_rows")).alias("unique_ratio"), "top_values",
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; null where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (a before b), each over the rows where both are present."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def feature_eligibility(df: DataFrame, max_categories: int = 10) -> DataFrame:
    """is_numeric (numbers and booleans), unique_count and can_use = numeric or few categories."""
    numbers = set(numeric_columns(df, boolean=True))
    base = distinct_counts(df, df.columns).withColumnRenamed("n_distinct", "unique_count")
    is_numeric = F.col("column_name").isin(*numbers) if numbers else F.lit(False)
    return base.select(
        "column_name", is_numeric.alias("is_numeric"), "unique_count",
        (is_numeric | (F.col("unique_count") <= max_categories)).alias("can_use"),
    )


def interaction_density(df: DataFrame, user: str, item: str) -> DataFrame:
    """Users, items, rows, rows / (users x items) and mean rows per item."""
    one = df.agg(
        F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return one.select(
        "n_users", "n_items", "n_rows",
        F.try_divide(F.col("n_rows").cast("double"), F.col("n_users").cast("double") * F.col("n_items")).alias("density"),
        F.try_divide(F.col("n_rows").cast("double"), F.col("n_items").cast("double")).alias("rows_per_item"),
    )


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(named(col).isNotNull()).groupBy(named(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")
    )


def row_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step and the reduction in percent (null without input rows)."""
    counted = before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
        "rows_after", after.agg(F.count(F.lit(1))).scalar()
    )
    lost = (F.col("rows_before") - F.col("rows_after")) * 100.0
    return counted.withColumn("reduction_pct", F.try_divide(lost, F.col("rows_before").cast("double")))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order; Spark keeps only n rows per task."""
    return df.orderBy(*order_by).limit(n)


def standardise_types(
    df: DataFrame, ids: Sequence[str] = (), months: Sequence[str] = (), casts: dict[str, str] | None = None
) -> DataFrame:
    """Identifiers as text, dates as 'yyyy-MM', other casts as given; values that do not fit become null."""
    changes = {c: named(c).cast("string") for c in ids}
    changes |= {c: F.date_format(named(c).cast("date"), "yyyy-MM") for c in months}
    changes |= {c: named(c).try_cast(t) for c, t in (casts or {}).items()}
    return df.withColumns(changes)


def conversion_losses(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per column that a conversion turned into null."""
    # One pass each side; only counts meet.
    old = _one_row_to_long(before, {c: {"n_before": F.count(F.col(c))} for c in columns})
    new = _one_row_to_long(after, {c: {"n_after": F.count(F.col(c))} for c in columns})
    return old.join(new, "column_name").select(
        "column_name", (F.col("n_before") - F.col("n_after")).alias("n_lost")
    )


def parse_datetime(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd HH:mm:ss", strict: bool = False) -> DataFrame:
    """Text to a timestamp without time zone; unreadable text fails when strict, else becomes null."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumn(col, parse(F.col(col), F.lit(fmt) if not strict else fmt).cast("timestamp_ntz"))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers where the text is one, null otherwise."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def validate_tables(
    tables: dict[str, DataFrame], mandatory: dict[str, dict[str, str]], keys: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per (table, rule) with the number of violations: non_empty, unique_columns, role:*, key_not_null."""
    frames = []
    for name, df in tables.items():
        lower = [c.lower() for c in df.columns]
        mapping = mandatory.get(name, {})
        checks = {
            "non_empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint"),
            "unique_columns": F.lit(len(lower) - len(set(lower))).cast("bigint"),
        }
        for role, column in mapping.items():
            checks[f"role:{role}"] = F.lit(int(column not in df.columns)).cast("bigint")
        present = [k for k in (keys or {}).get(name, []) if k in df.columns]
        if present:
            any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in present])
            checks["key_not_null"] = F.count_if(any_null)
        long = _one_row_to_long(df, {rule: {"violations": e} for rule, e in checks.items()}, lead="rule")
        frames.append(long.select(F.lit(name).alias("table_name"), "rule", "violations"))
    return reduce(DataFrame.unionByName, frames)
