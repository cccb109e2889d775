"""Aggregation of a table to a grain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.functions import stats
from tableloom.functions.scalars import named
from tableloom.operators.profile import ALLOWED_METHODS, _one_row_to_long, numeric_columns, type_class


def _keys_present(df: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def needs_aggregation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: does any group of the grain hold more than one row?"""
    sizes = df.where(_keys_present(df, keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("needed"))


def output_name(feature: str, method: str) -> str:
    return f"{feature}_{method.lower().replace(' ', '_')}"


def check_methods(df: DataFrame, keys: Sequence[str], methods: dict[str, Sequence[str]]) -> None:
    for feature, wanted in methods.items():
        if feature in keys:
            raise ValueError(f"{feature} is a grain key")
        allowed = ALLOWED_METHODS[type_class(df.schema[feature].dataType)]
        wrong = [m for m in wanted if m not in allowed]
        if wrong:
            raise ValueError(f"{feature}: {wrong} not among {allowed}")


def _combining(feature: str, method: str, order_by: Sequence[str]) -> Column | None:
    """Aggregates whose state per group has a fixed size."""
    col = F.col(feature)
    if method == "Min":
        return F.min(col)
    if method == "Max":
        return F.max(col)
    if method == "Sum":
        return F.coalesce(F.sum(col), F.lit(0))
    if method == "Mean":
        return F.avg(col)
    if method == "Last Value":
        if not order_by:
            raise ValueError("'Last Value' needs order_by: rows of a table have no order of their own")
        # Wrapped in a struct, so that a null in the last row is the answer.
        return F.max_by(F.struct(col.alias("v")), F.struct(*order_by))["v"]
    return None


def _collecting(feature: str, method: str) -> Column:
    """Aggregates whose state grows with the values of a group; for groups of bounded size."""
    col = F.col(feature)
    if method == "Median":
        return F.median(col)
    if method == "Mode":
        return F.mode(col, True)
    return F.size(F.collect_set(col)).cast("bigint")


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    methods: dict[str, Sequence[str]],
    order_by: Sequence[str] = (),
    keep_null_keys: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per grain key with a column `{feature}_{method}` for every chosen method.

    Rows with a null key are dropped unless asked for. Groups up to `hot_rows` rows are done in one
    pass; medians, modes and distinct counts of larger groups go through the skew-safe forms.
    """
    keys = list(keys)
    methods = {f: list(ms) for f, ms in methods.items() if ms}
    check_methods(df, keys, methods)
    if any("." in c for c in df.columns):
        # Dots would read as fields: the work is done under plain names.
        plain = {c: f"__c{i}" for i, c in enumerate(df.columns)}
        done = aggregate(
            df.toDF(*plain.values()), [plain[k] for k in keys], {plain[f]: ms for f, ms in methods.items()}, [plain.get(o, o) for o in order_by],
            keep_null_keys, hot_rows)
        return done.toDF(*keys, *[output_name(f, m) for f, ms in methods.items() for m in ms])
    rows = df if keep_null_keys else df.where(_keys_present(df, keys))
    rows = rows.select(*dict.fromkeys([*keys, *methods, *order_by]))
    names = [(f, m, output_name(f, m)) for f, ms in methods.items() for m in ms]
    fixed = [_combining(f, m, order_by) for f, m, _ in names]
    growing = [n for n, e in zip(names, fixed) if e is None]

    def one_pass(part: DataFrame) -> DataFrame:
        exprs = [(e if e is not None else _collecting(f, m)).alias(o) for (f, m, o), e in zip(names, fixed)]
        return part.groupBy(*keys).agg(*exprs)

    if not growing:
        return one_pass(rows)
    hot = stats.hot_groups(rows, keys, hot_rows)
    if hot is None:
        return one_pass(rows)
    cold = one_pass(stats.of_groups(rows, keys, hot, "left_anti"))
    large = _skew_safe(stats.of_groups(rows, keys, hot, "left_semi"), keys, names, fixed, hot_rows)
    return cold.unionByName(large)


def _skew_safe(rows: DataFrame, keys, names, fixed, hot_rows) -> DataFrame:
    base = [e.alias(o) for (_, _, o), e in zip(names, fixed) if e is not None]
    result = rows.groupBy(*keys).agg(*(base or [F.count(F.lit(1)).alias("__n")]))
    for (f, m, o), e in zip(names, fixed):
        if e is not None:
            continue
        if m == "Mode":
            part = stats.group_modes(rows, keys, f, o)
        elif m == "Median":
            part = stats.group_quantiles(rows, keys, f, [0.5], "__q", hot_rows).select(*keys, F.col("__q")[0].alias(o))
        else:
            pairs = rows.where(F.col(f).isNotNull()).select(*keys, f).distinct()
            part = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(o))
        renamed = part.toDF(*[f"__{k}" for k in keys], o)
        match = stats.key_match([result[k] for k in keys], [renamed[f"__{k}"] for k in keys])
        result = result.join(renamed, match, "left").drop(*[f"__{k}" for k in keys])
        if m == "Unique Count":
            result = result.withColumn(o, F.coalesce(o, F.lit(0)))
    return result.select(*keys, *[o for _, _, o in names])


def suggest_aggs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Methods per column with the reason, from one profile pass (rules and thresholds are parameters of ours)."""
    aggs = {}
    for f in df.schema.fields:
        if f.name in keys:
            continue
        kind = type_class(f.dataType)
        number = F.col(f"`{f.name}`").cast("double") if kind == "NUMERIC" else F.lit(None).cast("double")
        boolean = isinstance(f.dataType, T.BooleanType)
        aggs[f.name] = {
            "kind": F.lit("BOOLEAN" if boolean else kind), "skew": F.skewness(number),
            "low": F.min(number), "mean": F.avg(number), "std": F.stddev_samp(number),
        }
    long = _one_row_to_long(df, aggs)
    wide_range = F.abs(F.try_divide(F.col("std"), F.col("mean"))) > 0.5
    rules = [
        (F.col("kind") == "TEXT", "Unique Count", "text: how many different values"),
        (F.col("kind") == "TEXT", "Mode", "text: the usual value"),
        (F.col("kind") == "TEXT", "Last Value", "text: the latest value"),
        ((F.col("kind") == "NUMERIC") & (F.abs("skew") <= 1), "Mean", "number, little skew"),
        ((F.col("kind") == "NUMERIC") & (F.abs("skew") > 1), "Median", "number, skewed"),
        ((F.col("kind") == "NUMERIC") & wide_range, "Min", "number, wide range"),
        ((F.col("kind") == "NUMERIC") & wide_range, "Max", "number, wide range"),
        ((F.col("kind") == "NUMERIC") & (F.col("low") >= 0), "Sum", "number, never negative, adds up"),
        (F.col("kind") == "DATETIME", "Max", "date: latest"),
        (F.col("kind") == "DATETIME", "Min", "date: first"),
        (F.col("kind") == "BOOLEAN", "Last Value", "flag: the latest value"),
        (F.col("kind") == "OTHER", "Last Value", "other type: the latest value"),
    ]
    picks = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(m).alias("method"), F.lit(why).alias("explanation"))) for cond, m, why in rules]),
        lambda x: x.isNotNull(),
    )
    return long.select("column_name", F.explode(picks).alias("p")).select("column_name", "p.*")


def series_by_date(df: DataFrame, date: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per date (and series): target summed, every other number averaged."""
    others = [c for c in numeric_columns(df) if c not in (target, date, *by)]
    return df.where(F.col(date).isNotNull()).groupBy(*by, date).agg(
        F.coalesce(F.sum(target), F.lit(0)).alias(target), *[F.avg(c).alias(c) for c in others]
    )


def cluster_stats(df: DataFrame, label: str, columns: Sequence[str] | None = None, max_numeric: int = 5) -> DataFrame:
    """Size, share and mean / sample std per cluster, of the named columns or of the first numeric ones."""
    cols = list(columns) if columns else [c for c in numeric_columns(df) if c != label][:max_numeric]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(named(c)).alias(f"{c}_mean"), F.stddev_samp(named(c)).alias(f"{c}_std")]
    sized = df.groupBy(named(label).alias(label)).agg(*aggs)
    # The window runs over one row per cluster.
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sized.withColumn("pct", share)


def prediction_stats(df: DataFrame, prediction: str, positive_at: float | None = None) -> DataFrame:
    """Rows, mean, min, max of a score; with `positive_at` also positives and their share."""
    aggs = [F.count(prediction).alias("n"), F.avg(prediction).alias("mean_value"),
            F.min(prediction).alias("min_value"), F.max(prediction).alias("max_value")]
    if positive_at is not None:
        hit = F.col(prediction) >= positive_at
        aggs += [F.count_if(hit).alias("n_positive"),
                 F.try_divide(F.count_if(hit) * 100.0, F.count(prediction)).alias("positive_pct")]
    return df.agg(*aggs)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per entity with their `rank`. Spark drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
