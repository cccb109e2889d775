"""Deterministic train / valid / infer splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableloom.functions.scalars import hash_bucket, month_index
from tableloom.functions.stats import global_quantiles

STRATEGIES = ("time", "missing_target", "random", "last_n", "chrono", "cutoff")


def _by_month(df: DataFrame, date: str, valid_months: int, infer_months: int) -> Column:
    newest = df.agg(month_index(F.max(date))).scalar()
    ago = newest - month_index(F.col(date))
    return F.when(ago < infer_months, "infer").when(ago < infer_months + valid_months, "valid").otherwise("train")


def _by_bucket(key: str, ratios: Sequence[int]) -> Column:
    # Rows without a key share a bucket.
    bucket = F.coalesce(hash_bucket(F.col(key), sum(ratios)), F.lit(0))
    label = F.when(bucket < ratios[0], "train").when(bucket < ratios[0] + ratios[1], "valid")
    return label.otherwise("infer")


def split(
    df: DataFrame, key: str, strategy: str, date: str | None = None, target: str | None = None,
    valid_months: int = 3, infer_months: int = 1, ratios: Sequence[int] = (70, 20, 10), cutoff: str | None = None,
) -> DataFrame:
    """Add a `split` column. Every row lands in exactly one part; rows without a date train."""
    if strategy == "time":
        label = _by_month(df, date, valid_months, 1)
    elif strategy == "last_n":
        label = _by_month(df, date, valid_months, infer_months)
    elif strategy == "missing_target":
        label = F.when(F.col(target).isNull(), "infer").otherwise(_by_bucket(key, (80, 20, 0)))
    elif strategy == "random":
        label = _by_bucket(key, ratios)
    elif strategy == "chrono":
        days = df.select(F.unix_date(F.col(date).cast("date")).cast("double").alias("d"))
        total = sum(ratios)
        first, second = global_quantiles(days, ["d"], [ratios[0] / total, (ratios[0] + ratios[1]) / total])["d"]
        day = F.unix_date(F.col(date).cast("date")).cast("double")
        label = F.when(day > second, "infer").when(day > first, "valid").otherwise("train")
    elif strategy == "cutoff":
        limit = F.lit(cutoff).cast("date")
        before = F.col(date).cast("date") < F.add_months(limit, -valid_months)
        label = F.when(F.col(date).cast("date") >= limit, "infer").when(before | F.col(date).isNull(), "train").otherwise("valid")
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return df.withColumn("split", label)


def split_summary(df: DataFrame, date: str) -> DataFrame:
    """Date range and rows per part."""
    return df.groupBy("split").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n_rows")
    )
