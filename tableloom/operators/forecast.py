"""Monthly series and forecasts per series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableloom.functions.scalars import month_index, named, to_number
from tableloom.session import cut_lineage

MAX_HORIZON, DEFAULT_HORIZON = 6, 3


def horizon(periods: object) -> int:
    """Number of months: at most 6, 3 when missing or not a number."""
    try:
        return min(int(periods), MAX_HORIZON)
    except (TypeError, ValueError):
        return DEFAULT_HORIZON


def month_end(start: Column, step: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(start, "MM"), step))


def month_of(t: Column) -> Column:
    """Month end of a month index."""
    year = F.floor((t - 1) / 12)
    return F.last_day(F.make_date(year.cast("int"), (t - year * 12).cast("int"), F.lit(1)))


def month_grid(df: DataFrame, date: str, periods: object = None, by: Sequence[str] = ()) -> DataFrame:
    """Month ends from the month of the first date on, per series."""
    start = df.groupBy(*by).agg(F.min(F.col(date).cast("date")).alias("__start")).where("__start is not null")
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon(periods) - 1))).alias("step")
    return start.select(*by, "__start", steps).select(*by, "step", month_end(F.col("__start"), F.col("step")).alias("date"))


def exog_hold(df: DataFrame, date: str, exog: Sequence[str], order_by: Sequence[str] = (), periods: object = None, by: Sequence[str] = ()) -> DataFrame:
    """Month grid with the inputs of the first row (by date, then `order_by`), as numbers, in every month."""
    held = F.min_by(F.struct(*[to_number(F.col(c)).alias(c) for c in exog]), F.struct(date, *order_by)).alias("__x")
    first = df.where(F.col(date).isNotNull()).groupBy(*by).agg(held, F.min(F.col(date).cast("date")).alias("__start"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon(periods) - 1))).alias("step")
    return first.select(*by, "__x", "__start", steps).select(
        *by, "step", month_end(F.col("__start"), F.col("step")).alias("date"), *[F.col("__x")[c].alias(c) for c in exog])


def monthly_series(df: DataFrame, date: str, value: Column | str, by: Sequence[str] = (), out: str = "y") -> DataFrame:
    """Sum per calendar month 'yyyy-MM' (and series); also the running month number `t`."""
    value = F.col(value) if isinstance(value, str) else value
    return df.where(F.col(date).isNotNull()).groupBy(*by, F.date_format(date, "yyyy-MM").alias("month"), month_index(F.col(date)).alias("t")).agg(
        F.sum(value).alias(out))


def lag_features(series: DataFrame, y: str, lags: Sequence[int], by: Sequence[str] = (), order: str = "t") -> DataFrame:
    """The value of each series `k` months earlier by the calendar; null where that month is missing."""
    out = series
    for k in lags:
        earlier = series.select(*[F.col(b).alias(f"__{b}") for b in by], (F.col(order) + k).alias("__t"), F.col(y).alias(f"{y}_lag{k}"))
        match = reduce(lambda a, b: a & b, [out[b].eqNullSafe(earlier[f"__{b}"]) for b in by], out[order] == earlier["__t"])
        out = out.join(earlier, match, "left").drop("__t", *[f"__{b}" for b in by])
    return out


def forecast_trend_season(series: DataFrame, y: str, by: Sequence[str] = (), periods: object = None) -> DataFrame:
    """Linear trend plus mean residual per calendar month; one row per series and future month.

    `series` has one row per month with the month number `t`. All series are fitted in one job by
    closed-form aggregates; a month never seen before gets no seasonal part.
    """
    if not by:
        # One series: a constant key keeps the joins equi-joins.
        single = forecast_trend_season(series.withColumn("__all", F.lit(0)), y, ["__all"], periods)
        return single.drop("__all")
    base = F.col("t") - 1970 * 12
    x = base.cast("double")
    value = F.col(y).cast("double")
    fit = series.groupBy(*by).agg(
        F.regr_slope(value, x).alias("slope"), F.regr_intercept(value, x).alias("icept"), F.avg(value).alias("level"),
        F.max("t").alias("last"),
    ).withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "icept": F.coalesce("icept", "level")})
    on = list(by)
    joined = series.join(fit, on)
    residual = value - (F.col("icept") + F.col("slope") * x)
    season = joined.groupBy(*on, (F.col("t") % 12).alias("moy")).agg(F.avg(residual).alias("season"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon(periods)))).alias("step")
    grid = fit.select(*on, "slope", "icept", "last", steps).withColumn("t", F.col("last") + F.col("step")).withColumn("moy", F.col("t") % 12)
    full = grid.join(season, [*on, "moy"], "left")
    predicted = F.col("icept") + F.col("slope") * (F.col("t") - 1970 * 12).cast("double") + F.coalesce("season", F.lit(0.0))
    return full.select(*on, "step", month_of(F.col("t")).alias("date"), predicted.alias(f"Predicted {y}"))


def forecast_ar(
    series: DataFrame, y: str, by: Sequence[str], exog: Sequence[str] = (), lags: Sequence[int] = (1, 12), periods: object = None
) -> DataFrame:
    """Least squares on earlier values and outside inputs per series, carried forward month by month.

    Inputs are held at their last value. Each series is one row per month, so a group is small. Lags go by the calendar:
    months that are missing teach nothing and stand for the line between their neighbours where a forecast needs them.
    Series with too few months to learn from repeat their mean.
    """
    steps, longest = horizon(periods), max(lags)
    by, exog = list(by), list(exog)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        seen = pdf[y].to_numpy(dtype=float)
        months = pdf["t"].to_numpy()
        place = (months - months[0]).astype(int)
        values = np.full(place[-1] + 1, np.nan)
        values[place] = seen
        inputs = np.full((len(values), len(exog)), np.nan)
        inputs[place] = pdf[exog].to_numpy(dtype=float) if exog else np.zeros((len(pdf), 0))
        known = np.isfinite(values)
        history = list(np.interp(np.arange(len(values)), np.flatnonzero(known), values[known])) if known.any() else [np.nan] * len(values)
        rows = [i for i in range(longest, len(values)) if known[i] and all(known[i - k] for k in lags) and np.isfinite(inputs[i]).all()]
        held = inputs[-1]
        coef = None
        if len(rows) > len(lags) + len(exog):
            # Centred, so that large values leave the digits of small effects.
            design = np.array([[*[values[i - k] for k in lags], *inputs[i]] for i in rows])
            middle, level = design.mean(axis=0), values[rows].mean()
            coef = np.linalg.lstsq(design - middle, values[rows] - level, rcond=None)[0]
        out = []
        for _ in range(steps):
            nxt = float(np.nanmean(values)) if coef is None else float(level + np.dot(coef, np.array([*[history[-k] for k in lags], *held]) - middle))
            history.append(nxt)
            out.append(nxt)
        result = pd.DataFrame({"step": range(1, steps + 1), "t": int(pdf["t"].iloc[-1]) + np.arange(1, steps + 1), "p": out})
        for name, part in zip(by, key):
            result[name] = part
        return result[[*by, "step", "t", "p"]]

    schema = T.StructType([series.schema[c] for c in by] + [
        T.StructField("step", T.IntegerType()), T.StructField("t", T.LongType()), T.StructField("p", T.DoubleType())])
    done = series.select(*by, "t", y, *exog).groupBy(*by).applyInPandas(fit, schema)
    return done.select(*by, "step", month_of(F.col("t")).alias("date"), F.col("p").alias(f"Predicted {y}"))


def forecast_trees(
    series: DataFrame, y: str, by: Sequence[str], lags: Sequence[int] = (1, 2, 3, 12), periods: object = None, max_iter: int = 20, max_depth: int = 4, seed: int = 42,
) -> DataFrame:
    """One boosted-tree model of all series on earlier values, carried forward month by month; as `forecast_ar` in shape.

    The model learns how a month differs from the month before, which lets a series leave the range that it was learned on.
    Inputs are those differences at the calendar lags and the month of the year. A month that is missing, or that no
    series reaches back to, teaches nothing; where a forecast needs it, the latest known difference of the series, else 0, stands for it. Where
    no month teaches anything, the last value is repeated. Every month ahead is one job over all series.
    """
    by, steps = list(by), horizon(periods)
    if not by:
        return forecast_trees(series.withColumn("__all", F.lit(0)), y, ["__all"], lags, periods, max_iter, max_depth, seed).drop("__all")
    inputs = [*[f"d_lag{k}" for k in lags], "moy"]
    known = cut_lineage(series.where(named(y).isNotNull()).select(*by, "t", named(y).cast("double").alias("v")))
    steps_known = cut_lineage(_differences(known, by))

    def described(rows: DataFrame) -> DataFrame:
        return lag_features(rows, "d", lags, by).withColumn("moy", F.col("t") % 12)

    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    lessons = described(steps_known).dropna(subset=["d", *inputs])
    lessons = cut_lineage(lessons.select("d", *inputs))
    model = None if lessons.isEmpty() else GBTRegressor(labelCol="d", featuresCol="features", maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(assembler.transform(lessons))
    last = known.groupBy(*by).agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))
    latest = steps_known.groupBy(*by).agg(F.max_by("d", "t").alias("usual"))
    now = cut_lineage(last.join(latest, by, "left").withColumn("usual", F.coalesce("usual", F.lit(0.0))))
    history, ahead = steps_known, []
    for step in range(1, steps + 1):
        # The month to come, of all series at once; what it looks back to are values and what was predicted before.
        coming = now.select(*by, (F.col("t") + 1).alias("t"), "v", "usual")
        if model is None:
            now = coming
        else:
            asked = coming.select(*by, "t", F.lit(None).cast("double").alias("d"))
            seen = history.join(coming.select(*by, F.col("t").alias("__to")), by).where(F.col("t") >= F.col("__to") - max(lags)).drop("__to")
            ready = described(seen.unionByName(asked)).where("d is null").drop("d").join(coming.select(*by, "v", "usual"), by)
            ready = ready.withColumns({c: F.coalesce(c, "usual") for c in inputs[:-1]})
            found = cut_lineage(model.transform(assembler.transform(ready)).select(*by, "t", F.col("prediction").alias("d"), "v", "usual"))
            history = history.unionByName(found.select(*by, "t", "d"))
            now = found.select(*by, "t", (F.col("v") + F.col("d")).alias("v"), "usual")
        ahead.append(now.select(*by, F.lit(step).alias("step"), month_of(F.col("t")).alias("date"), F.col("v").alias(f"Predicted {y}")))
    return reduce(DataFrame.unionByName, ahead)


def _differences(known: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, t, d): the change of every month from the month before, where both are known."""
    return lag_features(known, "v", [1], by).where("v_lag1 is not null").select(*by, "t", (F.col("v") - F.col("v_lag1")).alias("d"))


def forecast_table(forecasts: DataFrame, y: str, by: Sequence[str], model: str) -> DataFrame:
    """One row per series: the model, the first and the last month ahead, their number, and the sum and mean of what is predicted."""
    p = named(f"Predicted {y}")
    return forecasts.groupBy(*by).agg(
        F.lit(model).alias("model"), F.min("date").alias("period_from"), F.max("date").alias("period_to"), F.count(p).alias("periods"),
        F.sum(p).alias("total"), F.avg(p).alias("mean"))
