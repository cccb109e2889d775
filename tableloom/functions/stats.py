"""Exact statistics that hold up when one group carries a third of all rows.

Sums, minima, averages and counts combine on the map side and need no care. Quantiles, modes and
distinct counts keep state that grows with the values of a group, so groups above `HOT_ROWS` rows
take another route: modes and distinct counts first count (group, value) pairs, which spreads a hot
group over all tasks; quantiles narrow a value range by histograms that combine on the map side. Which groups
are hot, the ranges and the histograms are tables: nothing that grows with the groups reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.functions.scalars import named
from tableloom.session import cut_lineage

# Rows per group that one task may hold as the state of a quantile, mode or set.
HOT_ROWS = 200_000
HISTOGRAM_BINS = 1024


def key_match(left_keys: Sequence[Column], right_keys: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left_keys, right_keys)])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """A written table of the keys, as __k0, __k1, ..., of the groups with more than `hot_rows` rows; None if there is none."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    found = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    found = cut_lineage(found.drop("__n") if keys else found.select(F.lit(0).alias("__all")))
    return None if found.isEmpty() else found


def of_groups(df: DataFrame, keys: Sequence[str], listed: DataFrame, how: str) -> DataFrame:
    """The rows of `df` whose group is among those of `hot_groups` (`how` left_semi) or is not (left_anti)."""
    if not keys:
        return df if how == "left_semi" else df.limit(0)
    return df.join(listed, key_match([df[f"`{k}`"] for k in keys], [listed[f"__k{i}"] for i in range(len(keys))]), how)


def group_modes(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Most frequent non-null value per group, smallest on ties; counted in two levels."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(col), F.struct(-F.col("__n"), F.col(col))).alias(out)
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    probs: Sequence[float],
    out: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group as an array column `out`."""
    names = [f"__q{i}" for i in range(len(keys))]
    values = df.where(F.col(f"`{col}`").isNotNull()).select(*[F.col(f"`{k}`").alias(q) for k, q in zip(keys, names)], F.col(f"`{col}`").cast("double").alias("__v"))
    hot = hot_groups(values, names, hot_rows)
    direct = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias(out)
    if hot is None:
        return values.groupBy(*names).agg(direct).toDF(*keys, out)
    large = _narrowed_quantiles(of_groups(values, names, hot, "left_semi"), names, probs, out)
    if not keys:
        return large
    return of_groups(values, names, hot, "left_anti").groupBy(*names).agg(direct).unionByName(large).toDF(*keys, out)


def _narrowed_quantiles(values: DataFrame, keys: Sequence[str], probs: Sequence[float], out: str) -> DataFrame:
    """Exact quantiles of (keys, __v), for groups however large, by shrinking the range of values that holds each wanted rank.

    A search is one row: the range, how many values lie below it and what follows it. Each round counts, for all open
    searches in one scan, how many values fall into each of `HISTOGRAM_BINS` slices of their range; a window over the bins of a
    search picks the slice that holds its rank. A round is a table in the shared folder.
    """
    keys = list(keys)
    if not keys:
        values, keys, plain = values.withColumn("__all", F.lit(0)), ["__all"], True
    else:
        plain = False
    infinite, bottom = F.lit(float("inf")), F.lit(float("-inf"))
    # Infinite values and NaN, which sorts last, are counted; the search is among the others.
    finite = ~F.isnan("__v") & (F.abs("__v") != infinite)
    known = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(finite, F.col("__v"))).alias("lo"), F.max(F.when(finite, F.col("__v"))).alias("hi"),
        F.count_if(F.col("__v") == bottom).alias("low"), F.count_if(F.col("__v") == infinite).alias("high"), F.count_if(F.isnan("__v")).alias("odd"))
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)])).alias("w")
    searches = known.select(*keys, "n", "lo", "hi", "low", "high", "odd", wanted).select("*", "w.j", (F.col("w.p") * (F.col("n") - 1)).alias("pos"))
    searches = cut_lineage(searches.withColumn("k", F.floor("pos")).drop("w"))

    def outside(rank: Column) -> Column:
        """The value at a rank that is no finite one; null if it is."""
        return F.when(rank < F.col("low"), bottom).when(rank < F.col("n") - F.col("high") - F.col("odd"), F.lit(None).cast("double")).when(
            rank < F.col("n") - F.col("odd"), infinite).otherwise(F.lit(float("nan")))

    above = F.least(F.col("k") + 1, F.col("n") - 1)
    first = searches.where(outside(F.col("k")).isNotNull()).select(
        *keys, "j", outside(F.col("k")).alias("a"), F.coalesce(outside(above), "lo").alias("b"))
    answers = [first]
    # `after` is what follows the range, null if it is not known to be anything.
    after = F.when(F.col("high") > 0, infinite).when(F.col("odd") > 0, F.lit(float("nan")))
    state = cut_lineage(searches.where(outside(F.col("k")).isNull()).select(*keys, "j", "k", "lo", "hi", F.col("low").alias("below"), after.alias("after")))
    names = [f"__s{i}" for i in range(len(keys))]
    while not state.isEmpty():
        sought = state.select(*[F.col(k).alias(s) for k, s in zip(keys, names)], "j", "k", "lo", "hi", "below", "after")
        inside = values.join(sought, key_match([F.col(k) for k in keys], [F.col(s) for s in names])).where(F.col("__v").between(F.col("lo"), F.col("hi")))
        scaled = F.try_divide(F.col("__v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        slot = F.coalesce(F.least(F.floor(scaled * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1)), F.lit(0))
        bins = inside.groupBy(*keys, "j", slot.alias("bin")).agg(
            F.count(F.lit(1)).alias("m"), F.min("__v").alias("v0"), F.max("__v").alias("v1"),
            F.first("k").alias("k"), F.first("below").alias("below"), F.first("after").alias("after"))
        # At most HISTOGRAM_BINS rows per search.
        order = Window.partitionBy(*keys, "j").orderBy("bin")
        upto = F.col("below") + F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))
        counted = bins.withColumn("upto", upto).withColumn("follows", F.coalesce(F.lead("v0").over(order), F.col("after")))
        picked = cut_lineage(counted.where((F.col("upto") - F.col("m") <= F.col("k")) & (F.col("k") < F.col("upto"))))
        last = F.col("k") == F.col("upto") - 1
        done = last | (F.col("v0") == F.col("v1"))
        answers.append(picked.where(done).select(*keys, "j", F.col("v1").alias("a"), F.when(last, F.coalesce("follows", "v1")).otherwise(F.col("v1")).alias("b")))
        state = picked.where(~done).select(
            *keys, "j", "k", F.col("v0").alias("lo"), F.col("v1").alias("hi"), (F.col("upto") - F.col("m")).alias("below"), F.col("follows").alias("after"))
    found = reduce(DataFrame.unionByName, answers).toDF(*names, "__j", "a", "b")
    both = searches.select(*keys, "j", (F.col("pos") - F.col("k")).alias("share")).join(
        found, key_match([F.col(k) for k in keys] + [F.col("j")], [F.col(s) for s in names] + [F.col("__j")]))
    a, b, share = F.col("a"), F.col("b"), F.col("share")
    sound = lambda x: ~F.isnan(x) & (F.abs(x) != infinite)
    value = F.when((share <= 0) | (a == b), a).when(sound(a) & sound(b), a + (b - a) * share).otherwise((1 - share) * a + share * b)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("j", value.alias("q")))), lambda x: x["q"]).alias(out)
    result = both.groupBy(*keys).agg(listed)
    return result.drop("__all") if plain else result


def global_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], hot_rows: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns. One small list per column reaches the driver."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counts = dict(zip(cols, df.agg(*[F.count(F.col(f"`{c}`")) for c in cols]).first())) if cols else {}
    small = [c for c in cols if counts[c] <= hot_rows]
    result: dict[str, list[float | None]] = {}
    if small:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), wanted) for c in small]).first()
        result.update({c: found or [None] * len(probs) for c, found in zip(small, row)})
    large = [c for c in cols if c not in result]
    if large:
        # One search for all columns, so that a round is one scan.
        cells = [F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(large)]
        values = df.select(F.explode(F.array(*cells)).alias("x")).select(F.col("x.c").alias("__c"), F.col("x.v").alias("__v")).where("__v is not null")
        # One row per column.
        result.update({large[r["__c"]]: r["__q"] for r in _narrowed_quantiles(values, ["__c"], probs, "__q").collect()})
    return result


def unpivot_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per cell: (column_name, value as text, null kept)."""
    pairs = [F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column_name", "p.value")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (column_name, value), nulls included; one shuffle, combined on the map side."""
    return unpivot_text(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def global_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: its most frequent value as text, smallest on ties."""
    counts = value_counts(df, cols).where(F.col("value").isNotNull())
    return counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )
