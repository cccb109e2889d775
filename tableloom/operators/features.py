"""Feature preparation: cleaning, imputation, encoding, scaling, weights, leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.functions.scalars import named, nullify_tokens
from tableloom.functions.stats import global_modes, global_quantiles, group_modes, unpivot_text
from tableloom.operators.profile import _one_row_to_long, correlation, numeric_columns, profile


def fill_values(df: DataFrame, numeric: str = "median", other: str = "mode", columns: Sequence[str] | None = None) -> dict[str, object]:
    """The fill value of each column, gaps or not, null where it holds nothing. Fit on the training part, apply anywhere."""
    columns = list(columns or df.columns)
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    texts = [c for c in columns if c not in numbers]
    if other != "mode":
        raise ValueError("other columns are filled with their mode")
    fills: dict[str, object] = {}
    if numbers and numeric == "median":
        fills |= {c: q[0] for c, q in global_quantiles(df, numbers, [0.5]).items()}
    elif numbers and numeric == "mean":
        fills |= dict(zip(numbers, df.agg(*[F.avg(named(c)) for c in numbers]).first()))
    elif numbers:
        raise ValueError(f"unknown strategy: {numeric}")
    if texts:
        # One row per column.
        fills |= {r["column_name"]: r["mode"] for r in global_modes(df, texts).collect()}
    return fills


def impute(
    df: DataFrame, numeric: str = "median", other: str = "mode", columns: Sequence[str] | None = None,
    fills: dict[str, object] | None = None,
) -> DataFrame:
    """Fill nulls: numbers with the exact median or mean, everything else with the mode."""
    if fills is None:
        # Filled from itself, a column without gaps needs no value.
        columns = list(columns or df.columns)
        holes = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
        gaps = [c for i, c in enumerate(columns) if holes[i]]
        fills = fill_values(df, numeric, other, gaps) if gaps else {}
    changes = {}
    for c, v in fills.items():
        if v is None:
            continue
        kind = "double" if isinstance(v, float) else df.schema[c].dataType
        changes[c] = F.coalesce(named(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(changes) if changes else df


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of each column, each of which becomes a column: meant for categories, not for ids."""
    found = {}
    for c in cols:
        rows = df.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`").cast("string").alias("v")).distinct().collect()
        found[c] = sorted(r["v"] for r in rows)
    return found


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False, known: dict[str, list[str]] | None = None) -> DataFrame:
    """0/1 column per category in sorted order, optionally without the first; a null gives all zeros.

    For categories, of which there are few; `sparse.entity_entries` takes any number. Two values that would give columns
    of one name are an error.
    """
    known = known or categories(df, cols)
    new = {}
    taken = set(df.columns) - set(cols)
    for c in cols:
        for v in known[c][1:] if drop_first else known[c]:
            if f"{c}_{v}" in taken:
                raise ValueError(f"two columns would be called {c}_{v}")
            taken.add(f"{c}_{v}")
            new[f"{c}_{v}"] = F.when(named(c).cast("string") == v, 1).otherwise(0)
    return df.withColumns(new).drop(*cols) if new else df.drop(*cols)


def _moments(df: DataFrame, cols: Sequence[str]) -> Column:
    """Mean, population std, min and max of all columns as one scalar subquery."""
    parts = []
    for i, c in enumerate(cols):
        x = named(c).cast("double")
        parts.append(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"c{i}"))
    return df.agg(F.struct(*parts).alias("m")).scalar()


def standard_scale(df: DataFrame, cols: Sequence[str], guard: bool = False) -> DataFrame:
    """(x - mean) / population std. A constant column becomes 0, or stays as it is with `guard`."""
    m = _moments(df, cols)
    changes = {}
    for i, c in enumerate(cols):
        x, s = named(c).cast("double"), m[f"c{i}"]
        flat = x if guard else F.when(x.isNotNull(), 0.0)
        changes[c] = F.when(s["lo"] < s["hi"], (x - s["mean"]) / s["std"]).otherwise(flat)
    return df.withColumns(changes)


def normalise_weights(weights: dict[str, object], missing: float = 0.5) -> dict[str, float]:
    """Weights that sum to 1; None takes the `missing` weight, non-numbers and weights <= 0 are dropped."""
    kept = {}
    for f, w in weights.items():
        w = missing if w is None else w
        if isinstance(w, (int, float)) and not isinstance(w, bool) and w > 0:
            kept[f] = float(w)
    total = sum(kept.values())
    return {f: w / total for f, w in kept.items()}


def checked_importance(level: str | None) -> str:
    return level if level in ("high", "medium", "low") else "medium"


def weighted_features(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({f: named(f).cast("double") * F.lit(float(w)) for f, w in weights.items()})


def prepared_features(df: DataFrame, features: Sequence[str], weights: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Mean/mode filled, guarded-scaled and one-hot encoded features times their weight, over all rows.

    Returns the frame with one double column per vector component and the component names in order.
    """
    weights = weights or {}
    numbers = [f for f in features if f in set(numeric_columns(df, boolean=True))]
    texts = [f for f in features if f not in numbers]
    # Booleans count as numbers.
    df = df.withColumns({f: named(f).cast("int") for f, t in df.dtypes if f in numbers and t == "boolean"}) if numbers else df
    fills = fill_values(df, "mean", "mode", list(features))
    filled = impute(df, fills=fills)
    known = categories(filled, texts)
    m = _moments(filled, numbers) if numbers else None
    parts: dict[str, Column] = {}
    for f in features:
        w = F.lit(float(weights.get(f, 1.0)))
        if f in numbers:
            x, s = named(f).cast("double"), m[f"c{numbers.index(f)}"]
            scaled = F.when(s["lo"] < s["hi"], (x - s["mean"]) / s["std"]).otherwise(x)
            parts[f"__{f}"] = F.coalesce(scaled, F.lit(0.0)) * w
        else:
            for v in known[f]:
                if f"__{f}_{v}" in parts:
                    raise ValueError(f"two components would be called {f}_{v}")
                parts[f"__{f}_{v}"] = F.when(named(f).cast("string") == v, w).otherwise(F.lit(0.0))
    return filled.select("*", *[e.alias(n) for n, e in parts.items()]), list(parts)


def entity_vectors(
    df: DataFrame, entity: str, features: Sequence[str], weights: dict[str, float] | None = None,
    how: str = "mean", order_by: Sequence[str] = (),
) -> DataFrame:
    """(id, vec): per entity the mean of its prepared rows, or its first row in a stated order."""
    ready, names = prepared_features(df.where(named(entity).isNotNull()), features, weights)
    if how == "mean":
        agg = F.array(*[F.coalesce(F.avg(f"`{n}`"), F.lit(0.0)) for n in names])
    elif how == "first" and order_by:
        agg = F.min_by(F.array(*[F.col(f"`{n}`") for n in names]), F.struct(*[named(o) for o in order_by]))
    else:
        raise ValueError("how must be 'mean', or 'first' with order_by")
    return ready.groupBy(named(entity).alias("id")).agg(agg.alias("vec"))


def suggest_weights(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Weight per feature from completeness and variety, normalised to 1, with an importance level.

    Variety is distinct / (distinct + 1); a constant column gets nothing.
    """
    cols = [c for c in df.columns if c not in exclude]
    raw = _one_row_to_long(df, {c: {
        "n_rows": F.count(F.lit(1)), "present": F.count(named(c)), "n_distinct": F.count_distinct(named(c)),
    } for c in cols})
    share = F.coalesce(F.try_divide(F.col("present"), F.col("n_rows")), F.lit(0.0))
    variety = F.when(F.col("n_distinct") > 1, F.col("n_distinct") / (F.col("n_distinct") + 1)).otherwise(0.0)
    scored = raw.select("column_name", (share * variety).alias("score"))
    everything = Window.partitionBy(F.lit(0))  # one row per column
    weight = F.try_divide(F.col("score"), F.sum("score").over(everything))
    level = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return scored.select("column_name", weight.alias("weight"), level.alias("importance")).where("weight > 0")


def encode_by_cardinality(df: DataFrame, cols: Sequence[str], max_one_hot: int = 10) -> tuple[DataFrame, DataFrame]:
    """One-hot for columns with few values, share of rows with the same value otherwise; plus a report.

    The frequency table joins back by value; Spark splits the join where one value is hot.
    """
    sizes = df.agg(*[F.count_distinct(named(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("__rows")).first()
    few = [c for c in cols if sizes[c] <= max_one_hot]
    out = one_hot(df, few) if few else df
    for c in cols:
        if c in few:
            continue
        freq = df.where(named(c).isNotNull()).groupBy(named(c).alias("__v")).agg((F.count(F.lit(1)) / F.lit(sizes["__rows"])).alias("__f"))
        out = out.join(freq, named(c) == F.col("__v"), "left").withColumn(c, F.coalesce("__f", F.lit(0.0))).drop("__v", "__f")
    report = df.sparkSession.createDataFrame(
        [(c, "one_hot" if c in few else "frequency", sizes[c]) for c in cols],
        "column_name string, encoding_type string, cardinality bigint",
    )
    return out, report


def leakage_scan(
    df: DataFrame, target: str, severe: float = 0.95, review: float = 0.80, exclude: Sequence[str] = (),
) -> DataFrame:
    """Features that give the target away: |correlation|, share of exact copies, eta squared for categories.

    Flags and dates count as numbers. Eta squared is corrected for the number of categories, so that values that are
    all different say nothing by themselves; a text copies the target where it reads as the same text or number.
    Thresholds are parameters of this engine.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c, kind in kinds.items():
        if kind == "boolean":
            df = df.withColumn(c, F.col(f"`{c}`").cast("int"))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            df = df.withColumn(c, F.unix_date(F.col(f"`{c}`").cast("date")).cast("double") if kind == "date" else F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double"))
    numbers = [c for c in numeric_columns(df) if c != target and c not in exclude]
    texts = [c for c, kind in kinds.items() if kind == "string" and c != target and c not in exclude]
    y = F.col(target).cast("double")
    frames = []
    if numbers:
        frames.append(_one_row_to_long(df, {c: {
            "association": F.abs(correlation(F.col(f"`{c}`"), F.col(f"`{target}`"))),
            "copy_rate": F.try_divide(F.count_if(F.col(f"`{c}`").cast("double") == y).cast("double"), F.count(F.lit(1)).cast("double")),
        } for c in numbers}))
    if texts:
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in texts]
        said = F.col(f"`{target}`").cast("string")
        same = F.coalesce((F.col("x.value") == F.col("said")) | (F.col("x.value").try_cast("double") == F.col("y")), F.lit(False))
        groups = (
            df.where(y.isNotNull()).select(F.explode(F.array(*cells)).alias("x"), y.alias("y"), said.alias("said"))
            .where(F.col("x.value").isNotNull()).groupBy("x.column_name", "x.value")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.count_if(same).alias("copies"))
        )
        total = lambda c: F.sum(c)
        between = total(F.col("s") * F.col("s") / F.col("n")) - total("s") * total("s") / total("n")
        overall = total("q") - total("s") * total("s") / total("n")
        n, k = total("n").cast("double"), F.count(F.lit(1)).cast("double")
        # With as many categories as rows there is nothing left to tell.
        eta = F.greatest(F.lit(0.0), 1 - (1 - F.try_divide(between, overall)) * F.try_divide(n - 1, n - k))
        found = groups.groupBy("column_name").agg(eta.alias("association"), F.sum("copies").alias("copies"))
        rows = df.agg(F.count(F.lit(1))).scalar()
        frames.append(found.select("column_name", F.coalesce("association", F.lit(0.0)).alias("association"), F.try_divide(F.col("copies").cast("double"), rows.cast("double")).alias("copy_rate")))
    found = reduce(DataFrame.unionByName, frames)
    strength = F.greatest(F.coalesce("association", F.lit(0.0)), F.coalesce("copy_rate", F.lit(0.0)))
    verdict = F.when(strength >= severe, "severe").when(strength >= review, "review").otherwise("ok")
    reason = F.when(F.col("copy_rate") >= review, "copies the target").when(strength >= review, "tells the target almost exactly").otherwise("")
    return found.select("column_name", "association", "copy_rate", verdict.alias("verdict"), reason.alias("reason"))


def drop_features(df: DataFrame, features: Sequence[str], mapped: Sequence[str] = ()) -> DataFrame:
    """Drop leaky features; mapped columns always stay."""
    return df.drop(*[f for f in features if f not in mapped])


def training_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric and boolean columns that are not target, id or date."""
    return [c for c in numeric_columns(df, boolean=True) if c not in exclude]


def class_check(df: DataFrame, split: str, target: str, parts: Sequence[str] = ("train", "valid")) -> DataFrame:
    """Classes per part and whether there are at least two."""
    per_part = df.where(F.col(split).isin(*parts)).groupBy(split).agg(F.count_distinct(target).alias("n_classes"))
    return per_part.withColumn("ok", F.col("n_classes") >= 2)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (k * n_c) per class."""
    sized = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return sized.withColumn("weight", weight)


def clean_table(df: DataFrame, rules: dict[str, dict[str, object]]) -> DataFrame:
    """Apply per-column rules {trim, nullify, type, missing, constant}; missing is drop, mean, median, mode or constant."""
    changes = {}
    for c, rule in rules.items():
        col = F.col(c)
        if rule.get("trim"):
            col = F.trim(col)
        if rule.get("nullify"):
            col = nullify_tokens(col, rule["nullify"])
        if rule.get("type"):
            col = col.try_cast(rule["type"])
        changes[c] = col
    out = df.withColumns(changes)
    gone = [c for c, r in rules.items() if r.get("missing") == "drop"]
    out = out.dropna(subset=gone) if gone else out
    fills: dict[str, object] = {c: r["constant"] for c, r in rules.items() if r.get("missing") == "constant"}
    for how in ("mean", "median"):
        cols = [c for c, r in rules.items() if r.get("missing") == how]
        if cols:
            fills |= fill_values(out, how, "mode", cols)
    modes = [c for c, r in rules.items() if r.get("missing") == "mode"]
    # Values are ranked as what they are, so that of equally frequent numbers the smaller one is taken.
    for c in modes:
        first = group_modes(out.select(F.col(f"`{c}`").alias("v")), [], "v", "mode").first()
        fills[c] = first["mode"] if first else None
    return impute(out, fills=fills) if fills else out


def noisy(df: DataFrame, cols: Sequence[str], seed: int) -> DataFrame:
    """Small seeded noise that keeps identical rows apart; off everywhere unless called."""
    return df.withColumns({c: named(c) + F.lit(1e-4) + F.rand(seed + i) * F.lit(9e-4) for i, c in enumerate(cols)})
