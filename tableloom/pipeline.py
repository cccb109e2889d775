"""Workflows over any tables: from raw tables with roles to a modelling table, models, forecasts, clusters and recommendations.

Every workflow writes the steps that it reads more than once, splits before it fits, and fits on the training part only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import named
from tableloom.operators import aggregate, cluster, features, forecast as series_models, joins, profile, recommend as similarity, roles, splits, supervised
from tableloom.operators.joins import JoinStep
from tableloom.operators.recommend import Settings
from tableloom.session import cut_lineage

# Problems whose rows are events that are not brought to one row per key.
NOT_AGGREGATED = ("recommendation", "forecasting")
MAX_ONE_HOT = 10


@dataclass(frozen=True)
class Roles:
    """Which column of a table plays which role, and how its rows are brought to one per key."""

    columns: Mapping[str, str]
    methods: Mapping[str, Sequence[str]] = field(default_factory=dict)
    order_by: Sequence[str] = ()


@dataclass(frozen=True)
class Result:
    """The best model's name, the measures of all models, and what it says of the rows asked about."""

    best: str
    metrics: DataFrame
    rows: DataFrame
    notes: dict[str, object] = field(default_factory=dict)


def checked(tables: Mapping[str, DataFrame], mandatory: Mapping[str, Mapping[str, str]]) -> None:
    """Stop on missing columns, empty tables or null keys before any heavy step."""
    keys = {t: list(m.values()) for t, m in mandatory.items()}
    wrong = profile.validate_tables(dict(tables), {t: dict(m) for t, m in mandatory.items()}, keys).where("violations > 0").collect()  # one row per rule
    if wrong:
        raise ValueError(f"tables fail validation: {wrong}")


def modelling_table(
    tables: Mapping[str, DataFrame], known: Mapping[str, Roles], problem: str, steps: Sequence[JoinStep] = (),
    target: Callable[[DataFrame], DataFrame] | None = None, time_series: bool = False, product_level: bool = False,
) -> DataFrame:
    """Check the roles, bring every table to its grain, join along `steps` and add the target; written once.

    Tables with `methods` are aggregated where a key has several rows, unless the problem works on events.
    """
    spark = next(iter(tables.values())).sparkSession
    mapping = roles.mapping_frame(spark, {t: dict(k.columns) for t, k in known.items()})
    absent = roles.missing_roles(mapping, problem, time_series=time_series, product_level=product_level).collect()  # one row per role
    if absent:
        raise ValueError(f"roles without a column: {[tuple(r) for r in absent]}")
    must = roles.requirements(problem, time_series, product_level)["mandatory"]
    checked({t: tables[t] for t in known}, {t: {r: c for r, c in k.columns.items() if r in must} for t, k in known.items()})
    ready = dict(tables)
    for name, k in known.items():
        keys = roles.grain_keys(dict(k.columns), time_series, product_level)
        if k.methods and problem not in NOT_AGGREGATED and aggregate.needs_aggregation(tables[name], keys).first()["needed"]:
            ready[name] = aggregate.aggregate(tables[name], keys, {c: list(m) for c, m in k.methods.items()}, order_by=list(k.order_by))
    joined = cut_lineage(joins.run_join_plan(ready, list(steps)))
    return joined if target is None else cut_lineage(target(joined))


def joined_by_suggestion(
    tables: Mapping[str, DataFrame], known: Mapping[str, Roles] | None = None, anchor: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Suggest keys from the anchor on, measure each join, then join: the table and one row of health per step.

    Columns that play the same role in two tables are candidates whatever their names. Tables that no key connects
    to the anchor are an error, as leaving them out would change what is asked.
    """
    steps = joins.suggested_steps(dict(tables), {t: dict(k.columns) for t, k in (known or {}).items()}, anchor)
    apart = set(tables) - {t for s in steps for t in (s.left, s.right)}
    if apart and len(tables) > 1:
        raise ValueError(f"no key leads to {sorted(apart)}")
    if not steps:
        raise ValueError("one table needs no join")
    measured = [
        joins.join_health(tables[s.left], tables[s.right], s.on).select(
            F.lit(i + 1).alias("seq"), F.lit(s.left).alias("left_table"), F.lit(s.right).alias("right_table"), F.lit(s.how).alias("type_of_join"), "*")
        for i, s in enumerate(steps)]
    return joins.run_join_plan(dict(tables), steps), cut_lineage(reduce(DataFrame.unionByName, measured))


@dataclass(frozen=True)
class Prepared:
    """Rows with `split`, filled and encoded by what the training part holds, and the names of the inputs."""

    rows: DataFrame
    inputs: list[str]


def prepared(
    table: DataFrame, id: str, target: str, strategy: str = "random", date: str | None = None, exclude: Sequence[str] = (), max_one_hot: int = MAX_ONE_HOT,
) -> Prepared:
    """Split, then fill gaps and encode texts by the training rows alone."""
    parted = cut_lineage(splits.split(table, id, strategy, date=date, target=target))
    train = parted.where("split = 'train'")
    kinds = dict(parted.dtypes)
    left_out = {id, target, date, "split", *exclude}
    texts = [c for c, k in kinds.items() if k == "string" and c not in left_out]
    inputs = [c for c in parted.columns if c not in left_out and (c in texts or c in profile.numeric_columns(parted, boolean=True))]
    filled = features.impute(parted, fills=features.fill_values(train, columns=inputs)) if inputs else parted
    sizes = train.agg(*[F.count_distinct(named(c)) for c in texts]).first() if texts else ()
    few = [c for c, n in zip(texts, sizes) if n <= max_one_hot]
    rows = features.one_hot(filled, few, known=features.categories(train, few)) if few else filled
    total = train.agg(F.count(F.lit(1))).scalar()
    for c in set(texts) - set(few):
        # The share of training rows with the same value; a value unseen there has none.
        share = train.where(named(c).isNotNull()).groupBy(named(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        rows = rows.join(share, named(c) == F.col("__v"), "left").withColumn(c, F.coalesce(F.col("__n") / total, F.lit(0.0))).drop("__v", "__n")
    rows = cut_lineage(rows)
    return Prepared(rows, features.training_features(rows, [x for x in left_out if x]))


def _supervised(
    kind: str, table: DataFrame, id: str, target: str, strategy: str, date: str | None, exclude: Sequence[str], models: Sequence[str] | None, severe: float,
) -> Result:
    ready = prepared(table, id, target, strategy, date, exclude)
    train = ready.rows.where("split = 'train'")
    scan = features.leakage_scan(train.select(target, *ready.inputs), target, severe=severe)
    leaky = [r["column_name"] for r in scan.where("verdict = 'severe'").collect()]  # one row per column
    inputs = [c for c in ready.inputs if c not in leaky]
    if not inputs:
        raise ValueError(f"no input is left; all give the target away: {leaky}")
    if kind == "classification":
        single = features.class_check(ready.rows, "split", target).where(~F.col("ok")).collect()  # one row per part
        if single:
            raise ValueError(f"a part holds a single class: {[tuple(r) for r in single]}")
    found = supervised.train(ready.rows, target, kind, inputs, models)
    best = supervised.rank_models(found.metrics, kind).where("recommended").first()["model"]
    asked = supervised.score(ready.rows.where("split = 'infer'"), found.models[best], kind, inputs)
    return Result(best, found.metrics, asked, {"left out as leaky": leaky, "failed": found.failed, "inputs": inputs})


def classify(
    table: DataFrame, id: str, target: str, strategy: str = "random", date: str | None = None, exclude: Sequence[str] = (),
    models: Sequence[str] | None = None, severe: float = 0.95,
) -> Result:
    """Train all classifiers, or those named, on the training part, rank them on the validation part, score the rest."""
    return _supervised("classification", table, id, target, strategy, date, exclude, models, severe)


def regress(
    table: DataFrame, id: str, target: str, strategy: str = "random", date: str | None = None, exclude: Sequence[str] = (),
    models: Sequence[str] | None = None, severe: float = 0.95,
) -> Result:
    """As `classify`, for a number."""
    return _supervised("regression", table, id, target, strategy, date, exclude, models, severe)


def forecast(series: DataFrame, y: str, by: Sequence[str], held_back: int = 3, periods: object = None) -> Result:
    """Hold back the last months, rank the forecasters on them, then forecast with the best one; `series` has a row per month `t`.

    The notes hold the table of the forecast: its period and sums per series.
    """
    series = cut_lineage(series)
    known = series.where(F.col("t") <= series.agg(F.max("t")).scalar() - held_back)
    actual = series.select(*by, series_models.month_of(F.col("t")).alias("date"), y)
    makers = {
        "trend_season": lambda s: series_models.forecast_trend_season(s, y, list(by), periods),
        "autoregressive": lambda s: series_models.forecast_ar(s, y, list(by), periods=periods),
        "trees": lambda s: series_models.forecast_trees(s, y, list(by), periods=periods)}
    measured = reduce(DataFrame.unionByName, [
        supervised.forecast_metrics(make(known).join(actual, [*by, "date"]), y, f"Predicted {y}").select(F.lit(n).alias("model"), "*") for n, make in makers.items()])
    metrics = cut_lineage(measured)
    best = supervised.rank_models(metrics, "forecast").where("recommended").first()["model"]
    rows = cut_lineage(makers[best](series))
    return Result(best, metrics, rows, {"table": series_models.forecast_table(rows, y, list(by), best)})


def clusters(table: DataFrame, id: str, inputs: Sequence[str], eps: float | None = None, min_samples: int | None = None) -> Result:
    """Fill, scale, cluster by k-means and by density, and keep the better silhouette; noise and its share are noted.

    The silhouette that decides is Spark's, on squared distances, whose cost grows with the rows alone.
    """
    rows = cut_lineage(table.select(named(id), *map(named, inputs)))
    ready = cut_lineage(features.standard_scale(features.impute(rows, columns=list(inputs)), list(inputs), guard=True))
    tried = cluster.kmeans_choose_k(ready, id, inputs)
    k = tried.where("chosen").first()["k"]
    found = {
        "kmeans": cut_lineage(cluster.kmeans(ready, id, inputs, k).select("id", "cluster")),
        "dbscan": cut_lineage(cluster.dbscan(ready, id, inputs, eps, min_samples).select("id", "cluster"))}
    measured, notes = [], {}
    for name, labels in found.items():
        sizes = cluster.cluster_sizes(labels, "cluster")
        counts = sizes.agg(F.count_if("is_cluster").alias("n"), F.sum(F.when(~F.col("is_cluster"), F.col("n"))).alias("noise"), F.sum("n").alias("rows")).first()
        noise = (counts["noise"] or 0) / counts["rows"] if counts["rows"] else 0.0
        width = cluster.quick_silhouette(ready, labels, id, inputs) if counts["n"] > 1 else -1.0
        measured.append((name, int(counts["n"]), float(width), float(noise)))
        notes[name] = cluster.quality_warnings(counts["n"], width, noise, cluster.k_range(counts["rows"])[-1] if name == "kmeans" else None)
    # Mostly noise is no answer, whatever its silhouette.
    best = max(measured, key=lambda m: (m[3] <= 0.5, m[2], -m[1]))[0]
    notes["undecided"] = abs(measured[0][2] - measured[1][2]) < 0.01
    metrics = table.sparkSession.createDataFrame(measured, "model string, clusters int, silhouette double, noise_share double")
    return Result(best, metrics, cluster.clustered_table(rows, found[best], id, best), notes)


def recommend(
    interactions: DataFrame, item: str, inputs: Sequence[str], user: str | None = None, weights: Mapping[str, float] | None = None,
    settings: Settings = similarity.PRESETS["Balanced"], order_by: Sequence[str] = (), top: int = 5,
) -> Result:
    """Items of similar users, or similar items where there are no users or many to each item; with the facts that speak for it."""
    rows = cut_lineage(interactions)
    usable = {r["column_name"] for r in profile.feature_eligibility(rows.select(*inputs)).where("can_use").collect()}  # one row per column
    kept = [c for c in inputs if c in usable]
    if not kept:
        raise ValueError("no feature can be compared")
    if weights is None:
        weights = {r["column_name"]: r["weight"] for r in features.suggest_weights(rows.select(*kept)).collect()}  # one row per column
    approach = similarity.choose_approach(rows, item, user).first()["approach"]
    if approach == "item_based":
        vectors = cut_lineage(features.entity_vectors(rows, item, kept, dict(weights), how="first", order_by=list(order_by)) if order_by else features.entity_vectors(rows, item, kept, dict(weights)))
        recs = similarity.recommend_item(similarity.similar_entities(vectors, settings))
        entity, product, everyone = "item", "recommended", rows.select(F.col(item).alias("item")).distinct()
    else:
        vectors = cut_lineage(features.entity_vectors(rows, user, kept, dict(weights)))
        recs = similarity.recommend_user(similarity.similar_entities(vectors, settings), similarity.user_items(rows, user, item), top)
        entity, product, everyone = "user", "item", rows.select(F.col(user).alias("user")).where("user is not null").distinct()
    recs = cut_lineage(recs)
    return Result(approach, similarity.reco_metrics(recs, entity, product, everyone), recs, {
        "left out": [c for c in inputs if c not in kept], "weights": dict(weights), "impact": similarity.param_impact(vectors, settings).first().asDict()})
