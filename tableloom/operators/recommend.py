"""Similarity statistics and recommendations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.functions.scalars import rounded
from tableloom.operators import boxes
from tableloom.operators.pairwise import STEP_DIGITS, cosine_buckets, cosine_counts, cosine_counts_of, cosine_topn, cosine_values, pack_blocks, quoted
from tableloom.operators.profile import interaction_density
from tableloom.session import cut_lineage

# Items of a user that travel as one row.
LIST = 4096


@dataclass(frozen=True)
class Settings:
    """How many similar entities count, and from which similarity on."""

    neighbours: int = 5
    min_similarity: float = 0.3

    def __post_init__(self):
        if not 3 <= self.neighbours <= 20 or not 0.1 <= self.min_similarity <= 0.9:
            raise ValueError("neighbours 3..20, min_similarity 0.1..0.9")


# The three presets offered.
PRESETS = {
    "Balanced": Settings(5, 0.3),
    "High Precision": Settings(3, 0.6),
    "High Coverage": Settings(10, 0.2),
}


def choose_approach(df: DataFrame, item: str, user: str | None = None) -> DataFrame:
    """User- or item-based, from the interaction profile; without users only items are left.

    Rule of ours: many users per item and dense data favour comparing items.
    """
    if user is None:
        return df.agg(F.count_distinct(item).alias("n_items"), F.count(F.lit(1)).alias("n_rows")).withColumn("approach", F.lit("item_based"))
    facts = interaction_density(df, user, item)
    by_item = (F.col("n_users") > 10 * F.col("n_items")) | (F.col("n_users") == 0)
    return facts.withColumn("approach", F.when(by_item, "item_based").otherwise("user_based"))


def similarity_stats(vectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Facts on the similarity matrix, diagonal included; one row. The matrix is never stored.

    A first pass counts cells per bucket of 0.001, which yields sums and shares in full and shows the few
    buckets that hold the smallest, the largest and the quartile values; a second pass looks into those, where the blocks'
    directions allow them, and gives them to the sixth digit.
    """
    if block_rows is None:
        vectors = cut_lineage(vectors.select("id", "vec"))
        if boxes.suits(vectors):
            shares = {"min_positive": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75}
            found = boxes.matrix_facts(vectors, shares, (0.3, 0.5))
            return _matrix_row(vectors, found["size"], found["mean"], found["max"], found["quantiles"], *found["above"])
    packed = pack_blocks(vectors, block_rows, by_direction=True)
    # At most 2,002 rows.
    buckets = sorted((r["bucket"], r["n"], r["total"]) for r in cosine_buckets(vectors, packed).collect())
    cells = sum(n for _, n, _ in buckets)
    size = round(cells**0.5)
    above = lambda limit: sum(n for b, n, _ in buckets if b > limit)
    positive, ranks = above(0), {}
    if positive:
        for name, p in (("min_positive", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            ranks[name] = p * (positive - 1)
    wanted, seen = {buckets[-1][0]} if buckets else set(), 0
    for b, n, _ in buckets:
        if b > 0:
            wanted |= {b for at in ranks.values() if seen <= int(at) < seen + n or seen <= ceil(at) < seen + n}
            seen += n
    inside: dict[int, list[tuple[int, int]]] = {}
    if wanted:
        for r in cosine_values(vectors, sorted(wanted), packed).collect():
            inside.setdefault(r["bucket"], []).append((r["step"], r["n"]))

    def value_at(rank: int) -> float:
        """Similarity of the positive cell with this rank."""
        below = 0
        for b, n, _ in buckets:
            if b <= 0:
                continue
            if rank < below + n:
                for step, k in sorted(inside[b]):
                    below += k
                    if rank < below:
                        return step / 10**STEP_DIGITS
            below += n
        raise LookupError(rank)

    facts: dict[str, float | None] = {}
    for name in ("min_positive", "q25", "q50", "q75"):
        facts[name] = None
        if name in ranks:
            low = int(ranks[name])
            share = ranks[name] - low
            first = value_at(low)
            facts[name] = first + (value_at(low + 1) - first) * share if share else first
    most = max(s for s, _ in inside[buckets[-1][0]]) / 10**STEP_DIGITS if cells else None
    return _matrix_row(vectors, size, sum(t for _, _, t in buckets) / cells if cells else None, most, facts, above(300), above(500))


def _matrix_row(vectors: DataFrame, size: int, mean: float | None, most: float | None, facts: dict[str, float | None], over_03: int, over_05: int) -> DataFrame:
    row = (
        size, mean, most, facts["min_positive"], facts["q25"], facts["q50"], facts["q75"],
        over_03 / size if size else None, over_05 / 2 / (size * (size - 1) / 2) * 100 if size > 1 else None,
    )
    return vectors.sparkSession.createDataFrame([row], (
        "n_entities bigint, mean_similarity double, max_similarity double, min_positive double, q25 double, q50 double, q75 double, "
        "mean_above_03 double, strong_pair_pct double"))


def param_impact(vectors: DataFrame, settings: Settings) -> DataFrame:
    """What a choice of parameters yields: mean neighbours (self included, capped at N), coverage, warning."""
    counts = cosine_counts(vectors, settings.min_similarity, at_most=settings.neighbours).withColumn("kept", F.least("n", F.lit(settings.neighbours)))
    enough = F.count_if(F.col("kept") >= settings.neighbours)
    pct = F.try_divide(enough * 100.0, F.count(F.lit(1)).cast("double"))
    return counts.agg(
        F.avg("kept").alias("avg_similar"), enough.alias("with_enough"),
        F.count(F.lit(1)).alias("n_entities"), pct.alias("coverage_pct"),
        F.when(pct < 50, "limited recommendations: relax the threshold or the number of neighbours").otherwise("").alias("warning"),
    )


def preview(vectors: DataFrame, settings: Settings, show: int = 10, enough: int = 4) -> DataFrame:
    """Neighbour count and a note for the first `show` entities by id."""
    # Only those shown are compared with all.
    shown = vectors.orderBy("id").limit(show)
    first = cosine_counts_of(vectors, shown, settings.min_similarity)
    kept = F.least(F.col("n") - F.col("self"), F.lit(settings.neighbours))
    zero = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + F.abs(x)) == 0
    # A zero vector is not even similar to itself.
    marked = first.join(vectors.select("id", F.when(zero, 0).otherwise(1).alias("self")), "id")
    note = F.when(F.col("n_similar") >= enough, "enough").when(F.col("n_similar") > 0, "few").otherwise("none")
    return marked.select("id", kept.cast("bigint").alias("n_similar")).withColumn("note", note)


def user_items(interactions: DataFrame, user: str, item: str) -> DataFrame:
    return interactions.select(F.col(user).alias("user"), F.col(item).alias("item")).where(
        F.col("user").isNotNull() & F.col("item").isNotNull()).distinct()


def min_interactions(interactions: DataFrame, user: str, item: str, at_least: int) -> DataFrame:
    """Interactions with items that at least so many different users have."""
    counts = user_items(interactions, user, item).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    popular = counts.where(F.col("n") >= at_least).select(F.col("item").alias("__item"))
    return interactions.join(popular, F.col(item) == F.col("__item"), "left_semi")


def similar_entities(vectors: DataFrame, settings: Settings, block_rows: int | None = None) -> DataFrame:
    """(id, other, similarity, rank) of the top N others at or above the threshold."""
    return cosine_topn(vectors, settings.neighbours, settings.min_similarity, block_rows)


def item_lists(owned: DataFrame) -> DataFrame:
    """(user, items): the items of each user in lists of at most `LIST`, so that what a user has is a few rows and not one per item."""
    nth = F.row_number().over(Window.partitionBy("user").orderBy("item"))
    rows = owned.select("user", "item", F.floor((nth - 1) / LIST).alias("part"))
    return rows.groupBy("user", "part").agg(F.collect_list("item").alias("items")).select("user", "items")


def _best_items(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What `recommend_user` works out of rows (user, similarity, items) that lie by users; those without a similarity are the user's own."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        users, lengths = rows["user"].to_numpy(), [len(x) for x in rows["items"]]
        firsts = np.nonzero(np.append(True, users[1:] != users[:-1]))[0]
        who = np.repeat(np.searchsorted(firsts, np.arange(len(users)), side="right") - 1, lengths)
        names, item = np.unique(np.concatenate([np.asarray(x) for x in rows["items"]]), return_inverse=True)
        similarity = np.repeat(rows["similarity"].to_numpy(dtype=np.float64), lengths)
        order = np.argsort(who * len(names) + item, kind="stable")
        who, item, similarity = who[order], item[order], similarity[order]
        at = np.nonzero(np.append(True, (who[1:] != who[:-1]) | (item[1:] != item[:-1])))[0]
        own = np.isnan(similarity)
        fresh = ~np.logical_or.reduceat(own, at)
        mean = np.add.reduceat(np.where(own, 0.0, similarity), at) / np.diff(np.append(at, len(who)))
        who, item, mean = who[at][fresh], item[at][fresh], np.minimum(quoted(mean[fresh]), 1.0)
        order = np.lexsort((item, -mean, who))
        who, item, mean = who[order], item[order], mean[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, side="left") + 1
        keep = rank <= top
        return pd.DataFrame({"user": users[firsts][who[keep]], "rank": rank[keep].astype(np.int32), "item": names[item[keep]], "confidence": mean[keep]})

    return best


def recommend_user(neighbours: DataFrame, owned: DataFrame, top: int = 5) -> DataFrame:
    """(user, rank, item, confidence): mean similarity of the neighbours who have the item, at most 1.

    Only N neighbours per user enter; a neighbour shared by very many users is split at run time. Items travel in lists
    and are laid out one by one only where a user's neighbours have met, a batch of users at a time.
    """
    lists = cut_lineage(item_lists(owned))
    found = neighbours.select(F.col("id").alias("user"), "other", "similarity").join(lists.withColumnRenamed("user", "other"), "other").select("user", "similarity", "items")
    # What a user has rides along without a similarity.
    both = found.unionByName(lists.select("user", F.lit(None).cast("double").alias("similarity"), "items"))
    both = both.repartition("user").sortWithinPartitions("user")
    best = _best_items(top)

    def by_users(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            # The last user may go on in the next batch.
            if waiting and waiting[-1]["user"].iloc[-1] != part["user"].iloc[0]:
                yield best(pd.concat(waiting))
                waiting = []
            whole = int((part["user"] != part["user"].iloc[-1]).sum())
            if whole:
                yield best(pd.concat([*waiting, part.iloc[:whole]]))
                waiting = []
            waiting.append(part.iloc[whole:])
        if waiting:
            yield best(pd.concat(waiting))

    schema = T.StructType([
        T.StructField("user", both.schema["user"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("item", owned.schema["item"].dataType),
        T.StructField("confidence", T.DoubleType())])
    return both.mapInPandas(by_users, schema)


def recommend_item(neighbours: DataFrame) -> DataFrame:
    """(item, rank, recommended, confidence): similar items; items without any are left out."""
    return neighbours.select(
        F.col("id").alias("item"), "rank", F.col("other").alias("recommended"),
        F.least("similarity", F.lit(1.0)).alias("confidence"),
    )


def reco_metrics(recs: DataFrame, entity: str, product: str, entities: DataFrame) -> DataFrame:
    """Share of entities with a recommendation, mean confidence, distinct products."""
    out = recs.agg(F.count_distinct(entity).alias("n_served"), F.avg("confidence").alias("mean_confidence"),
                   F.count_distinct(product).alias("n_products"))
    total = entities.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("n_entities", total).withColumn(
        "coverage_pct", F.try_divide(F.col("n_served") * 100.0, F.col("n_entities").cast("double")))


def reco_table(recs: DataFrame, entity: str, product: str) -> DataFrame:
    """One row per entity: number, 'product (confidence)' list in rank order, mean confidence. Lists hold top-N rows."""
    listed = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", F.col(product).cast("string").alias("p"), "confidence"))),
        lambda x: F.concat(x["p"], F.lit(" ("), F.format_string("%.2f", rounded(x["confidence"], 2)), F.lit(")")),
    ), ", ")
    return recs.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_recommendations"), listed.alias("recommended"),
        rounded(F.avg("confidence"), 2).alias("mean_confidence"),
    )


def reco_evidence(neighbours: DataFrame, owned: DataFrame, recs: DataFrame, top: int = 3) -> DataFrame:
    """Why: per recommended (user, item) how many neighbours have it and the most similar of them."""
    # Each user's few items are sought in the lists of the neighbours, and in the user's own, which rule an item out.
    wanted = recs.select("user", "item").where("user is not null and item is not null").groupBy("user").agg(F.collect_set("item").alias("wanted"))
    asked = neighbours.select(F.col("id").alias("user"), "other", "similarity").unionByName(
        wanted.select("user", F.col("user").alias("other"), F.lit(None).cast("double").alias("similarity"))).join(wanted, "user")
    hits = asked.join(item_lists(owned).withColumnRenamed("user", "other"), "other").select(
        "user", "other", "similarity", F.explode(F.array_intersect("wanted", "items")).alias("item"))
    # At most N neighbours per (user, item).
    other = F.when(F.col("similarity").isNotNull(), F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("o")))
    ranked = F.sort_array(F.collect_list(other))
    text = F.array_join(F.transform(F.slice(ranked, 1, top), lambda x: F.concat(
        x["o"].cast("string"), F.lit(":"), F.format_string("%.4f", rounded(-x["s"], 4)))), ", ")
    found = hits.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n_neighbours"), F.count_if(F.col("similarity").isNull()).alias("own"), text.alias("evidence"))
    return found.where("own = 0").select("user", "item", "n_neighbours", "evidence")
