"""Groups of nodes that are linked through shared keys, without listing the pairs of a crowd.

A key that two nodes share is a pair. Nodes of a key that more share are compared with one of them, the hub, and each
node with one hub only, which joins most of a crowd of near copies to one group. Where a key then still holds several
groups, another hub is tried, and after the last one only nodes of one key that are in different groups are compared
one by one. A key of which many are apart even then is parted by finer keys, if the caller has any, so that what is
compared grows with the number of nodes and not with the square of a crowd; without finer keys the groups are those of
all links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableloom.operators.components import connected_components
from tableloom.session import cut_lineage, forget_shuffles, settled

HUBS = 2
# Nodes of one key, apart after the hubs, that are compared with each other as they are; more are parted by finer keys first.
CROWD = 128
# Keys or ids that go to all executors for a filter; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# How to read the marks of a node.
Marks = Callable[[str], Column]


def small(df: DataFrame) -> DataFrame:
    """`df`, a written table of one or two numbers per row, for all executors if it has no more than `BROADCAST_ROWS` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def meetings(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `keys` (key, node): the two nodes (a, b) of keys that two share, and the rows whose key more share."""
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    met = cut_lineage(met.where("n > 1"))
    crowded = small(cut_lineage(met.where("n > 2").select("key")))
    return met.where("n = 2").select("a", "b").distinct(), cut_lineage(keys.join(crowded, "key", "left_semi"))


def groups(
    keys: DataFrame | list[DataFrame], nodes: DataFrame, close: Callable[[Marks, Marks], Column], verify: Callable[[DataFrame], DataFrame] | None = None, hubs: int = HUBS,
    finer: Column | None = None, first: Callable[[Marks, Marks], Column] | None = None, large: tuple[str, ...] = (),
) -> DataFrame:
    """(node, root) for the nodes that links connect; `keys` is (key, node), `nodes` has each node once with its marks.

    Two nodes of a key are linked if `close` of their marks holds and `verify` keeps their pair (a, b). No node has a
    key twice. Several frames of `keys` have no key in common, and are met one after the other, so that their shuffles do
    not lie on disk together. `finer` is an array of numbers over `key` and the marks: of a key that leaves more than
    `CROWD` nodes apart, two are compared if they share one of these too. `first` holds for every pair that `close` holds
    for and does without the marks that are `large`, which move for the pairs it leaves only.
    """
    spark = nodes.sparkSession
    marks = [c for c in nodes.columns if c != "node"]
    light = [c for c in marks if c not in large]
    of = lambda side: lambda c: F.col(f"{side}_{c}")

    def kept(pairs: DataFrame, holds: Callable[[Marks, Marks], Column], known: DataFrame, some: list[str]) -> DataFrame:
        end = lambda s: known.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in some])
        return pairs.join(end("a"), "a").join(end("b"), "b").where(holds(of("a"), of("b"))).select("a", "b")

    def exactly(pairs: DataFrame) -> DataFrame:
        """Of pairs for which `first` holds, those that are close."""
        if first is None:
            return pairs
        pairs = cut_lineage(pairs)
        wanted = small(cut_lineage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))
        return kept(pairs, close, cut_lineage(nodes.join(wanted, "node")), marks)

    def met_closely(pairs: DataFrame) -> DataFrame:
        return exactly(kept(pairs, first or close, nodes, light if first is not None else marks))

    found = []
    for family in keys if isinstance(keys, list) else [keys]:
        found.append(settled(spark, lambda family=family: meetings(family)))
        forget_shuffles(spark)
    twos, crowd = (reduce(DataFrame.unionByName, [f[i] for f in found]) for i in (0, 1))
    twos = settled(spark, lambda: met_closely(twos.distinct() if len(found) > 1 else twos))
    forget_shuffles(spark)
    live, roots = crowd, None
    for turn in range(hubs + 1):

        def turned(turn=turn, live=live, roots=roots) -> DataFrame:
            if turn < hubs:
                # Marks travel with pairs, each of which many keys may give, and not with every key of a node.
                hub = live.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("hub"))
                pairs = live.join(hub, "key").where("node <> hub")
                if roots is not None:
                    pairs = pairs.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("h_root")), "hub", "left").where(
                        F.col("root") != F.coalesce("h_root", "hub"))
                pairs = met_closely(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
                pairs = pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            else:
                moved = light if first is not None else marks
                apart_rows = live.join(nodes.select("node", *moved), "node")
                if finer is not None:
                    many = small(cut_lineage(live.groupBy("key").count().where(F.col("count") > CROWD).select("key"))).withColumn("many", F.lit(True))
                    apart_rows = live.join(nodes, "node").join(many, "key", "left")
                    apart_rows = apart_rows.withColumn("key", F.explode(F.when(F.col("many"), F.array_distinct(finer)).otherwise(F.array("key"))))
                    apart_rows = cut_lineage(apart_rows.select("key", "node", "root", *moved))
                side = lambda s: apart_rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "root", *moved)])
                pairs = side("l").join(side("r"), "key").where((F.col("l_root") < F.col("r_root")) & (first or close)(of("l"), of("r"))).select(
                    F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))
                pairs = exactly(pairs.distinct())
            pairs = cut_lineage((pairs.unionByName(twos) if roots is None else pairs).distinct())
            links = verify(pairs) if verify else pairs
            if roots is not None:
                # What earlier turns linked stands for the groups they made.
                links = links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
            return connected_components(links).select("node", F.col("label").alias("root"))

        roots = settled(spark, turned)
        forget_shuffles(spark)
        if turn == hubs:
            break

        def left_apart(roots=roots) -> DataFrame:
            rows = crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = cut_lineage(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
            return rows.join(apart, "key", "left_semi")

        live = settled(spark, left_apart)
        if live.isEmpty():
            break
    return roots
