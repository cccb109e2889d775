"""Merkle manifest of a dataset by a butterfly exchange.

Rows are leaves of one tree per group (source), in order; the groups' roots are the leaves of a tree above. Leaves are cut
into aligned blocks of `fanout ** height`, and a block hashes its subtree alone. Then blocks swap roots round by round:
in round r every block meets those at the same place of the neighbouring groups of `fanout ** r` blocks, at most `fanout` at
a time. Each of them hashes the parent of what it was sent, which all others of its group do as well, and keeps the roots
it was sent as the proof of its own. After as many rounds as there are levels every block has its proof up to the root, and
nothing needs to be sent down again. A task sees one block, or `fanout` roots, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.llm.common import col
from tableloom.session import cut_lineage

FANOUT = 3
# A block has fanout ** HEIGHT leaves: 729 of them, about a hundred kilobytes.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# What is hashed before and after a node to give its parent, level by level.
PROOF = "array<struct<before: string, after: string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes of the value, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return sha(F.concat(*[encoded(v) for v in values]))


def with_places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `at`, the place from 0 within its `tree`, and `n`, the rows of the tree; ordered by ranges, so that no tree is one task's.

    A written table `rows` has the columns tree (no nulls) and `order`; ties keep any order.
    """
    order = [*order, "tie"]
    runs = rows.withColumn("tie", F.monotonically_increasing_id())
    runs = cut_lineage(runs.repartitionByRange("tree", *order).withColumn("run", F.spark_partition_id()))
    tree = Window.partitionBy("tree")
    # One row per tree and range that it lies in.
    before = runs.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("rows")).select(
        "tree", "run", F.coalesce(F.sum("rows").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("run", "tree").orderBy(*order))
    return runs.withColumn("nth", own).join(before, ["tree", "run"]).withColumn("at", F.col("before") + F.col("nth") - 1).drop("tie", "run", "nth", "before")


def _node(array: Column, at: Column) -> Column:
    return F.coalesce(F.get(array, at), F.lit(""))


def _block_levels(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """With the nodes of every level as arrays level0, level1, ...; a tree of one block ends at its root, which then repeats."""

    def parents(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda j: sha(F.concat(*[_node(below, j * fanout + d) for d in range(fanout)])))

    blocks = blocks.withColumn("level0", F.transform("leaves", lambda x: x["leaf"]))
    for up in range(1, height + 1):
        below = F.col(f"level{up - 1}")
        blocks = blocks.withColumn(f"level{up}", F.when((F.size(below) > 1) | (F.col("n_blocks") > 1), parents(below)).otherwise(below))
    return blocks


def _within_block(fanout: int, height: int) -> Column:
    """The leaves of a block, each with its proof up to the block's root."""

    def step(i: Column, level: int) -> Column:
        nodes = F.col(f"level{level}")
        at = F.floor(i / fanout**level).cast("int")
        first, place = at - at % fanout, at % fanout
        before = F.concat(*[F.when(F.lit(d) < place, _node(nodes, first + d)).otherwise("") for d in range(fanout - 1)])
        after = F.concat(*[F.when(F.lit(d) > place, _node(nodes, first + d)).otherwise("") for d in range(1, fanout)])
        return F.when((F.size(nodes) > 1) | (F.col("n_blocks") > 1), F.struct(before.alias("before"), after.alias("after")))

    return F.transform("leaves", lambda x, i: x.withField("proof", F.array_compact(F.array(*[step(i, level) for level in range(height)])).cast(PROOF)))


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, upper, top): from a written table (tree, block, n_blocks, root), the proof of every block's root and the root of its tree.

    Round r joins aligned groups of fanout ** r blocks. A block has the same place in its group as those it swaps with;
    where the last group of a tree is short, its last block answers for the places that are missing.
    """
    state = blocks.select("tree", "block", "n_blocks", F.col("root").alias("top"), F.array().cast(PROOF).alias("upper"))
    done = [state.where("n_blocks = 1")]
    rounds, width = blocks.agg(F.max("n_blocks")).first()[0] or 1, 1
    state = state.where("n_blocks > 1")
    while width < rounds:
        place = F.col("block") % width
        last = F.when(F.col("block") == F.col("n_blocks") - 1, F.lit(width - 1)).otherwise(place)
        sent = state.select(
            "tree", F.floor(F.col("block") / (width * fanout)).alias("group"), F.explode(F.sequence(place, last)).alias("place"), place.alias("own"),
            F.struct(F.floor(F.col("block") / width).alias("nth"), F.col("top").alias("root"), "block", "n_blocks", "upper").alias("m"))
        met = sent.groupBy("tree", "group", "place").agg(F.sort_array(F.collect_list(F.struct("m.nth", "own", "m"))).alias("met"))
        one = met.select("tree", "place", F.transform("met", lambda x: x["m"]["root"]).alias("roots"), F.posexplode("met").alias("nth", "x"))
        # A block that answered for missing places goes on at its own.
        one = one.where("x.own = place")
        state = cut_lineage(one.select(
            "tree", F.col("x.m.block").alias("block"), F.col("x.m.n_blocks").alias("n_blocks"), sha(F.array_join("roots", "")).alias("top"),
            F.concat("x.m.upper", F.array(F.struct(
                F.array_join(F.filter("roots", lambda _, i: i < F.col("nth")), "").alias("before"),
                F.array_join(F.filter("roots", lambda _, i: i > F.col("nth")), "").alias("after"))).cast(PROOF)).alias("upper")))
        width *= fanout
        done.append(state.where(F.col("n_blocks") <= width))
        state = state.where(F.col("n_blocks") > width)
    return reduce(DataFrame.unionByName, done).select("tree", "block", "upper", "top")


def merkle(rows: DataFrame, order: Sequence[str], fanout: int = FANOUT, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The blocks of all trees (tree, block, n_blocks, leaves), and for each block (tree, block, upper, top).

    `rows` is a written table with the columns tree (no nulls), leaf and `order`. `upper` is the proof of the block's root,
    `top` the root of the tree. Both tables are written.
    """
    size = fanout**height
    placed = with_places(rows, order)
    kept = [c for c in rows.columns if c != "tree"]
    blocks = placed.groupBy("tree", F.floor(F.col("at") / size).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", *kept))).alias("leaves"), F.first(F.ceil(F.col("n") / size)).alias("n_blocks"))
    # Leaves and roots are kept; what lies between is worked out again where proofs are made.
    blocks = cut_lineage(_block_levels(blocks, fanout, height).select("tree", "block", "n_blocks", "leaves", F.get(f"level{height}", F.lit(0)).alias("root")))
    return blocks.drop("root"), cut_lineage(butterfly(blocks.drop("leaves"), fanout))


def members(blocks: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """The rows of all blocks as `m`, with `m.proof` up to the block's root, and what `above` (tree, block, ...) says of the block."""
    joined = _block_levels(blocks.join(above, ["tree", "block"]), fanout, height)
    rest = [c for c in above.columns if c not in ("tree", "block")]
    return joined.select("tree", F.explode(_within_block(fanout, height)).alias("m"), *rest)


def manifest(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, height: int = HEIGHT,
    tamper: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, group, leaf, proof, subroot, root, folded_root) for every row.

    A leaf hashes the row's `fields`. Per group leaves ascend by id (null ids first, then by hash); the groups' roots ascend
    by group (null first, then bytewise). `proof` lists per level, up to `root`, what is hashed before and after.
    `folded_root` is what the proof makes of the row, with the columns of `tamper` in place of its own where given.
    Null groups are a group. Rows that repeat an id, or are wholly alike, are leaves of their own. Long texts are hashed
    where they are read and do not move. Other columns are not looked at; an empty table gives none.
    """
    if fanout < 2:
        raise ValueError("a fanout of two at least")
    values, changed = [col(f) for f in fields], [(tamper or {}).get(f, col(f)) for f in fields]
    # No group is null from here on: the null group is the empty text, all others begin with a plus.
    group = F.coalesce(F.concat(F.lit("+"), col(group_col).cast("string")), F.lit(""))
    leaf = leaf_hash(values)
    leaves = df.select(group.alias("tree"), col(id_col).alias("id"), leaf.alias("leaf"), (leaf_hash(changed) if tamper else leaf).alias("found"))
    leaves = cut_lineage(leaves.withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found"))))
    blocks, tops = merkle(leaves, ["id", "leaf"], fanout, height)

    subroots = cut_lineage(tops.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf")))
    groups = members(*merkle(subroots, ["name"], fanout, height), fanout, height)
    groups = groups.select(F.col("m.name").alias("tree"), F.col("m.leaf").alias("subroot"), F.concat("m.proof", "upper").alias("above"), F.col("top").alias("root"))
    # A hot group meets its proof by blocks, which are few and small here, and its rows by block.
    above = tops.join(cut_lineage(groups), "tree").select("tree", "block", F.concat("upper", "above").alias("rest"), "subroot", "root")

    rows = members(blocks, cut_lineage(above), fanout, height).select(
        F.col("m.id").alias("id"), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group"), F.col("m.leaf").alias("leaf"),
        F.concat("m.proof", "rest").alias("proof"), "subroot", "root", F.coalesce("m.found", "m.leaf").alias("found"))
    return rows.withColumn("folded_root", fold(F.col("found"), F.col("proof"))).drop("found")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a proof makes of a leaf."""
    return F.aggregate(proof, leaf, lambda node, step: sha(F.concat(step["before"], node, step["after"])))


def siblings_text(proof: Column) -> Column:
    """The siblings of a proof in a row, from the leaf's level up and from left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")
