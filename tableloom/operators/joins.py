"""Joins of business tables, join plans, join health and key suggestions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.functions.scalars import named
from tableloom.functions.stats import HOT_ROWS
from tableloom.operators.pairwise import tile_partitions
from tableloom.operators.profile import type_class
from tableloom.session import cut_lineage
from tableloom.sources.catalog import joined_name

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def join_type(how: str) -> str:
    """Unknown join types run as inner."""
    return JOIN_TYPES.get(how.lower(), "inner")


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "inner",
    null_equal: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
    heavy_rows: int | None = None,
) -> DataFrame:
    """Equi-join on pairs of columns; null keys match null keys unless `null_equal=False`.

    A pair of equal names gives one key column; other shared names get the suffixes. Spark splits
    skewed keys of inner, left and right joins at run time. A full join cannot be split so: there, and wherever
    `heavy_rows` is given, keys with more than so many rows on the side that is kept whole (the left one; of a right join the
    right one; of a full join the right one if the left has none) are found by a count, their rows are dealt over parts of that size, and only their partners are copied.
    """
    pairs = [(a, b) for a, b in on if a in left.columns and b in right.columns]
    if not pairs:
        raise ValueError("no join fields present on both sides")
    how = join_type(how)
    if heavy_rows is not None and how == "right":
        flipped = join_tables(right, left, [(b, a) for a, b in pairs], "left", null_equal, suffixes[::-1], heavy_rows)
        return flipped.select(*join_tables(left.limit(0), right.limit(0), pairs, "right", null_equal, suffixes).columns)
    same = {a for a, b in pairs if a == b}
    shared = (set(left.columns) & set(right.columns)) - same
    l = left.toDF(*[f"l_{i}" for i in range(len(left.columns))])
    r = right.toDF(*[f"r_{i}" for i in range(len(right.columns))])
    lname, rname = dict(zip(left.columns, l.columns)), dict(zip(right.columns, r.columns))
    compare = (lambda a, b: a.eqNullSafe(b)) if null_equal else (lambda a, b: a == b)
    match = reduce(lambda x, y: x & y, [compare(F.col(lname[a]), F.col(rname[b])) for a, b in pairs])
    out: list[tuple[str, Column]] = []
    for c in left.columns:
        col = F.col(lname[c])
        if c in same and how in ("right", "full"):
            col = F.coalesce(col, F.col(rname[c]))
        out.append((c + suffixes[0] if c in shared else c, col))
    out += [(c + suffixes[1] if c in shared else c, F.col(rname[c])) for c in right.columns if c not in same]
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash after suffixing: {sorted({n for n in names if names.count(n) > 1})}")
    final = [c.alias(n) for n, c in out]
    if heavy_rows is None and how != "full":
        return l.join(r, match, how).select(*final)
    heavy = heavy_keys(l, [lname[a] for a, _ in pairs], heavy_rows or HOT_ROWS, null_equal)
    if heavy is None:
        if how == "full" and heavy_keys(r, [rname[b] for _, b in pairs], heavy_rows or HOT_ROWS, null_equal) is not None:
            return join_tables(right, left, [(b, a) for a, b in pairs], "full", null_equal, suffixes[::-1], heavy_rows or HOT_ROWS).select(*names)
        return l.join(r, match, how).select(*final)
    on_heavy = lambda cols: reduce(lambda x, y: x & y, [compare(F.col(c), F.col(f"__k{i}")) for i, c in enumerate(cols)])
    keys_l, keys_r = [lname[a] for a, _ in pairs], [rname[b] for _, b in pairs]
    kept = "inner" if how == "inner" else "left"
    light = l.join(heavy, on_heavy(keys_l), "left_anti").join(r, match, kept)
    # Dealt by their place and not by what they hold, so that equal rows part as well; written, so that they stay where they are.
    dealt = l.join(heavy, on_heavy(keys_l)).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts"))).select(*l.columns, "__part")
    copies = r.join(heavy, on_heavy(keys_r)).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).select(*r.columns, "__copy")
    spread = cut_lineage(dealt).join(copies, (F.col("__part") == F.col("__copy")) & match, kept)
    joined = light.select(*final).unionByName(spread.select(*final))
    if how != "full":
        return joined
    # The unmatched right rows: an anti join keeps the right side as it is and only needs distinct left keys.
    known = l.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys_l)]).distinct()
    lonely = r.join(known, on_heavy(keys_r), "left_anti")
    blanks = {lname[c]: F.lit(None).cast(left.schema[c].dataType) for c in left.columns}
    return joined.unionByName(lonely.withColumns(blanks).select(*final))


def heavy_keys(df: DataFrame, cols: Sequence[str], heavy_rows: int, null_equal: bool = True) -> DataFrame | None:
    """A written table (__k0, ..., __parts) of the keys with more than `heavy_rows` rows and the parts to deal them over; None if there is none.

    The count combines before it moves, and there are no more such keys than rows / `heavy_rows`.
    """
    rows = df if null_equal else df.dropna(subset=list(cols))
    counts = rows.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_rows)
    found = cut_lineage(counts.withColumn("__parts", F.ceil(F.col("n") / heavy_rows)).drop("n"))
    return None if found.isEmpty() else found


@dataclass(frozen=True)
class JoinStep:
    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    how: str = "inner"


def _fold(tables: dict[str, DataFrame], steps: Sequence[JoinStep]) -> tuple[dict[str, DataFrame], list[tuple[JoinStep, str, DataFrame]]]:
    pool, lives_in, history = dict(tables), {t: t for t in tables}, []

    def current(name: str) -> str:
        # Follow a table through every join into the result that now holds it.
        while lives_in.get(name, name) != name:
            name = lives_in[name]
        return name

    for step in steps:
        left, right = current(step.left), current(step.right)
        if left == right:
            raise ValueError(f"{step.left} and {step.right} are joined already")
        result = joined_name(left, right)
        joined = join_tables(pool.pop(left), pool.pop(right), step.on, step.how)
        pool[result], lives_in[left], lives_in[right], lives_in[result] = joined, result, result, result
        history.append((step, result, joined))
    return pool, history


def run_join_plan(tables: dict[str, DataFrame], steps: Sequence[JoinStep]) -> DataFrame:
    """Join pair after pair until one table is left; still one lazy plan. A single table passes through."""
    pool, _ = _fold(tables, steps)
    if len(pool) != 1:
        raise ValueError(f"tables left over: {sorted(pool)}")
    return next(iter(pool.values()))


def join_lineage(tables: dict[str, DataFrame], steps: Sequence[JoinStep]) -> DataFrame:
    """One row per join: inputs, type, fields, result name, rows and columns of the result."""
    rows = []
    for i, (step, result, df) in enumerate(_fold(tables, steps)[1]):
        fields = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column")) for a, b in step.on])
        rows.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(i + 1).alias("seq"), F.lit(step.left).alias("left_table"), F.lit(step.right).alias("right_table"),
            F.lit(join_type(step.how)).alias("join_type"), F.to_json(fields).alias("joining_fields"),
            F.lit(result).alias("result_table"), "row_count", F.lit(len(df.columns)).alias("column_count"),
        ))
    return reduce(DataFrame.unionByName, rows)


def join_preview(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", n: int = 5) -> DataFrame:
    return join_tables(left, right, on, how).limit(n)


def join_health(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """One row on how well two tables fit: matched rows, duplicate keys, cardinality, fan-out, null keys.

    Both sides are reduced to rows per key first; the row-level join never runs.
    """
    keys = [f"k{i}" for i in range(len(on))]

    def per_key(df: DataFrame, cols: Sequence[str], n: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(k) for c, k in zip(cols, keys)]).agg(F.count(F.lit(1)).alias(n))

    l = per_key(left, [a for a, _ in on], "nl").toDF(*[f"l_{k}" for k in keys], "nl")
    r = per_key(right, [b for _, b in on], "nr").toDF(*[f"r_{k}" for k in keys], "nr")
    match = reduce(lambda a, b: a & b, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys])
    both = l.join(r, match, "full")
    lnull = reduce(lambda a, b: a | b, [F.col(f"l_{k}").isNull() for k in keys])
    rnull = reduce(lambda a, b: a | b, [F.col(f"r_{k}").isNull() for k in keys])
    nl, nr = F.col("nl"), F.col("nr")
    hit = nl.isNotNull() & nr.isNotNull()

    def total(cond: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    sums = both.agg(
        total(nl.isNotNull(), nl).alias("left_rows"), total(nr.isNotNull(), nr).alias("right_rows"),
        total(hit, nl).alias("left_matched"), total(hit, nr).alias("right_matched"),
        F.count_if(nl > 1).alias("left_duplicate_keys"), F.count_if(nr > 1).alias("right_duplicate_keys"),
        total(hit, nl * nr).alias("inner_rows"),
        total(nl.isNotNull() & lnull, nl).alias("left_null_key_rows"),
        total(nr.isNotNull() & rnull, nr).alias("right_null_key_rows"),
    )
    side = lambda dup: F.when(F.col(dup) > 0, "n").otherwise("1")
    cardinality = F.concat(side("left_duplicate_keys"), F.lit(":"), side("right_duplicate_keys"))
    return sums.select(
        "*",
        (F.col("left_rows") - F.col("left_matched")).alias("left_unmatched"),
        (F.col("right_rows") - F.col("right_matched")).alias("right_unmatched"),
        F.try_divide(F.col("left_matched") * 100.0, F.col("left_rows").cast("double")).alias("match_pct"),
        F.when(cardinality == "n:n", "n:m").otherwise(cardinality).alias("cardinality"),
        F.try_divide(F.col("inner_rows").cast("double"), F.col("left_rows").cast("double")).alias("fan_out"),
    )


def key_coverage(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Left rows whose key occurs on the right, and their share, by a semi join on distinct keys."""
    keys = right.select(*[F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(on)]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"__r{i}")) for i, (a, _) in enumerate(on)])
    covered = left.join(keys, match, "left_semi").agg(F.count(F.lit(1)).alias("n_covered"))
    return covered.withColumn("n_rows", left.agg(F.count(F.lit(1))).scalar()).withColumn(
        "coverage_pct", F.try_divide(F.col("n_covered") * 100.0, F.col("n_rows").cast("double"))
    )


def exclude_owned(candidates: DataFrame, owned: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates that do not occur in `owned`."""
    return candidates.join(owned.select(*on).distinct(), list(on), "left_anti")


def item_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members of two sets with their place: left_only, right_only or both."""
    col = left.columns[0]
    sides = left.toDF(col).withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(
        right.toDF(col).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    seen = sides.groupBy(col).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    place = F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return seen.select(col, place.alias("place"))


def attach_labels(df: DataFrame, labels: DataFrame, on: str, label: str) -> DataFrame:
    """Left join of one label per id; fails at run time when the mapping holds an id twice."""
    single = labels.groupBy(F.col(on).alias("__id")).agg(F.max(label).alias("__label"), F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("label mapping repeats id "), F.col("__id").cast("string")))).otherwise(F.col("__label"))
    mapping = single.select("__id", checked.alias("__label"))
    return df.join(mapping, F.col(on).eqNullSafe(F.col("__id")), "left").select(*df.columns, F.col("__label").alias(label))


def _name_score(a: str, b: str) -> float:
    """Share of name tokens two columns have in common, table prefixes aside."""
    def tokens(name: str) -> set[str]:
        parts = [p for p in name.lower().split("_") if p]
        return set(parts[1:] if len(parts) > 1 and len(parts[0]) <= 2 else parts)

    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def key_candidates(
    tables: dict[str, DataFrame], roles: dict[str, dict[str, str]] | None = None, min_name_score: float = 0.5
) -> list[tuple[str, str, str, str, float]]:
    """Column pairs worth a look, from the schemas alone: same type class, similar names or the same role."""
    roles = roles or {}
    names, found = list(tables), []
    for i, lt in enumerate(names):
        for rt in names[i + 1:]:
            for lf in tables[lt].schema.fields:
                for rf in tables[rt].schema.fields:
                    if type_class(lf.dataType) != type_class(rf.dataType) or isinstance(lf.dataType, T.FractionalType):
                        continue
                    shared_role = any(roles.get(lt, {}).get(r) == lf.name and roles.get(rt, {}).get(r) == rf.name for r in roles.get(lt, {}))
                    score = 1.0 if shared_role else _name_score(lf.name, rf.name)
                    if score >= min_name_score:
                        found.append((lt, lf.name, rt, rf.name, score))
    return found


def key_containment(tables: dict[str, DataFrame], candidates: Sequence[tuple[str, str, str, str, float]]) -> DataFrame:
    """Distinct and common values and key uniqueness per candidate pair, from one shuffle of all key values.

    All candidate columns become (column, value) counts; grouping by value shows which columns share
    it. A value carries one entry per column at most, so no group grows with the data.
    """
    wanted = sorted({(t, c) for lt, lc, rt, rc, _ in candidates for t, c in ((lt, lc), (rt, rc))})
    number = {tc: i for i, tc in enumerate(wanted)}
    counts = []
    for t in sorted({t for t, _ in wanted}):
        cols = [c for tt, c in wanted if tt == t]
        cells = F.array(*[F.struct(F.lit(number[t, c]).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
        counts.append(tables[t].select(F.explode(cells).alias("x")).select("x.*").where("value is not null")
                      .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")))
    values = reduce(DataFrame.unionByName, counts)
    # Fixed-width state per value: one slot per candidate column.
    per_value = values.groupBy("value").agg(*[F.max(F.when(F.col("col") == i, F.col("n"))).alias(f"c{i}") for i in number.values()])
    aggs = []
    for j, (lt, lc, rt, rc, _) in enumerate(candidates):
        a, b = F.col(f"c{number[lt, lc]}"), F.col(f"c{number[rt, rc]}")
        aggs.append(F.struct(
            F.count(a).alias("left_distinct"), F.count(b).alias("right_distinct"),
            F.count_if(a.isNotNull() & b.isNotNull()).alias("common"),
            (F.count_if(a > 1) == 0).alias("left_unique"), (F.count_if(b > 1) == 0).alias("right_unique"),
        ).alias(f"p{j}"))
    one = per_value.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(lt).alias("left_table"), F.lit(lc).alias("left_column"), F.lit(rt).alias("right_table"),
                 F.lit(rc).alias("right_column"), F.lit(float(s)).alias("name_score"), F.col(f"p{j}").alias("p"))
        for j, (lt, lc, rt, rc, s) in enumerate(candidates)
    ])
    return one.select(F.explode(rows).alias("x")).select(
        "x.left_table", "x.left_column", "x.right_table", "x.right_column", "x.name_score", "x.p.*"
    ).withColumn("containment", F.try_divide(F.col("common").cast("double"), F.col("left_distinct").cast("double")))


def suggest_joins(
    tables: dict[str, DataFrame], roles: dict[str, dict[str, str]] | None = None, anchor: str | None = None
) -> DataFrame:
    """Ranked join proposals: containment in either direction, key uniqueness and name similarity.

    The anchor table is the left one of its pairs. Left join when the left table's keys are not fully covered, inner
    join otherwise; ranks are per pair of tables.
    """
    measured = key_containment(tables, key_candidates(tables, roles)).where("common > 0")
    # Turned where the anchor came second.
    turn = F.col("right_table") == F.lit(anchor)
    sides = ("table", "column", "distinct", "unique")
    measured = measured.select(
        *[F.when(turn, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a, b in (("left", "right"), ("right", "left")) for c in sides], "name_score", "common")
    measured = measured.withColumn("containment", F.try_divide(F.col("common").cast("double"), F.col("left_distinct").cast("double")))
    back = F.try_divide(F.col("common").cast("double"), F.col("right_distinct").cast("double"))
    unique = (F.col("left_unique") | F.col("right_unique")).cast("double")
    score = 0.5 * F.greatest(F.coalesce("containment", F.lit(0.0)), F.coalesce(back, F.lit(0.0))) + 0.3 * unique + 0.2 * F.col("name_score")
    rank = F.row_number().over(Window.partitionBy("left_table", "right_table").orderBy(F.round("score", 9).desc(), "left_column", "right_column"))
    return (
        measured.withColumn("score", score).withColumn("rank", rank)
        .withColumn("type_of_join", F.when(F.col("containment") < 1, "left").otherwise("inner"))
        .withColumn("with_anchor", F.coalesce(F.col("left_table") == F.lit(anchor), F.lit(False)))
    )


def suggested_steps(tables: dict[str, DataFrame], roles: dict[str, dict[str, str]] | None = None, anchor: str | None = None) -> list[JoinStep]:
    """A join plan from the suggestions: from the anchor (without one, the first table) on, the best pair that brings in a new table.

    Tables that no key connects are left out. The table that is there already is the left one.
    """
    anchor = anchor or next(iter(tables))
    # One row per pair of tables.
    found = [r.asDict() for r in suggest_joins(tables, roles, anchor).where("rank = 1").collect()]
    inside, steps = {anchor}, []
    while True:
        open_ = []
        for r in found:
            for a, b in (("left", "right"), ("right", "left")):
                if r[f"{a}_table"] in inside and r[f"{b}_table"] not in inside:
                    how = "left" if r["common"] < r[f"{a}_distinct"] else "inner"
                    open_.append((-round(r["score"], 9), r[f"{a}_table"], r[f"{b}_table"], r[f"{a}_column"], r[f"{b}_column"], how))
        if not open_:
            return steps
        _, left, right, lc, rc, how = min(open_)
        steps.append(JoinStep(left, right, ((lc, rc),), how))
        inside.add(right)


# --- items that occur together ---------------------------------------------------------------

# Largest basket whose pairs are listed one by one; larger ones are multiplied block by block.
SMALL_BASKET = 64
TILE_ITEMS = 1024
TILE_USERS = 1024


def cooccurrence(
    df: DataFrame, user: str, item: str, small_basket: int = SMALL_BASKET,
    tile_items: int = TILE_ITEMS, tile_users: int = TILE_USERS, min_users: int = 1,
) -> DataFrame:
    """(item_a < item_b, n_users): users who have both items, for pairs that at least `min_users` have. Exact for baskets of any size.

    Small baskets meet in a self join and combine before the shuffle. Large baskets would emit the
    square of their size, so their user-by-item incidence is cut into tiles of bounded size whose
    products yield counts per item pair at once; a basket travels as one packed row per block of items and block
    that it meets. Items that too few users have cannot be in an answer and are left out before baskets meet.
    """
    pairs = df.where(named(user).isNotNull() & named(item).isNotNull()).select(named(user).alias("u"), named(item).alias("i")).distinct()
    if min_users > 1:
        pairs = cut_lineage(pairs)
        common = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_users).select("i")
        pairs = cut_lineage(pairs.join(common, "i", "left_semi"))
    found = _cooccurrence(pairs, small_basket, tile_items, tile_users)
    return found.where(F.col("n_users") >= min_users) if min_users > 1 else found


def basket_tiles(large: DataFrame, blocks: int, slices: int) -> DataFrame:
    """(s, lo, hi, b, u, items): the baskets (u, i) as packed rows, one for each block of items that a basket has and block that it meets there."""
    placed = large.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")).withColumn("s", F.pmod(F.xxhash64("u"), F.lit(slices)).cast("int"))
    # A block holds about as many items as a tile is wide, whatever the basket.
    packed = cut_lineage(placed.groupBy("u", "s", "b").agg(F.collect_list("i").alias("items")))
    spans = packed.groupBy("u").agg(F.collect_list("b").alias("partners"))
    return packed.join(spans, "u").select("u", "s", "b", "items", F.explode("partners").alias("p")).select(
        "s", F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"), "b", "u", "items")


def _cooccurrence(pairs: DataFrame, small_basket: int, tile_items: int, tile_users: int) -> DataFrame:
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("size"))
    large_users = sizes.where(F.col("size") > small_basket).select("u")
    small = pairs.join(sizes.where(F.col("size") <= small_basket).select("u"), "u", "left_semi")
    listed = (
        small.select("u", F.col("i").alias("item_a")).join(small.select("u", F.col("i").alias("item_b")), "u")
        .where(F.col("item_a") < F.col("item_b")).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
    )
    n_large = large_users.count()
    if n_large == 0:
        return listed.withColumnRenamed("n", "n_users")
    large = pairs.join(large_users, "u", "left_semi")
    n_items = large.agg(F.count_distinct("i")).first()[0]
    blocks, slices = -(-n_items // tile_items), -(-n_large // tile_users)
    tiles = basket_tiles(large, blocks, slices)
    tiles = tiles.repartition(tile_partitions(slices * blocks * (blocks + 1) // 2), "s", "lo", "hi")

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        users, _ = pd.factorize(pdf["u"])
        sides = []
        for block in (lo, hi):
            mine = (pdf["b"] == block).to_numpy()
            baskets = pdf["items"][mine]
            codes, names = pd.factorize(np.concatenate([np.asarray(x) for x in baskets]) if len(baskets) else np.zeros(0, dtype=object))
            grid = np.zeros((len(names), users.max() + 1), dtype=np.float32)
            grid[codes, np.repeat(users[mine], [len(x) for x in baskets])] = 1
            sides.append((names, grid))
        (left, a), (right, b) = sides
        counts = a @ b.T
        x, y = np.nonzero(counts)
        out = pd.DataFrame({"x": np.asarray(left)[x], "y": np.asarray(right)[y], "n": counts[x, y].astype("int64")})
        if lo == hi:
            return out[out["x"] < out["y"]]
        swap = out["x"] > out["y"]
        out.loc[swap, ["x", "y"]] = out.loc[swap, ["y", "x"]].to_numpy()
        return out

    kind = pairs.schema["i"].dataType
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("n", T.LongType())])
    partial = tiles.groupBy("s", "lo", "hi").applyInPandas(multiply, schema).toDF("item_a", "item_b", "n")
    return listed.unionByName(partial).groupBy("item_a", "item_b").agg(F.sum("n").alias("n_users"))
