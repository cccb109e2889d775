import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tableloom.operators import joins
from tableloom.operators.joins import JoinStep


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_null_keys_match(spark):
    left = spark.createDataFrame([(1,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    assert joins.join_tables(left, right, [("a", "b")]).count() == 2
    assert joins.join_tables(left, right, [("a", "b")], null_equal=False).count() == 1


def test_colliding_names(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, v int"), spark.createDataFrame([(1, 3)], "b int, v int")
    assert joins.join_tables(left, right, [("a", "b")]).columns == ["a", "v_x", "b", "v_y"]
    same = joins.join_tables(left, right.withColumnRenamed("b", "a"), [("a", "a")], "left")
    assert same.columns == ["a", "v_x", "v_y"] and rows(same) == [(1, 2, 3)]
    with pytest.raises(ValueError):
        joins.join_tables(left.withColumn("v_x", F.lit(1)), right, [("a", "b")])
    with pytest.raises(ValueError):
        joins.join_tables(left, right, [("nope", "b")])


def test_unknown_type_is_inner():
    assert joins.join_type("sideways") == "inner" and joins.join_type("OUTER") == "full"


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("same, equal", [(True, True), (False, True), (False, False)])
def test_dealt_join_equals_plain_join(spark, how, same, equal):
    rng = random.Random(4)
    left = spark.createDataFrame([(None if i % 9 == 0 else (0 if i % 2 else rng.randrange(12)), i % 7) for i in range(90)], "k int, v int")
    right = spark.createDataFrame([(None if i % 8 == 0 else rng.choice([0, *range(3, 18)]), -i) for i in range(40)], f"{'k' if same else 'q'} int, v int")
    on = [("k", "k" if same else "q")]
    plain = joins.join_tables(left, right, on, how, equal)
    for heavy in (5, 1):
        dealt = joins.join_tables(left, right, on, how, equal, heavy_rows=heavy)
        assert plain.columns == dealt.columns and rows(plain) == rows(dealt)


def test_full_join_deals_only_the_heavy_key(spark, monkeypatch):
    # Key 7 has a third of all rows, all of them alike.
    left = spark.createDataFrame([(7, 1)] * 60 + [(i, i) for i in range(100, 220)], "k int, v int").repartition(6)
    right = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (110, "d")], "q int, w string")
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    seen, write = [], joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: seen.append(write(df)) or seen[-1])
    found = joins.join_tables(left, right, [("k", "q")], "full")
    heavy, dealt = seen
    assert [tuple(r) for r in heavy.collect()] == [(7, 6)]
    # Sixty equal rows in six parts, none of them with most.
    parts = Counter(r["__part"] for r in dealt.collect())
    assert sum(parts.values()) == 60 and len(parts) == 6 and max(parts.values()) <= 20
    assert found.count() == 2 * 60 + 120 + 1
    # The other way round the heavy side is on the right.
    turned = joins.join_tables(right, left, [("q", "k")], "full")
    assert turned.columns == ["q", "w", "k", "v"] and rows(turned) == rows(found.select("q", "w", "k", "v")) and len(seen) == 6


def test_plan_follows_tables_into_results(spark):
    t = {n: spark.createDataFrame([(1, 10 + i)], f"id{i} int, {n} int") for i, n in enumerate("abc")}
    steps = [JoinStep("a", "b", (("id0", "id1"),)), JoinStep("c", "b", (("id2", "id1"),), "left")]
    out = joins.run_join_plan(t, steps)
    assert sorted(out.columns) == sorted(["id0", "a", "id1", "b", "id2", "c"])
    history = rows(joins.join_lineage(t, steps))
    assert history[1][5] == "joined_c_joined_a_b" and history[1][6] == 1
    assert joins.run_join_plan({"a": t["a"]}, []).columns == t["a"].columns
    with pytest.raises(ValueError):
        joins.run_join_plan(t, steps[:1])
    with pytest.raises(ValueError):
        joins.run_join_plan(t, [steps[0], steps[0]])


def test_health(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (1,), (3,), (None,)], "b int")
    h = joins.join_health(left, right, [("a", "b")]).first()
    assert (h["left_matched"], h["right_matched"], h["inner_rows"], h["cardinality"]) == (3, 3, 5, "n:m")
    assert (h["left_null_key_rows"], h["left_unmatched"], h["match_pct"], h["fan_out"]) == (1, 1, 75.0, 1.25)


def test_labels_must_be_unique(spark):
    df, labels = spark.range(3), spark.createDataFrame([(0, 5), (1, 6)], "id bigint, c int")
    assert rows(joins.attach_labels(df, labels, "id", "c")) == [(0, 5), (1, 6), (2, None)]
    with pytest.raises(Exception, match="repeats id"):
        joins.attach_labels(df, labels.unionByName(labels), "id", "c").collect()


def test_suggested_joins(spark):
    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_id int, o_custkey int")
    customer = spark.createDataFrame([(7, "a"), (9, "b")], "c_custkey int, c_name string")
    best = joins.suggest_joins({"orders": orders, "customer": customer}, anchor="customer").where("rank = 1").first()
    assert (best["left_column"], best["right_column"], best["type_of_join"]) == ("o_custkey", "c_custkey", "left")
    assert (best["common"], best["left_distinct"], best["containment"], best["right_unique"], best["with_anchor"]) == (1, 2, 0.5, True, True)


@pytest.mark.parametrize("small,items,users", [(64, 1024, 1024), (3, 1024, 1024), (0, 4, 3), (2, 5, 100)])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_cooccurrence_equals_counting(spark, small, items, users, kind):
    rng = random.Random(5)
    # User 0 has every item; item 1 belongs to nearly everyone.
    data = [(0, i) for i in range(20)] + [(u, 1) for u in range(1, 25)] + [(rng.randrange(25), rng.randrange(20)) for _ in range(120)]
    convert = int if kind == "int" else (lambda i: f"i{i:02d}")
    data = [(u, convert(i)) for u, i in data]
    baskets: dict = {}
    for u, i in data:
        baskets.setdefault(u, set()).add(i)
    want = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    df = spark.createDataFrame(data, f"u int, i {kind}")
    got = joins.cooccurrence(df, "u", "i", small, items, users).collect()
    assert {(r["item_a"], r["item_b"]): r["n_users"] for r in got} == dict(want) and len(got) == len(want)


def test_large_baskets_travel_packed_and_rare_items_stay_out(spark):
    # One basket of 2,000 items in 20 blocks: a packed row for each pair of blocks, both ways, not 40,000 rows of items.
    wide = spark.range(2000).select(F.lit(1).alias("u"), F.col("id").alias("i"))
    tiles = joins.basket_tiles(wide, 20, 1)
    assert tiles.count() <= 400 and tiles.agg(F.sum(F.size("items"))).first()[0] == 40_000
    rng = random.Random(6)
    data = [(u, i) for u in range(30) for i in rng.sample(range(40), 12 if u % 3 else 3)] + [(100, i) for i in range(40, 80)]
    baskets = {}
    for u, i in data:
        baskets.setdefault(u, set()).add(i)
    counts = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    for small in (2, 100):
        got = joins.cooccurrence(spark.createDataFrame(data, "`the.user` int, i int"), "the.user", "i", small, 7, 5, min_users=4).collect()
        assert {(r["item_a"], r["item_b"]): r["n_users"] for r in got} == {p: n for p, n in counts.items() if n >= 4}


def test_set_places_and_coverage(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "y int")
    assert rows(joins.item_sets(a, b)) == [(1, "left_only"), (2, "both"), (3, "right_only")]
    assert joins.key_coverage(a, b, [("x", "y")]).first()["coverage_pct"] == 50.0
    assert rows(joins.exclude_owned(a, b.withColumnRenamed("y", "x"), ["x"])) == [(1,)]
