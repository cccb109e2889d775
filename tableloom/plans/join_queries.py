"""Joins on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import rounded
from tableloom.operators import joins
from tableloom.operators.joins import JoinStep
from tableloom.plans.base import query, r, round_all, sql_cells, sql_columns, table, tables

# Customers in debt have no nation here and nations of region 0 no key: null keys on both sides.
_NULLS_SQL = """c as (select c_custkey, case when c_acctbal >= 0 then c_nationkey end as c_nationkey from customer),
    n as (select n_name, case when n_regionkey <> 0 then n_nationkey end as n_nationkey from nation)"""


def _null_keys(spark, sf) -> tuple[DataFrame, DataFrame]:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return (customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("c_nationkey")),
            nation.select("n_name", F.when(F.col("n_regionkey") != 0, F.col("n_nationkey")).alias("n_nationkey")))


@query("join_inner", f"""
    with {_NULLS_SQL} select c_custkey, c_nationkey, n_name, n_nationkey from c join n on c_nationkey is not distinct from n_nationkey""")
def join_inner(spark, sf):
    return joins.join_tables(*_null_keys(spark, sf), [("c_nationkey", "n_nationkey")], "inner")


@query("join_left", """
    select o_orderkey, o_custkey, l_orderkey, l_linenumber, l_quantity from orders left join lineitem on o_orderkey = l_orderkey""")
def join_left(spark, sf):
    return joins.join_tables(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), [("o_orderkey", "l_orderkey")], "left")


@query("join_right", """
    select l_orderkey, l_quantity, o_orderkey, o_custkey from lineitem right join orders on o_orderkey = l_orderkey""")
def join_right(spark, sf):
    return joins.join_tables(
        table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"),
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")], "right")


@query("join_full", """
    select c_custkey, c_acctbal, event_id, user_id from customer full join events on c_custkey = user_id""")
def join_full(spark, sf):
    return joins.join_tables(
        table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "events").select("event_id", "user_id"),
        [("c_custkey", "user_id")], "outer")


@query("join_salted", """
    select l_partkey, l_extendedprice, p_brand, p_partkey from lineitem full join part on p_partkey = l_partkey""")
def join_salted(spark, sf):
    return joins.join_tables(
        table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice"), table(spark, sf, "part").select("p_partkey", "p_brand"),
        [("l_partkey", "p_partkey")], "full", heavy_rows=30)


@query("join_collision", """
    select coalesce(a.c_custkey, b.s_suppkey) as key, a.c_acctbal as balance_x, b.s_acctbal as balance_y
    from customer a full join supplier b on a.c_custkey = b.s_suppkey""")
def join_collision(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return joins.join_tables(left, right, [("key", "key")], "full")


PLAN = (
    JoinStep("lineitem", "orders", (("l_orderkey", "o_orderkey"),), "left"),
    JoinStep("lineitem", "customer", (("o_custkey", "c_custkey"),), "left"),
    JoinStep("lineitem", "nation", (("c_nationkey", "n_nationkey"),), "inner"),
)


def _plan_tables(spark, sf) -> dict[str, DataFrame]:
    found = tables(spark, sf, "lineitem", "orders", "customer", "nation")
    return {
        "lineitem": found["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
        "orders": found["orders"].select("o_orderkey", "o_custkey", "o_orderpriority"),
        "customer": found["customer"].select("c_custkey", "c_nationkey", "c_mktsegment"),
        "nation": found["nation"].select("n_nationkey", "n_name"),
    }


@query("join_plan_fold", """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderkey, o_custkey, o_orderpriority, c_custkey, c_nationkey, c_mktsegment,
           n_nationkey, n_name from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey""")
def join_plan_fold(spark, sf):
    return joins.run_join_plan(_plan_tables(spark, sf), PLAN)


@query("join_lineage", """
    select 1::int as seq, 'lineitem' as left_table, 'orders' as right_table, 'left' as join_type,
           '[{"left_column":"l_orderkey","right_column":"o_orderkey"}]' as joining_fields, 'joined_lineitem_orders' as result_table,
           count(*) as row_count, 7::int as column_count from lineitem left join orders on l_orderkey = o_orderkey
    union all select 2, 'lineitem', 'customer', 'left', '[{"left_column":"o_custkey","right_column":"c_custkey"}]',
           'joined_joined_lineitem_orders_customer', count(*), 10 from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    union all select 3, 'lineitem', 'nation', 'inner', '[{"left_column":"c_nationkey","right_column":"n_nationkey"}]',
           'joined_joined_joined_lineitem_orders_customer_nation', count(*), 12
           from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def join_lineage(spark, sf):
    return joins.join_lineage(_plan_tables(spark, sf), PLAN)


_CANDIDATES = [
    ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_name", "part", "p_name"), ("customer", "c_name", "supplier", "s_name"), ("part", "p_name", "supplier", "s_name"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
]


def _containment_sql(lt: str, lc: str, rt: str, rc: str) -> str:
    return f"""
    select '{lt}' as left_table, '{lc}' as left_column, '{rt}' as right_table, '{rc}' as right_column, 1.0::double as name_score,
           (select count(distinct {lc}) from {lt}) as left_distinct, (select count(distinct {rc}) from {rt}) as right_distinct,
           (select count(*) from (select distinct {lc} from {lt} where {lc} in (select {rc} from {rt}))) as common,
           (select count(distinct {lc}) = count({lc}) from {lt}) as left_unique, (select count(distinct {rc}) = count({rc}) from {rt}) as right_unique"""


@query("suggest_join_keys", f"""
    with c as ({' union all '.join(_containment_sql(*c) for c in _CANDIDATES)})
    select *, {r('common::double / left_distinct', 6)} as containment from c""")
def suggest_join_keys(spark, sf):
    found = tables(spark, sf, "orders", "lineitem", "customer", "part", "supplier")
    return round_all(joins.key_containment(found, joins.key_candidates(found)), 6, "containment")


_JOIN_TABLES = ("orders", "lineitem", "customer", "part", "supplier")
# Name tokens without a table prefix; pairs of columns of one kind with similar names; their values counted; the anchor turned to the left.
_SUGGESTED_SQL = f"""
    c as (select *, list_filter(string_split(lower(column_name), '_'), lambda x: x <> '') as w from {sql_columns(*_JOIN_TABLES)}),
    n as (select table_name, place, column_name, kind, t, list_distinct(case when len(w) > 1 and length(w[1]) <= 2 then w[2:] else w end) as w from c),
    pairs as (select a.table_name as lt, a.column_name as lc, b.table_name as rt, b.column_name as rc,
                len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double as name_score
              from n a join n b on a.place < b.place and a.kind = b.kind and a.t not in ('FLOAT', 'DOUBLE') and b.t not in ('FLOAT', 'DOUBLE')),
    p as (select * from pairs where name_score >= 0.5),
    v as (select table_name, column_name, value, count(*) as n from {sql_cells(*_JOIN_TABLES)} group by 1, 2, 3),
    d as (select table_name, column_name, count(*) as d, bool_and(n = 1) as u from v group by 1, 2),
    m as (select p.*, (select count(*) from v a join v b on a.table_name = p.lt and a.column_name = p.lc and b.table_name = p.rt and b.column_name = p.rc and a.value = b.value) as common from p),
    k as (select m.*, dl.d as ld, dl.u as lu, dr.d as rd, dr.u as ru from m join d dl on dl.table_name = lt and dl.column_name = lc join d dr on dr.table_name = rt and dr.column_name = rc where common > 0),
    turned as (select lt as left_table, lc as left_column, rt as right_table, rc as right_column, ld as left_distinct, rd as right_distinct, lu as left_unique, ru as right_unique, name_score, common from k where rt <> 'customer'
      union all select rt, rc, lt, lc, rd, ld, ru, lu, name_score, common from k where rt = 'customer'),
    scored as (select *, common / left_distinct::double as containment,
      0.5::double * greatest(common / left_distinct::double, common / right_distinct::double) + 0.3::double * (left_unique or right_unique)::int + 0.2::double * name_score as score from turned)"""


@query("suggest_joins", f"""
    with {_SUGGESTED_SQL} select left_table, left_column, right_table, right_column, left_distinct, right_distinct, left_unique, right_unique, {r('name_score', 6)} as name_score, common,
      {r('containment', 6)} as containment, {r('score', 6)} as score,
      (row_number() over (partition by left_table, right_table order by round(score, 9) desc, left_column, right_column))::int as rank,
      case when containment < 1 then 'left' else 'inner' end as type_of_join, left_table = 'customer' as with_anchor from scored""")
def suggest_joins(spark, sf):
    return round_all(joins.suggest_joins(tables(spark, sf, *_JOIN_TABLES), anchor="customer"), 6)


@query("join_health", f"""
    with l as (select o_orderkey as k, count(*) as nl from orders group by 1),
    rr as (select case when l_returnflag = 'R' and l_linestatus = 'F' and l_tax = 0 then null else l_orderkey end as k, count(*) as nr from lineitem group by 1),
    b as (select l.k as lk, rr.k as rk, nl, nr from l full join rr on l.k is not distinct from rr.k),
    s as (select sum(nl)::bigint as left_rows, sum(nr)::bigint as right_rows, coalesce(sum(nl) filter (nr is not null), 0)::bigint as left_matched,
      coalesce(sum(nr) filter (nl is not null), 0)::bigint as right_matched, count(*) filter (nl > 1) as left_duplicate_keys,
      count(*) filter (nr > 1) as right_duplicate_keys, coalesce(sum(nl * nr), 0)::bigint as inner_rows,
      coalesce(sum(nl) filter (lk is null), 0)::bigint as left_null_key_rows, coalesce(sum(nr) filter (rk is null), 0)::bigint as right_null_key_rows from b)
    select *, left_rows - left_matched as left_unmatched, right_rows - right_matched as right_unmatched,
      {r('left_matched * 100.0::double / left_rows', 6)} as match_pct, '1:n' as cardinality, {r('inner_rows::double / left_rows', 6)} as fan_out from s""")
def join_health(spark, sf):
    lines = table(spark, sf, "lineitem")
    gone = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)
    lines = lines.select(F.when(~gone, F.col("l_orderkey")).alias("l_orderkey"))
    return round_all(joins.join_health(table(spark, sf, "orders"), lines, [("o_orderkey", "l_orderkey")]), 6)


@query("key_coverage", f"""
    select count(*) filter (o_orderkey in (select l_orderkey from lineitem)) as n_covered, count(*) as n_rows,
           {r('count(*) filter (o_orderkey in (select l_orderkey from lineitem)) * 100.0::double / count(*)', 6)} as coverage_pct from orders""")
def key_coverage(spark, sf):
    return round_all(joins.key_coverage(table(spark, sf, "orders"), table(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")]), 6)


@query("exclude_owned", """
    select p_partkey as part from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_tax = 0)""")
def exclude_owned(spark, sf):
    owned = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_tax = 0").select(F.col("l_partkey").alias("part"))
    return joins.exclude_owned(table(spark, sf, "part").select(F.col("p_partkey").alias("part")), owned, ["part"])


@query("attach_labels", """
    select o_orderkey, o_custkey, case when c_acctbal < 0 then 0 when c_acctbal < 5000 then 1 else 2 end as kmeans_cluster
    from orders left join customer on o_custkey = c_custkey""")
def attach_labels(spark, sf):
    band = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 5000, 1).otherwise(2)
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), band.alias("kmeans_cluster"))
    return joins.attach_labels(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), labels, "o_custkey", "kmeans_cluster")


_PAIRS_SQL = """
    select a.i as item_a, b.i as item_b, count(*) as n_users from p a join p b on a.u = b.u and a.i < b.i group by 1, 2"""


@query("item_cooccurrence", f"with p as (select distinct l_orderkey as u, l_partkey as i from lineitem) {_PAIRS_SQL}")
def item_cooccurrence(spark, sf):
    return joins.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("item_cooccurrence_common", f"select * from (with p as (select distinct l_orderkey as u, l_partkey as i from lineitem) {_PAIRS_SQL}) where n_users >= 2")
def item_cooccurrence_common(spark, sf):
    """Pairs that several orders have; what only one order has is left out before orders meet."""
    return joins.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", min_users=2)


@query("cooccurrence_large_baskets", f"""
    with p as (select distinct o_custkey as u, p_brand as i from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey) {_PAIRS_SQL}""")
def cooccurrence_large_baskets(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joins.cooccurrence(bought, "o_custkey", "p_brand", small_basket=8)
