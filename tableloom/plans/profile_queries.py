"""Profiling, checks and scalar functions on the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tableloom.functions.scalars import dot, norm, rounded, title_of, to_number
from tableloom.operators import profile as ops
from tableloom.plans.base import day, query, r, round_all, sql_day, table

LINEITEM = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n",
    "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d",
}
KINDS = {"n": "NUMERIC", "t": "TEXT", "d": "DATETIME"}


def _profile_sql(c: str, kind: str) -> str:
    x = f"{c}::double" if kind == "n" else "null::double"
    return (f"select '{c}' as column_name, '{KINDS[kind]}' as type_class, count(*) as n_rows, count(distinct {c}) as n_distinct, "
            f"count({c}) < count(*) as has_nulls, {r(f'min({x})', 4)} as min_value, {r(f'max({x})', 4)} as max_value, "
            f"{r(f'avg({x})', 4)} as mean_value from lineitem")


@query("table_profile", " union all ".join(_profile_sql(c, k) for c, k in LINEITEM.items()))
def table_profile(spark, sf):
    return round_all(ops.profile(table(spark, sf, "lineitem")), 4)


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_numeric", " union all ".join(f"""
    select '{c}' as column_name, count({c}) as n, {r(f'avg({c})', 4)} as mean_value, {r(f'stddev_samp({c})', 4)} as std_value,
    {r(f'min({c})', 4)} as min_value, {r(f'quantile_cont({c}, 0.25)', 4)} as q25, {r(f'quantile_cont({c}, 0.5)', 4)} as q50,
    {r(f'quantile_cont({c}, 0.75)', 4)} as q75, {r(f'max({c})', 4)} as max_value from lineitem""" for c in NUMBERS))
def describe_numeric(spark, sf):
    return round_all(ops.describe(table(spark, sf, "lineitem"), NUMBERS), 4)


FEATURES = ("p_brand", "p_type", "size")


@query("feature_stats", """
    with src as (select p_brand, p_type, case when p_size > 40 then null else p_size end as size from part),
    cells as (""" + " union all ".join(f"select '{c}' as column_name, {c}::varchar as value from src" for c in FEATURES) + f"""),
    counts as (select column_name, value, count(*) as n from cells group by all),
    totals as (select column_name, count(value) as n_distinct, sum(n)::double as n_rows,
               sum(case when value is null then n else 0 end)::double as n_null from counts group by 1),
    best as (select column_name, value, n, row_number() over (partition by column_name order by n desc, value) as rk
             from counts where value is not null qualify rk <= 3)
    select t.column_name, t.n_distinct, {r('n_null / n_rows', 6)} as null_percentage, {r('n_null / n_rows * 100', 6)} as missing_pct,
           {r('n_distinct / n_rows', 6)} as unique_ratio, string_agg(value || '=' || n, ', ' order by rk) as top_values
    from totals t join best b using (column_name) group by all""")
def feature_stats(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("size"))
    return round_all(ops.feature_stats(part, FEATURES), 6)


@query("corr_matrix", " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})', 6)} as r from lineitem" for a, b in combinations(NUMBERS, 2)))
def corr_matrix(spark, sf):
    return round_all(ops.corr_matrix(table(spark, sf, "lineitem"), NUMBERS), 6)


PART = {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True}


@query("feature_eligibility", " union all ".join(f"""
    select '{c}' as column_name, {str(n).lower()} as is_numeric, count(distinct {c}) as unique_count,
    {str(n).lower()} or count(distinct {c}) <= 10 as can_use from part""" for c, n in PART.items()))
def feature_eligibility(spark, sf):
    return ops.feature_eligibility(table(spark, sf, "part"))


@query("interaction_density", f"""
    with i as (select o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey),
    c as (select count(distinct o_custkey) as n_users, count(distinct l_partkey) as n_items, count(*) as n_rows from i)
    select n_users, n_items, n_rows, {r('n_rows::double / (n_users::double * n_items)', 6)} as density,
           {r('n_rows::double / n_items', 6)} as rows_per_item from c""")
def interaction_density(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return round_all(ops.interaction_density(rows, "o_custkey", "l_partkey"), 6)


@query("value_distribution", "select o_orderpriority as value, count(*) as n from orders group by 1")
def value_distribution(spark, sf):
    return ops.value_distribution(table(spark, sf, "orders"), "o_orderpriority")


@query("row_reduction", f"""
    with a as (select (select count(*) from lineitem) as rows_before, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as rows_after)
    select rows_before, rows_after, {r('(rows_before - rows_after) * 100.0::double / rows_before', 6)} as reduction_pct from a""")
def row_reduction(spark, sf):
    lines = table(spark, sf, "lineitem")
    return round_all(ops.row_reduction(lines, lines.select("l_orderkey", "l_linenumber").distinct()), 6)


@query("preview_topn", "select * from orders order by o_totalprice desc, o_orderkey limit 10".replace(
    "*", f"o_orderkey, o_custkey, o_totalprice, {sql_day('o_orderdate')} as o_orderdate"))
def preview_topn(spark, sf):
    top = ops.preview(table(spark, sf, "orders"), [F.col("o_totalprice").desc(), "o_orderkey"], 10)
    return top.select("o_orderkey", "o_custkey", "o_totalprice", day("o_orderdate").alias("o_orderdate"))


@query("standardise_types", """
    select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, strftime(o_orderdate, '%Y-%m') as o_orderdate,
           try_cast(split_part(o_orderpriority, '-', 1) as int) as priority, try_cast(o_orderstatus as int) as status
    from orders""")
def standardise_types(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority"),
        F.col("o_orderstatus").alias("status"))
    return ops.standardise_types(raw, ["o_orderkey", "o_custkey"], ["o_orderdate"], {"priority": "int", "status": "int"})


@query("conversion_losses", """
    select 'priority' as column_name, 0::bigint as n_lost from orders having count(*) > 0
    union all select 'status' as column_name, count(*) as n_lost from orders""")
def conversion_losses(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority"), F.col("o_orderstatus").alias("status"))
    typed = ops.standardise_types(raw, casts={"priority": "int", "status": "int"})
    return ops.conversion_losses(raw, typed, ["priority", "status"])


@query("coerce_numeric", """
    select p_partkey, try_cast(case when p_type = 'PROMO' then 'n/a' else p_size::varchar end as double) as size,
           try_cast(replace(p_brand, 'Brand#', '') as double) as brand from part""")
def coerce_numeric(spark, sf):
    text = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"))
    return ops.coerce_numeric(text, ["size", "brand"])


@query("parse_datetime", """
    select event_id, case when event_type = 'error' then null else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M') end as at from events""")
def parse_datetime(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"))
    return ops.parse_datetime(text, "at").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm"))


@query("validate_tables", """
    with o as (select *, case when o_orderstatus = 'P' then null else o_custkey end as cust from orders)
    select 'orders' as table_name, 'non_empty' as rule, (count(*) = 0)::bigint as violations from o
    union all select 'orders', 'unique_columns', 0::bigint from o having count(*) > 0
    union all select 'orders', 'role:id', 0::bigint from o having count(*) > 0
    union all select 'orders', 'role:target', 1::bigint from o having count(*) > 0
    union all select 'orders', 'key_not_null', count(*) filter (cust is null) from o
    union all select 'events', 'non_empty', (count(*) = 0)::bigint from events
    union all select 'events', 'unique_columns', 0::bigint from events having count(*) > 0
    union all select 'events', 'role:id', 0::bigint from events having count(*) > 0
    union all select 'events', 'key_not_null', count(*) filter (user_id is null or ts is null) from events""")
def validate_tables(spark, sf):
    orders = table(spark, sf, "orders").withColumn("cust", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return ops.validate_tables(
        {"orders": orders, "events": table(spark, sf, "events")},
        {"orders": {"id": "cust", "target": "churned"}, "events": {"id": "user_id"}},
        {"orders": ["cust"], "events": ["user_id", "ts"]},
    )


# --- scalar functions ---


@query("fn_string", """
    select p_partkey, lower(p_brand) as low, replace(p_type, 'O', '0') as swapped, split_part(p_name, ' ', 1) as first_word,
           trim('  ' || p_name || ' ') as trimmed, p_type || '_' || p_brand as joined, printf('%.2f', p_retailprice) as price,
           upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) as title
    from part""")
def fn_string(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lower("p_brand").alias("low"), F.regexp_replace("p_type", "O", "0").alias("swapped"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.concat_ws("_", "p_type", "p_brand").alias("joined"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        title_of(F.regexp_replace("p_name", " ", "_")).alias("title"))


@query("fn_date", f"""
    select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, {sql_day('o_orderdate')} as day,
           {sql_day("last_day(o_orderdate)")} as month_end,
           {sql_day("last_day(date_trunc('month', o_orderdate) + interval 1 month)")} as next_end,
           array_to_string(list_transform(range(3), lambda i: {sql_day("last_day(date_trunc('month', o_orderdate) + to_months(i::int))")}), ',') as ends
    from orders""")
def fn_date(spark, sf):
    d = F.col("o_orderdate").cast("date")
    ends = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.date_format(F.last_day(F.add_months(F.trunc(d, "MM"), i)), "yyyy-MM-dd"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), day("o_orderdate").alias("day"),
        day(F.last_day(d)).alias("month_end"), day(F.last_day(F.add_months(F.trunc(d, "MM"), 1))).alias("next_end"),
        F.array_join(ends, ",").alias("ends"))


@query("fn_math", f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('ln(l_extendedprice)', 6)} as log_price,
           {r('case when l_tax = 0 then null else l_discount / l_tax end', 6)} as ratio, least(l_quantity / 25, 1.0::double) as capped,
           floor(sqrt(l_quantity / 2))::bigint as bound, {r('l_extendedprice * (1 - l_discount)', 2)} as net from lineitem""")
def fn_math(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.log("l_extendedprice"), 6).alias("log_price"),
        rounded(F.try_divide("l_discount", "l_tax"), 6).alias("ratio"), F.least(F.col("l_quantity") / 25, F.lit(1.0)).alias("capped"),
        F.floor(F.sqrt(F.col("l_quantity") / 2)).alias("bound"),
        rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("net"))


@query("fn_conditional", """
    select c_custkey, (c_acctbal >= 5000)::int as rich, case when c_acctbal < 0 then null else c_acctbal end is null as in_debt,
           coalesce(case when c_acctbal < 0 then null else c_acctbal end, 0.0::double) as filled, try_cast(c_mktsegment as double) as bad from customer""")
def fn_conditional(spark, sf):
    kept = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") >= 5000).cast("int").alias("rich"), kept.isNull().alias("in_debt"),
        F.coalesce(kept, F.lit(0.0)).alias("filled"), to_number(F.col("c_mktsegment")).alias("bad"))


@query("fn_array", f"""
    select vec_id, {r('sqrt(list_dot_product(embedding::double[], embedding::double[]))', 5)} as length,
           {r('list_dot_product(embedding::double[], list_transform(embedding, lambda x: 1.0)::double[])', 5)} as total,
           len(list_filter(embedding, lambda x: x > 0))::int as n_positive from embeddings""")
def fn_array(spark, sf):
    ones = F.transform("embedding", lambda x: F.lit(1.0))
    return table(spark, sf, "embeddings").select(
        "vec_id", rounded(norm(F.col("embedding")), 5).alias("length"), rounded(dot(F.col("embedding"), ones), 5).alias("total"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"))
