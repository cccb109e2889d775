"""Feature preparation and splits on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import rounded
from tableloom.operators import features as ops, splits
from tableloom.plans.base import day, query, r, round_all, sql_day, table

# Customers with gaps: no balance when in debt, no segment in nation 3.
_GAPS_SQL = """g as (select c_custkey, case when c_acctbal >= 0 then c_acctbal end as balance,
    case when c_nationkey <> 3 then c_mktsegment end as segment from customer)"""


def _gaps(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"))


def _impute_sql(stat: str, digits: int) -> str:
    return f"""with {_GAPS_SQL}, m as (select segment, count(*) as n from g where segment is not null group by 1 order by n desc, segment limit 1)
    select c_custkey, {r(f'coalesce(balance, (select {stat}(balance) from g))', digits)} as balance, coalesce(segment, (select segment from m)) as segment from g"""


@query("impute_median_mode", _impute_sql("median", 4))
def impute_median_mode(spark, sf):
    return round_all(ops.impute(_gaps(spark, sf)), 4)


@query("impute_mean_mode", _impute_sql("avg", 4))
def impute_mean_mode(spark, sf):
    return round_all(ops.impute(_gaps(spark, sf), numeric="mean"), 4)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _one_hot_sql(values) -> str:
    cols = ", ".join(f"case when segment = '{v}' then 1 else 0 end as segment_{v}" for v in values)
    return f"with {_GAPS_SQL} select c_custkey, {cols} from g"


@query("onehot_drop_first", _one_hot_sql(SEGMENTS[1:]))
def onehot_drop_first(spark, sf):
    return ops.one_hot(_gaps(spark, sf).drop("balance"), ["segment"], drop_first=True)


@query("onehot_full", _one_hot_sql(SEGMENTS))
def onehot_full(spark, sf):
    return ops.one_hot(_gaps(spark, sf).drop("balance"), ["segment"])


@query("scale_standard", f"""
    select p_partkey, {r('(p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part)', 6)} as p_size,
           {r('(p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part)', 6)} as p_retailprice,
           0.0::double as same from part""")
def scale_standard(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("same"))
    return round_all(ops.standard_scale(rows, ["p_size", "p_retailprice", "same"]), 6, "p_size", "p_retailprice")


@query("scale_guarded", f"""
    select p_partkey, {r('(p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part)', 6)} as p_size, 7.0::double as same from part""")
def scale_guarded(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.lit(7).alias("same"))
    return round_all(ops.standard_scale(rows, ["p_size", "same"], guard=True), 6, "p_size")


@query("weighted_features", f"select p_partkey, {r('p_size * 0.25::double', 4)} as p_size, {r('p_retailprice * 0.75::double', 4)} as p_retailprice from part")
def weighted_features(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return round_all(ops.weighted_features(rows, ops.normalise_weights({"p_size": 1, "p_retailprice": 3, "p_partkey": 0})), 4)


@query("suggest_weights", f"""
    with {_GAPS_SQL}, s as (
      select 'balance' as column_name, count(balance)::double / count(*) * count(distinct balance) / (count(distinct balance) + 1) as score from g
      union all select 'segment', count(segment)::double / count(*) * count(distinct segment) / (count(distinct segment) + 1) from g)
    select column_name, {r('score / (select sum(score) from s)', 6)} as weight,
           case when score >= 0.9 then 'high' when score >= 0.5 then 'medium' else 'low' end as importance from s""")
def suggest_weights(spark, sf):
    return round_all(ops.suggest_weights(_gaps(spark, sf), exclude=["c_custkey"]), 6)


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("encode_by_cardinality", "select p_partkey, " + r("count(*) over (partition by p_brand) * 1.0::double / (select count(*) from part)", 6)
       + " as p_brand, " + ", ".join(f"(p_type = '{t}')::int as p_type_{t}" for t in TYPES) + " from part")
def encode_by_cardinality(spark, sf):
    encoded, _ = ops.encode_by_cardinality(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])
    return round_all(encoded, 6, "p_brand")


@query("encode_report", """
    select 'p_brand' as column_name, case when count(distinct p_brand) <= 10 then 'one_hot' else 'frequency' end as encoding_type, count(distinct p_brand) as cardinality from part
    union all select 'p_type', case when count(distinct p_type) <= 10 then 'one_hot' else 'frequency' end, count(distinct p_type) from part""")
def encode_report(spark, sf):
    return ops.encode_by_cardinality(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])[1]


_LEAK_SQL = """src as (select l_extendedprice as target, l_extendedprice as copied, l_extendedprice * 1.1 + l_tax as derived, l_quantity, l_discount,
    l_extendedprice::varchar as spelled, (l_extendedprice > 40000)::int as flag, 1 as fixed, (l_shipdate::date - date '1970-01-01')::double as shipped, l_returnflag, case when l_extendedprice > 50000 then 'high' else 'low' end as band from lineitem)"""


def _eta_sql(c: str) -> str:
    return f"""select '{c}' as column_name, coalesce(greatest(0, 1 - (1 - (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n))) * (sum(n) - 1) / (sum(n) - count(*))), 0) as association,
        sum(copies) / (select count(*) from src) as copy_rate
        from (select {c}, count(*)::double as n, sum(target) as s, sum(target * target) as q, count(*) filter (try_cast({c} as double) = target) as copies from src group by 1)"""


@query("leakage_scan", f"""
    with {_LEAK_SQL}, f as (""" + " union all ".join(
    [f"select '{c}' as column_name, abs(corr({c}, target)) as association, count(*) filter ({c} = target)::double / count(*) as copy_rate from src"
     for c in ("copied", "derived", "l_quantity", "l_discount", "flag", "shipped")]
    + ["select 'fixed', null, count(*) filter (fixed = target)::double / count(*) from src", _eta_sql("l_returnflag"), _eta_sql("band"), _eta_sql("spelled")]) + f""")
    select column_name, {r('association', 6)} as association, {r('copy_rate', 6)} as copy_rate,
      case when greatest(association, copy_rate) >= 0.95 then 'severe' when greatest(association, copy_rate) >= 0.7 then 'review' else 'ok' end as verdict,
      case when copy_rate >= 0.7 then 'copies the target' when association >= 0.7 then 'tells the target almost exactly' else '' end as reason from f""")
def leakage_scan(spark, sf):
    price = F.col("l_extendedprice")
    rows = table(spark, sf, "lineitem").select(
        price.alias("target"), price.alias("copied"), (price * 1.1 + F.col("l_tax")).alias("derived"), "l_quantity", "l_discount", "l_returnflag",
        price.cast("string").alias("spelled"), (price > 40000).alias("flag"), F.lit(1).alias("fixed"), F.col("l_shipdate").cast("date").alias("shipped"),
        F.when(price > 50000, "high").otherwise("low").alias("band"))
    return round_all(ops.leakage_scan(rows, "target", review=0.7), 6)


@query("drop_features", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus from lineitem")
def drop_features(spark, sf):
    return ops.drop_features(table(spark, sf, "lineitem"), ["l_tax", "l_discount", "l_shipdate", "l_orderkey"], mapped=["l_orderkey"])


_BUCKET = "(('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100)"
_RANDOM_SQL = f"case when {_BUCKET} < 70 then 'train' when {_BUCKET} < 90 then 'valid' else 'infer' end"


@query("class_check", f"""
    select split, count(distinct o_orderstatus) as n_classes, count(distinct o_orderstatus) >= 2 as ok
    from (select *, {_RANDOM_SQL} as split from orders) where split <> 'infer' group by 1""")
def class_check(spark, sf):
    return ops.class_check(splits.split(table(spark, sf, "orders"), "o_orderkey", "random"), "split", "o_orderstatus")


@query("class_weights", f"""
    select o_orderstatus, count(*) as n, {r('(select count(*) from orders)::double / ((select count(distinct o_orderstatus) from orders) * count(*))', 6)} as weight
    from orders group by 1""")
def class_weights(spark, sf):
    return round_all(ops.class_weights(table(spark, sf, "orders"), "o_orderstatus"), 6)


@query("clean_table", f"""
    with raw as (select p_partkey, case when p_type = 'PROMO' then 'N/A' else ' ' || p_brand || ' ' end as brand,
                 case when p_size > 45 then 'NA' else p_size::varchar end as size, case when p_type = 'SMALL' then null else p_retailprice end as price from part),
    c as (select p_partkey, nullif(trim(brand), 'N/A') as brand, try_cast(nullif(size, 'NA') as double) as size, price from raw),
    k as (select * from c where price is not null),
    m as (select brand, count(*) as n from k where brand is not null group by 1 order by n desc, brand limit 1)
    select p_partkey, coalesce(brand, (select brand from m)) as brand, {r('coalesce(size, (select median(size) from k))', 4)} as size, price from k""")
def clean_table(spark, sf):
    raw = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", "N/A").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("brand"),
        F.when(F.col("p_size") > 45, "NA").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(F.col("p_type") != "SMALL", F.col("p_retailprice")).alias("price"))
    out = ops.clean_table(raw, {
        "brand": {"trim": True, "nullify": ["N/A"], "missing": "mode"}, "size": {"nullify": ["NA"], "type": "double", "missing": "median"},
        "price": {"missing": "drop"},
    })
    return round_all(out, 4, "size")


# --- splits ---

_AGO = "((select max(year(o_orderdate) * 12 + month(o_orderdate)) from orders) - (year(o_orderdate) * 12 + month(o_orderdate)))"


def _month_sql(valid: int, infer: int) -> str:
    return f"select o_orderkey, case when {_AGO} < {infer} then 'infer' when {_AGO} < {infer + valid} then 'valid' else 'train' end as split from orders"


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("split_time", _month_sql(3, 1))
def split_time(spark, sf):
    return splits.split(_orders(spark, sf), "o_orderkey", "time", date="o_orderdate").select("o_orderkey", "split")


@query("split_last_n", _month_sql(3, 6))
def split_last_n(spark, sf):
    return splits.split(_orders(spark, sf), "o_orderkey", "last_n", date="o_orderdate", infer_months=6).select("o_orderkey", "split")


@query("split_missing_target", f"""
    select o_orderkey, case when o_orderstatus = 'P' then 'infer' when {_BUCKET} < 80 then 'train' else 'valid' end as split from orders""")
def split_missing_target(spark, sf):
    rows = _orders(spark, sf).withColumn("target", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return splits.split(rows, "o_orderkey", "missing_target", target="target").select("o_orderkey", "split")


@query("split_random", f"select o_orderkey, {_RANDOM_SQL} as split from orders")
def split_random(spark, sf):
    return splits.split(_orders(spark, sf), "o_orderkey", "random").select("o_orderkey", "split")


@query("split_chrono", """
    with d as (select o_orderkey, (o_orderdate::date - date '1970-01-01')::bigint as day from orders),
    c as (select quantile_cont(day, 0.7) as a, quantile_cont(day, 0.9) as b from d)
    select o_orderkey, case when day > (select b from c) then 'infer' when day > (select a from c) then 'valid' else 'train' end as split from d""")
def split_chrono(spark, sf):
    return splits.split(_orders(spark, sf), "o_orderkey", "chrono", date="o_orderdate").select("o_orderkey", "split")


@query("split_cutoff", """
    select o_orderkey, case when o_orderdate >= date '2000-01-01' then 'infer' when o_orderdate >= date '1999-10-01' then 'valid' else 'train' end as split from orders""")
def split_cutoff(spark, sf):
    return splits.split(_orders(spark, sf), "o_orderkey", "cutoff", date="o_orderdate", cutoff="2000-01-01").select("o_orderkey", "split")


@query("split_summary", f"""
    select split, {sql_day('min(o_orderdate)')} as start, {sql_day('max(o_orderdate)')} as "end", count(*) as n_rows
    from (select o_orderkey, o_orderdate, case when {_AGO} < 1 then 'infer' when {_AGO} < 4 then 'valid' else 'train' end as split from orders) group by 1""")
def split_summary(spark, sf):
    out = splits.split_summary(splits.split(_orders(spark, sf), "o_orderkey", "time", date="o_orderdate"), "o_orderdate")
    return out.withColumns({"start": day("start"), "end": day("end")})
