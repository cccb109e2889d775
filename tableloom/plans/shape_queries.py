"""Roles, targets and aggregation on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import money_sum, rounded
from tableloom.operators import aggregate as agg, joins, roles, supervised, target
from tableloom.plans.base import day, money, query, r, round_all, sql_cells, sql_columns, sql_day, table, tables

# --- roles ---

# A mapping per user, read off the events: a role is mapped when the user has events above the limit.
EVENT_ROLES = {"click": "id", "view": "product_id", "purchase": "timestamp", "signup": "revenue", "error": "target"}
_ROLE_SQL = "case event_type " + " ".join(f"when '{e}' then '{x}'" for e, x in EVENT_ROLES.items()) + " end"
_MAPPING_SQL = f"""
    mapping as (select 'user_' || user_id as table_name, user_id as seq, {_ROLE_SQL} as role,
                case when max(value) > 120 then 'col_' || count(*) end as column_name from events group by user_id, event_type)"""


def _event_mapping(spark, sf) -> DataFrame:
    role = F.create_map(*[F.lit(x) for pair in EVENT_ROLES.items() for x in pair])[F.col("event_type")]
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    ).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("table_name"), F.col("user_id").alias("seq"),
        role.alias("role"), F.when(F.col("top") > 120, F.concat(F.lit("col_"), F.col("n").cast("string"))).alias("column_name"))


_ROLE_CASES = (("orders", "classification"), ("lineitem", "recommendation"), ("events", "recommendation"))


def _roles_sql() -> str:
    """Scores of all roles and columns; then every way to give roles columns, of which the best sum is kept."""
    named, needed = [], []
    for t, problem in _ROLE_CASES:
        needs = roles.requirements(problem, final=True)
        for role in roles.ROLE_NAMES:
            if role in needs["mandatory"] + needs["optional"] or role in ("target", "id"):
                needed.append(f"('{t}', '{problem}', '{role}', {str(role in needs['mandatory']).lower()})")
    for role, names in roles.ROLE_NAMES.items():
        named += [f"('{role}', '{n}', '{k}')" for n in names for k in roles.ROLE_TYPES[role]]
    tables_ = [t for t, _ in _ROLE_CASES]
    counts = " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in tables_)
    return f"""with recursive
    need(table_name, problem, role, mandatory) as (values {', '.join(needed)}),
    known(role, name, kind) as (values {', '.join(named)}),
    size as ({counts}),
    facts as (select table_name, column_name, count(*) as present, count(distinct value) as n_distinct from {sql_cells(*tables_)} group by 1, 2),
    cols as (select table_name, column_name, kind, n_distinct, n_rows, present < n_rows as has_nulls,
        case when regexp_matches(lower(column_name), '^[a-z]{{1,2}}_.{{3,}}') then regexp_replace(lower(column_name), '^[a-z]{{1,2}}_', '') else lower(column_name) end as plain
      from {sql_columns(*tables_)} join facts using (table_name, column_name) join size using (table_name)),
    close as (select c.table_name, problem, c.column_name, need.role, mandatory, max(1 - levenshtein(plain, name) / greatest(length(plain), length(name))::double) as closeness,
        any_value(n_distinct / n_rows::double) as share, any_value(has_nulls) as has_nulls
      from cols c join need on need.table_name = c.table_name join known on known.role = need.role and known.kind = c.kind group by all),
    scored as (select *, 0.6::double * closeness + 0.3::double + 0.1::double * case when role in ('id', 'product_id') then least(share * 10, 1.0::double) else 0.5::double end
        - case when has_nulls and mandatory then 0.2::double else 0.0::double end as score from close),
    fit as (select *, score - 1e-9 * dense_rank() over (partition by table_name order by column_name) as worth from scored where score >= 0.6),
    nth as (select table_name, problem, role, row_number() over (partition by table_name order by role) as k from (select distinct table_name, problem, role from fit)),
    way(table_name, k, used, picks, total) as (
      select distinct table_name, 0::bigint, []::varchar[], []::varchar[], 0.0::double from fit
      union all
      select w.table_name, w.k + 1, case when f.column_name is null then used else list_append(used, f.column_name) end,
        case when f.column_name is null then picks else list_append(picks, f.role || '=' || f.column_name) end, total + coalesce(f.worth, 0)
      from way w join nth n on n.table_name = w.table_name and n.k = w.k + 1
        join (select table_name, role, column_name, worth from fit union all select table_name, role, null, null from nth) f
          on f.table_name = n.table_name and f.role = n.role and (f.column_name is null or not list_contains(w.used, f.column_name))),
    best as (select table_name, arg_max(picks, (k, total)) as picks from way group by 1)
    select table_name, problem, role, column_name, mandatory, round(score, 4) as score from fit join best using (table_name) where list_contains(picks, role || '=' || column_name)"""


@query("suggest_roles", _roles_sql())
def suggest_roles(spark, sf):
    parts = [
        roles.suggest_roles(table(spark, sf, t), p).select(F.lit(t).alias("table_name"), F.lit(p).alias("problem"), "*")
        for t, p in _ROLE_CASES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("mapping_missing", f"""
    with {_MAPPING_SQL}, need as (select t.table_name, n.role from (select distinct table_name from mapping) t, (values ('id'), ('timestamp')) n(role))
    select table_name, role from need where not exists
      (select 1 from mapping m where m.table_name = need.table_name and m.role = need.role and m.column_name is not null)""")
def mapping_missing(spark, sf):
    return roles.missing_roles(_event_mapping(spark, sf), "classification", time_series=True)


@query("mapping_merge", f"""
    with {_MAPPING_SQL}
    select role, column_name, table_name from mapping where column_name is not null
    qualify row_number() over (partition by role order by table_name = 'user_7' desc, seq desc) = 1""")
def mapping_merge(spark, sf):
    return roles.merge_mappings(_event_mapping(spark, sf), important="user_7")


ORDER_ROLES = {"id": "o_custkey", "timestamp": "o_orderdate", "revenue": "o_totalprice", "target": None}


@query("apply_roles", f"select o_custkey as id, {sql_day('o_orderdate')} as timestamp, o_totalprice as revenue from orders")
def apply_roles(spark, sf):
    return roles.apply_roles(table(spark, sf, "orders"), ORDER_ROLES).withColumn("timestamp", day("timestamp"))


_WORDS_SQL = ", ".join(f"('{kind}', {i}, '{word}')" for i, (kind, words) in enumerate(roles.TABLE_WORDS.items()) for word in words)


@query("categorise_tables", f"""
    with w(kind, place, word) as (values {_WORDS_SQL}),
    seen as (select distinct table_name, column_name from {sql_cells('orders', 'lineitem', 'events', 'conversations')}),
    words as (select table_name, unnest(string_split(lower(column_name), '_')) as word from seen
              union all select t, unnest(string_split_regex(lower(t), '[_.-]')) from (values ('orders'), ('lineitem'), ('events'), ('conversations')) x(t)),
    hits as (select table_name, kind, any_value(place) as place, count(*) as hits from words join w using (word) group by 1, 2)
    select t as table_name, coalesce(arg_max(kind, (hits, -place)), 'unknown') as category, coalesce(max(hits), 0) as hits
    from (values ('orders'), ('lineitem'), ('events'), ('conversations')) x(t) left join hits on table_name = t group by 1""")
def categorise_tables(spark, sf):
    return roles.categorise_tables(tables(spark, sf, "orders", "lineitem", "events", "conversations"))


# --- targets ---


@query("target_expr", "select *, case when c_acctbal > 6000 then 1 else 0 end as target from customer")
def target_expr(spark, sf):
    return target.add_target(table(spark, sf, "customer"), "case when c_acctbal > 6000 then 1 else 0 end")


@query("target_median", """
    select o_orderkey, o_totalprice, (o_totalprice > (select median(o_totalprice) from orders))::int as target from orders""")
def target_median(spark, sf):
    return target.target_median(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("target_combo", """
    select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 5000 then 2
           when c_mktsegment in ('BUILDING', 'MACHINERY') or c_acctbal > 5000 then 1 else 0 end as target from customer""")
def target_combo(spark, sf):
    made = target.target_combo(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], "c_acctbal", 5000)
    return made.select("c_custkey", "target")


@query("target_bins", """
    select o_orderkey, case when o_totalprice <= (select quantile_cont(o_totalprice, 0.25) from orders) then 'low'
           when o_totalprice <= (select quantile_cont(o_totalprice, 0.75) from orders) then 'medium' else 'high' end as target from orders""")
def target_bins(spark, sf):
    return target.target_bins(table(spark, sf, "orders"), "o_totalprice", (0.25, 0.75)).select("o_orderkey", "target")


@query("target_ratio", f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('case when l_tax = 0 then null else l_extendedprice / l_tax end', 4)} as target from lineitem""")
def target_ratio(spark, sf):
    made = target.target_ratio(table(spark, sf, "lineitem"), "l_extendedprice", "l_tax")
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.col("target"), 4).alias("target"))


@query("target_log", f"select c_custkey, {r('case when c_acctbal > 0 then ln(c_acctbal) end', 6)} as target from customer")
def target_log(spark, sf):
    return target.target_log(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", rounded(F.col("target"), 6).alias("target"))


@query("target_wsum", f"""
    select p_partkey, {r('p_size * 0.5::double + p_retailprice * 0.3::double + p_partkey * 0.2::double', 4)} as target from part""")
def target_wsum(spark, sf):
    made = target.target_wsum(table(spark, sf, "part"), {"p_size": 0.5, "p_retailprice": 0.3, "p_partkey": 0.2})
    return made.select("p_partkey", rounded(F.col("target"), 4).alias("target"))


# --- aggregation ---


@query("needs_aggregation", """
    select 'lineitem' as table_name, max(n) > 1 as needed from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)
    union all select 'customer', max(n) > 1 from (select count(*) as n from customer group by c_custkey)""")
def needs_aggregation(spark, sf):
    lines = agg.needs_aggregation(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    people = agg.needs_aggregation(table(spark, sf, "customer"), ["c_custkey"])
    return lines.select(F.lit("lineitem").alias("table_name"), "needed").unionByName(
        people.select(F.lit("customer").alias("table_name"), "needed"))


@query("agg_min_max", """
    select o_custkey, min(o_totalprice) as o_totalprice_min, max(o_totalprice) as o_totalprice_max,
           strftime(max(o_orderdate), '%Y-%m-%d') as o_orderdate_max from orders group by 1""")
def agg_min_max(spark, sf):
    out = agg.aggregate(table(spark, sf, "orders"), ["o_custkey"], {"o_totalprice": ["Min", "Max"], "o_orderdate": ["Max"]})
    return out.withColumn("o_orderdate_max", day("o_orderdate_max"))


# Line quantities that are null for returned lines, so that some groups hold no value at all.
_KEPT_SQL = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, case when l_returnflag <> 'R' then l_quantity end as quantity, l_extendedprice from lineitem)"


def _kept(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"), "l_extendedprice")


@query("agg_sum", f"select l_orderkey, coalesce(sum(quantity), 0::double) as quantity_sum from {_KEPT_SQL} group by 1")
def agg_sum(spark, sf):
    return agg.aggregate(_kept(spark, sf), ["l_orderkey"], {"quantity": ["Sum"]})


@query("agg_mean", f"select l_orderkey, {r('avg(quantity)', 4)} as quantity_mean from {_KEPT_SQL} group by 1")
def agg_mean(spark, sf):
    return round_all(agg.aggregate(_kept(spark, sf), ["l_orderkey"], {"quantity": ["Mean"]}), 4)


@query("agg_median", f"select l_suppkey, median(quantity) as quantity_median, {r('median(l_extendedprice)', 2)} as l_extendedprice_median from {_KEPT_SQL} group by 1")
def agg_median(spark, sf):
    out = agg.aggregate(_kept(spark, sf), ["l_suppkey"], {"quantity": ["Median"], "l_extendedprice": ["Median"]})
    return round_all(out, 2, "l_extendedprice_median")


def _mode_sql(src: str, key: str, col: str) -> str:
    return f"""(select {key}, {col} as m from (select {key}, {col}, count(*) as n from {src} where {col} is not null group by all)
               qualify row_number() over (partition by {key} order by n desc, {col}) = 1)"""


@query("agg_mode", f"""
    select k.l_suppkey, q.m as quantity_mode, f.m as l_returnflag_mode from (select distinct l_suppkey from lineitem) k
    left join {_mode_sql(_KEPT_SQL, 'l_suppkey', 'quantity')} q using (l_suppkey)
    left join {_mode_sql('lineitem', 'l_suppkey', 'l_returnflag')} f using (l_suppkey)""")
def agg_mode(spark, sf):
    return agg.aggregate(_kept(spark, sf), ["l_suppkey"], {"quantity": ["Mode"], "l_returnflag": ["Mode"]})


@query("agg_unique", "select o_custkey, count(distinct o_orderpriority) as o_orderpriority_unique_count, count(distinct o_orderstatus) as o_orderstatus_unique_count from orders group by 1")
def agg_unique(spark, sf):
    return agg.aggregate(table(spark, sf, "orders"), ["o_custkey"], {"o_orderpriority": ["Unique Count"], "o_orderstatus": ["Unique Count"]})


LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("agg_last", f"""
    select l_orderkey, quantity as quantity_last_value from {_KEPT_SQL}
    qualify row_number() over (partition by l_orderkey order by {', '.join(c + ' desc' for c in LINE_ORDER)}) = 1""")
def agg_last(spark, sf):
    return agg.aggregate(_kept(spark, sf), ["l_orderkey"], {"quantity": ["Last Value"]}, LINE_ORDER)


_SOME_KEYS = "(select *, case when l_linestatus = 'F' and l_returnflag = 'R' then null else l_orderkey end as key from lineitem)"


@query("agg_multi", f"""
    select b.key, l_quantity_min, l_quantity_max, l_quantity_sum, l_quantity_mean, l_extendedprice_median, l_returnflag_unique_count,
           m.m as l_returnflag_mode, f.m as l_linestatus_last_value, l_shipdate_max
    from (select key, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, sum(l_quantity) as l_quantity_sum,
          {r('avg(l_quantity)', 4)} as l_quantity_mean, {r('median(l_extendedprice)', 2)} as l_extendedprice_median,
          count(distinct l_returnflag) as l_returnflag_unique_count, {sql_day('max(l_shipdate)')} as l_shipdate_max
          from {_SOME_KEYS} where key is not null group by 1) b
    join {_mode_sql(_SOME_KEYS, 'key', 'l_returnflag')} m on m.key = b.key
    join (select key, l_linestatus as m from {_SOME_KEYS} qualify row_number() over (partition by key order by {', '.join(c + ' desc' for c in LINE_ORDER)}) = 1) f on f.key = b.key""")
def agg_multi(spark, sf):
    returned = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    lines = table(spark, sf, "lineitem").withColumn("key", F.when(~returned, F.col("l_orderkey")))
    out = agg.aggregate(lines, ["key"], {
        "l_quantity": ["Min", "Max", "Sum", "Mean"], "l_extendedprice": ["Median"], "l_returnflag": ["Unique Count", "Mode"],
        "l_linestatus": ["Last Value"], "l_shipdate": ["Max"], "l_tax": [],
    }, LINE_ORDER)
    out = round_all(round_all(out, 4, "l_quantity_mean"), 2, "l_extendedprice_median")
    return out.withColumn("l_shipdate_max", day("l_shipdate_max"))


@query("suggest_aggs", f"""
    with c as (select column_name, kind from {sql_columns('lineitem')} where column_name not in ('l_orderkey', 'l_linenumber')),
    v as (select column_name, value::double as x from {sql_cells('lineitem')} where column_name in (select column_name from c where kind = 'NUMERIC')),
    m as (select column_name, avg(x) as mean, stddev_samp(x) as std, var_pop(x) as var, min(x) as low from v group by 1),
    s as (select column_name, any_value(mean) as mean, any_value(std) as std, any_value(low) as low, avg((x - mean) ** 3) / any_value(var) ** 1.5 as skew from v join m using (column_name) group by 1),
    f as (select column_name, kind, skew, low, abs(std / nullif(mean, 0)) > 0.5 as wide from c left join s using (column_name)),
    rules as (
      select column_name, unnest(['Unique Count', 'Mode', 'Last Value']) as method, unnest(['text: how many different values', 'text: the usual value', 'text: the latest value']) as explanation from f where kind = 'TEXT'
      union all select column_name, case when abs(skew) <= 1 then 'Mean' else 'Median' end, case when abs(skew) <= 1 then 'number, little skew' else 'number, skewed' end from f where kind = 'NUMERIC' and skew is not null
      union all select column_name, unnest(['Min', 'Max']), 'number, wide range' from f where kind = 'NUMERIC' and wide
      union all select column_name, 'Sum', 'number, never negative, adds up' from f where kind = 'NUMERIC' and low >= 0
      union all select column_name, unnest(['Max', 'Min']), unnest(['date: latest', 'date: first']) from f where kind = 'DATETIME'
      union all select column_name, 'Last Value', 'other type: the latest value' from f where kind = 'OTHER')
    select * from rules""")
def suggest_aggs(spark, sf):
    return agg.suggest_aggs(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("series_by_date", f"""
    select {sql_day('o_orderdate')} as o_orderdate, {r(money('o_totalprice'), 2)} as o_totalprice, {r('avg(o_custkey)', 4)} as o_custkey,
           {r('avg(o_orderkey)', 4)} as o_orderkey from orders group by 1""")
def series_by_date(spark, sf):
    out = agg.series_by_date(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    out = round_all(round_all(out, 2, "o_totalprice"), 4, "o_custkey", "o_orderkey")
    return out.withColumn("o_orderdate", day("o_orderdate"))


@query("cluster_stats", f"""
    select c_mktsegment as cluster, count(*) as n, {r('avg(c_acctbal)', 4)} as c_acctbal_mean, {r('stddev_samp(c_acctbal)', 4)} as c_acctbal_std,
           {r('avg(c_nationkey)', 4)} as c_nationkey_mean, {r('stddev_samp(c_nationkey)', 4)} as c_nationkey_std,
           {r('count(*) * 100.0::double / (select count(*) from customer)', 4)} as pct from customer group by 1""")
def cluster_stats(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "cluster")
    return round_all(agg.cluster_stats(rows, "cluster", ["c_acctbal", "c_nationkey"]), 4)


@query("cluster_sizes", "select label, count(*) as n, label <> -1 as is_cluster from embeddings group by 1")
def cluster_sizes(spark, sf):
    from tableloom.operators.cluster import cluster_sizes as sizes
    return sizes(table(spark, sf, "embeddings"), "label")


@query("prediction_stats", f"""
    with p as (select l_discount * 10 as score from lineitem)
    select count(score) as n, {r('avg(score)', 6)} as mean_value, {r('min(score)', 6)} as min_value, {r('max(score)', 6)} as max_value,
           count(*) filter (score >= 0.5) as n_positive, {r('count(*) filter (score >= 0.5) * 100.0::double / count(score)', 6)} as positive_pct from p""")
def prediction_stats(spark, sf):
    scored = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("score"))
    return round_all(agg.prediction_stats(scored, "score", 0.5), 6)


@query("topn_per_entity", """
    select o_custkey, o_orderkey, o_totalprice, rk as rank from
      (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rk from orders) where rk <= 3""")
def topn_per_entity(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.top_n(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


_GUESSES = {"by_quantity": "l_quantity * 2000", "by_discount": "50000 - l_discount * 10000", "constant": "51000 + 0 * l_quantity"}


@query("rank_models", """
    with m as (""" + " union all ".join(
    f"select l_returnflag as segment, '{m}' as model, {r(f'1 - sum((l_extendedprice - ({e})) ** 2) / (var_pop(l_extendedprice) * count(*))', 6)} as r2, "
    f"{r(f'avg(abs(l_extendedprice - ({e})))', 4)} as mae from lineitem group by 1" for m, e in _GUESSES.items()) + """)
    select segment, model, r2, mae, row_number() over (partition by segment order by r2 desc, mae, model)::int as rank,
           row_number() over (partition by segment order by r2 desc, mae, model) = 1 as recommended from m""")
def rank_models(spark, sf):
    lines = table(spark, sf, "lineitem")
    y = F.col("l_extendedprice")
    guesses = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p")) for m, e in _GUESSES.items()])
    pairs = lines.select(F.col("l_returnflag").alias("segment"), "l_extendedprice", F.explode(guesses).alias("g"))
    error = y - F.col("g.p")
    metrics = pairs.groupBy("segment", F.col("g.model").alias("model")).agg(
        rounded(1 - F.sum(error * error) / (F.var_pop(y) * F.count(F.lit(1))), 6).alias("r2"), rounded(F.avg(F.abs(error)), 4).alias("mae"))
    return supervised.rank_models(metrics, "regression", ["segment"])


@query("item_set_ops", """
    with a as (select distinct l_partkey as part from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as part from lineitem where l_tax = 0)
    select coalesce(a.part, b.part) as part, case when a.part is null then 'right_only' when b.part is null then 'left_only' else 'both' end as place
    from a full join b on a.part = b.part""")
def item_set_ops(spark, sf):
    lines = table(spark, sf, "lineitem")
    return joins.item_sets(
        lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")),
        lines.where("l_tax = 0").select(F.col("l_partkey").alias("part")))
