"""Vectors, similarity, recommendation and clustering on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import money_sum, rounded
from tableloom.operators import cluster, features, pairwise, recommend, sparse
from tableloom.plans.base import query, r, round_all, table
from tableloom.session import cut_lineage

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Prices of open low-priority orders are missing here, so that filling has work to do.
_SOURCE = "(select *, case when not (o_orderstatus = 'P' and o_orderpriority = '5-LOW') then o_totalprice end as price from orders)"
USERS_SQL = f"""
    src as (select * from {_SOURCE}),
    filled as (select *, coalesce(price, (select avg(price) from src)) as p from src),
    uv as (select o_custkey as id, avg((p - (select avg(p) from filled)) / (select stddev_pop(p) from filled)) as v0,
           {', '.join(f"avg(case when o_orderpriority = '{p}' then 0.5::double else 0.0::double end) as v{i + 1}" for i, p in enumerate(PRIORITIES))}
           from filled group by 1)"""
FLAGS = ("A", "N", "R")
ITEM_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
ITEMS_SQL = f"""
    lines as (select l_partkey as id, (l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem) as v0,
              (l_discount - (select avg(l_discount) from lineitem)) / (select stddev_pop(l_discount) from lineitem) * 0.5::double as v1,
              {', '.join(f"case when l_returnflag = '{f}' then 1.0::double else 0.0::double end as v{i + 2}" for i, f in enumerate(FLAGS))},
              row_number() over (partition by l_partkey order by {', '.join(ITEM_ORDER)}) as rk from lineitem),
    iv as (select id, v0, v1, v2, v3, v4 from lines where rk = 1)"""


def _sims(src: str, n: int, digits: int = 12) -> str:
    """All ordered pairs with their similarity, the diagonal included; like the operators, without the noise of its last digits."""
    dot = " + ".join(f"a.v{i} * b.v{i}" for i in range(n))
    length = " + ".join(f"v{i} * v{i}" for i in range(n))
    return f"""
    unit as (select *, sqrt({length}) as len from {src}),
    sims as (select a.id as id, b.id as other, case when a.len = 0 or b.len = 0 then 0.0::double else {r(f'({dot}) / (a.len * b.len)', digits)} end as similarity
             from unit a join unit b on true)"""


def user_vectors(spark, sf) -> DataFrame:
    open_low = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.when(~open_low, F.col("o_totalprice")).alias("price"))
    return features.entity_vectors(orders, "o_custkey", ["price", "o_orderpriority"], {"price": 1.0, "o_orderpriority": 0.5})


def item_vectors(spark, sf) -> DataFrame:
    return features.entity_vectors(
        table(spark, sf, "lineitem"), "l_partkey", ["l_quantity", "l_discount", "l_returnflag"],
        {"l_discount": 0.5}, how="first", order_by=ITEM_ORDER)


def owned_items(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    bought = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return recommend.user_items(bought, "o_custkey", "l_partkey")


def _spread(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("id", *[rounded(F.col("vec")[i], 6).alias(f"v{i}") for i in range(n)])


@query("user_vectors", f"with {USERS_SQL} select id, {', '.join(r(f'v{i}', 6) + f' as v{i}' for i in range(6))} from uv")
def q_user_vectors(spark, sf):
    return _spread(user_vectors(spark, sf), 6)


@query("item_vectors", f"with {ITEMS_SQL} select id, {', '.join(r(f'v{i}', 6) + f' as v{i}' for i in range(5))} from iv")
def q_item_vectors(spark, sf):
    return _spread(item_vectors(spark, sf), 5)


@query("user_items", "select distinct o_custkey as \"user\", l_partkey as item from orders join lineitem on o_orderkey = l_orderkey")
def q_user_items(spark, sf):
    return owned_items(spark, sf)


BALANCED = recommend.PRESETS["Balanced"]
_TOP_SQL = """
    top as (select id, other, similarity, row_number() over (partition by id order by similarity desc, other)::int as rank
            from sims where id <> other and similarity >= 0.3 qualify rank <= 5)"""


def embedding_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query("cosine_pairs", f"""
    select id_a, id_b, {r('similarity', 6)} as similarity from (
      select a.vec_id as id_a, b.vec_id as id_b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
      from embeddings a join embeddings b on a.vec_id < b.vec_id) where similarity >= 0.3""")
def cosine_pairs(spark, sf):
    return round_all(pairwise.cosine_pairs(embedding_vectors(spark, sf), 0.3), 6, "similarity")


@query("similar_users", f"with {USERS_SQL}, {_sims('uv', 6)}, {_TOP_SQL} select id, other, {r('similarity', 6)} as similarity, rank from top")
def similar_users(spark, sf):
    return round_all(recommend.similar_entities(user_vectors(spark, sf), BALANCED), 6, "similarity")


@query("similar_items", f"with {ITEMS_SQL}, {_sims('iv', 5)}, {_TOP_SQL} select id, other, {r('similarity', 6)} as similarity, rank from top")
def similar_items(spark, sf):
    return round_all(recommend.similar_entities(item_vectors(spark, sf), BALANCED), 6, "similarity")


@query("similar_by_words", f"""
    with w as (select distinct doc_id as id, unnest(string_split(text, ' ')) as word from documents where text is not null),
    n as (select id, count(*)::double as n from w group by 1),
    sims as (select a.id, b.id as other, {r('count(*) / sqrt(any_value(x.n) * any_value(y.n))', 12)} as similarity
             from w a join w b on a.word = b.word and a.id <> b.id join n x on x.id = a.id join n y on y.id = b.id group by 1, 2),
    top as (select id, other, similarity, row_number() over (partition by id order by similarity desc, other)::int as rank from sims where similarity >= 0.8 qualify rank <= 5)
    select id, other, {r('similarity', 6)} as similarity, rank from top""")
def similar_by_words(spark, sf):
    """Every word is a category, whatever their number: documents with the most words in common."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")).distinct()
    entries, _ = sparse.entity_entries(words, "doc_id", ["word"])
    return round_all(sparse.similar_by_categories(entries, 5, 0.8), 6, "similarity")


@query("user_entries", f"""
    with {USERS_SQL}, cells as (select id, unnest([{', '.join(f'{{index: {i}::bigint, value: v{i}}}' for i in range(6))}]) as x from uv)
    select id, x.index as "index", {r('x.value', 6)} as value from cells where x.value <> 0""")
def user_entries(spark, sf):
    open_low = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.when(~open_low, F.col("o_totalprice")).alias("price"))
    entries, _ = sparse.entity_entries(orders, "o_custkey", ["price", "o_orderpriority"], {"price": 1.0, "o_orderpriority": 0.5})
    return round_all(entries, 6, "value")


@query("similarity_stats", f"""
    with {USERS_SQL}, {_sims('uv', 6)}, n as (select count(*)::double as n from uv), s as (select similarity, {r('similarity', 6)} as step from sims)
    select (select n from n)::bigint as n_entities, {r('avg(similarity)', 5)} as mean_similarity, max(step) as max_similarity,
      min(step) filter (similarity > 0) as min_positive, {r('quantile_cont(step, 0.25) filter (similarity > 0)', 5)} as q25,
      {r('quantile_cont(step, 0.5) filter (similarity > 0)', 5)} as q50, {r('quantile_cont(step, 0.75) filter (similarity > 0)', 5)} as q75,
      {r('count(*) filter (similarity > 0.3) / (select n from n)', 5)} as mean_above_03,
      {r('(count(*) filter (similarity > 0.5) / 2.0::double) / ((select n from n) * ((select n from n) - 1) / 2.0::double) * 100', 5)} as strong_pair_pct from s""")
def similarity_stats(spark, sf):
    stats = recommend.similarity_stats(user_vectors(spark, sf))
    return round_all(stats, 5, "mean_similarity", "q25", "q50", "q75", "mean_above_03", "strong_pair_pct")


@query("reco_param_impact", f"""
    with {USERS_SQL}, {_sims('uv', 6)}, c as (select id, least(count(*) filter (similarity >= 0.9), 10) as kept from sims group by 1)
    select {r('avg(kept)', 5)} as avg_similar, count(*) filter (kept >= 10) as with_enough, count(*) as n_entities,
      {r('count(*) filter (kept >= 10) * 100.0::double / count(*)', 5)} as coverage_pct,
      case when count(*) filter (kept >= 10) * 100.0 / count(*) < 50 then 'limited recommendations: relax the threshold or the number of neighbours' else '' end as warning from c""")
def reco_param_impact(spark, sf):
    return round_all(recommend.param_impact(user_vectors(spark, sf), recommend.Settings(10, 0.9)), 5)


@query("reco_preview", f"""
    with {USERS_SQL}, {_sims('uv', 6)}, c as (select id, least(count(*) filter (similarity >= 0.9 and id <> other), 5) as n_similar from sims group by 1)
    select id, n_similar, case when n_similar >= 4 then 'enough' when n_similar > 0 then 'few' else 'none' end as note from c order by id limit 10""")
def reco_preview(spark, sf):
    return recommend.preview(user_vectors(spark, sf), recommend.Settings(5, 0.9))


@query("min_interactions", """
    with i as (select o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey)
    select o_custkey, l_partkey from i where l_partkey in (select l_partkey from i group by 1 having count(distinct o_custkey) >= 32)""")
def min_interactions(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return recommend.min_interactions(rows.select("o_custkey", "l_partkey"), "o_custkey", "l_partkey", 32)


_RECS_SQL = f"""
    owned as (select distinct o_custkey as "user", l_partkey as item from orders join lineitem on o_orderkey = l_orderkey),
    scored as (select t.id as "user", o.item, least({r('avg(t.similarity)', 12)}, 1.0::double) as confidence
               from top t join owned o on o."user" = t.other group by 1, 2),
    recs as (select "user", item, confidence, row_number() over (partition by "user" order by confidence desc, item)::int as rank
             from scored s where not exists (select 1 from owned o where o."user" = s."user" and o.item = s.item) qualify rank <= 5)"""
_USER_RECS_SQL = f"with {USERS_SQL}, {_sims('uv', 6)}, {_TOP_SQL}, {_RECS_SQL}"


def user_recs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours, owned items and recommendations of the balanced preset."""
    # Both the recommendations and what speaks for them read it.
    neighbours = cut_lineage(recommend.similar_entities(user_vectors(spark, sf), BALANCED))
    owned = owned_items(spark, sf)
    return neighbours, owned, recommend.recommend_user(neighbours, owned)


@query("recommend_user", f"{_USER_RECS_SQL} select \"user\", rank, item, {r('confidence', 6)} as confidence from recs")
def recommend_user(spark, sf):
    return round_all(user_recs(spark, sf)[2], 6, "confidence")


@query("recommend_item", f"with {ITEMS_SQL}, {_sims('iv', 5)}, {_TOP_SQL} select id as item, rank, other as recommended, {r('least(similarity, 1.0::double)', 6)} as confidence from top")
def recommend_item(spark, sf):
    return round_all(recommend.recommend_item(recommend.similar_entities(item_vectors(spark, sf), BALANCED)), 6, "confidence")


@query("reco_metrics", f"""{_USER_RECS_SQL}
    select count(distinct "user") as n_served, {r('avg(confidence)', 5)} as mean_confidence, count(distinct item) as n_products,
           (select count(*) from customer) as n_entities, {r('count(distinct "user") * 100.0::double / (select count(*) from customer)', 5)} as coverage_pct from recs""")
def reco_metrics(spark, sf):
    recs = user_recs(spark, sf)[2]
    return round_all(recommend.reco_metrics(recs, "user", "item", table(spark, sf, "customer")), 5)


_TEXT_SQL = f"""select "user", count(*) as n_recommendations, string_agg(item || ' (' || printf('%.2f', {r('confidence', 2)}) || ')', ', ' order by rank) as recommended,
           {r('avg(confidence)', 2)} as mean_confidence from recs group by 1"""


@query("reco_text", f"{_USER_RECS_SQL} {_TEXT_SQL}")
def reco_text(spark, sf):
    return recommend.reco_table(user_recs(spark, sf)[2], "user", "item")


@query("reco_evidence", f"""{_USER_RECS_SQL},
    why as (select r."user", r.item, t.other, t.similarity, row_number() over (partition by r."user", r.item order by t.similarity desc, t.other) as rk
            from recs r join top t on t.id = r."user" join owned o on o."user" = t.other and o.item = r.item)
    select "user", item, count(*) as n_neighbours,
           string_agg(other || ':' || printf('%.4f', {r('similarity', 4)}), ', ' order by rk) filter (rk <= 3) as evidence from why group by 1, 2""")
def reco_evidence(spark, sf):
    return recommend.reco_evidence(*user_recs(spark, sf))


@query("choose_approach", f"""
    with i as (select o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey),
    c as (select count(distinct o_custkey) as n_users, count(distinct l_partkey) as n_items, count(*) as n_rows from i)
    select n_users, n_items, n_rows, {r('n_rows::double / (n_users::double * n_items)', 6)} as density, {r('n_rows::double / n_items', 6)} as rows_per_item,
           case when n_users > 10 * n_items or n_users = 0 then 'item_based' else 'user_based' end as approach from c""")
def choose_approach(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return round_all(recommend.choose_approach(rows, "l_partkey", "o_custkey"), 6)


# --- clustering ---

_PLANE_SQL = f"""pts as (select c_custkey as id, c_acctbal / 1000 as x, coalesce(total, 0) / 500000 as y from customer
    left join (select o_custkey, sum(o_totalprice::decimal(18,2))::double as total from orders group by 1) on o_custkey = c_custkey)"""


def customer_plane(spark, sf) -> DataFrame:
    """Two numbers per customer: balance and revenue."""
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total"))
    return table(spark, sf, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"), (F.coalesce("total", F.lit(0.0)) / 500000).alias("y"))


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    return cluster.kmeans(customer_plane(spark, sf), "id", ["x", "y"], k=5)


@query("kmeans_choose_k")
def kmeans_choose_k(spark, sf):
    return cluster.kmeans_choose_k(customer_plane(spark, sf), "id", ["x", "y"])


@query("knn_distance", f"""
    with {_PLANE_SQL} select a.id, {r('min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))', 6)} as distance from pts a join pts b on a.id <> b.id group by 1""")
def knn_distance(spark, sf):
    return round_all(cluster.knn_distance(customer_plane(spark, sf), "id", ["x", "y"]), 6)


@query("knn_rings", f"""
    with {_PLANE_SQL}, n as (select a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance, row_number() over (partition by a.id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as nth
      from pts a join pts b on a.id <> b.id) select id, {r('distance', 6)} as distance from n where nth = 3""")
def knn_rings(spark, sf):
    """The way for large data, named, so that it is checked at any size: third nearest neighbours."""
    return round_all(cluster.knn_distance(customer_plane(spark, sf), "id", ["x", "y"], 3, "rings"), 6)


_DBSCAN_SQL = f"""with recursive {_PLANE_SQL},
    near as (select a.id as a, b.id as b from pts a join pts b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {{eps}} ** 2),
    core as (select a as id from near group by 1 having count(*) >= 5),
    links as (select a, b from near where a in (from core) and b in (from core)),
    reach(id, root) as (select id, id from core union select l.b, t.root from reach t join links l on l.a = t.id where t.root < l.b),
    rooted as (select id, min(root) as root from reach group by 1),
    border as (select n.a as id, min(rt.root) as root from near n join rooted rt on rt.id = n.b where n.a not in (from core) group by 1),
    marked as (select id, root, true as is_core from rooted union all select id, root, false from border),
    numbers as (select root, (row_number() over (order by root) - 1)::int as cluster from (select distinct root from rooted))
    select pts.id, coalesce(n.cluster, -1) as cluster, coalesce(m.is_core, false) as is_core
    from pts left join marked m on m.id = pts.id left join numbers n on n.root = m.root"""


@query("dbscan_assign", _DBSCAN_SQL.replace("{eps}", "0.3::double"))
def dbscan_assign(spark, sf):
    return cluster.dbscan(customer_plane(spark, sf), "id", ["x", "y"], eps=0.3, min_samples=5)


@query("dbscan_grid", _DBSCAN_SQL.replace("{eps}", "0.3::double"))
def dbscan_grid(spark, sf):
    """The way for large data, named, so that it is checked at any size."""
    return cluster.dbscan(customer_plane(spark, sf), "id", ["x", "y"], eps=0.3, min_samples=5, method="grid")


@query("silhouette", f"""
    with d as (select a.vec_id as id, a.label as own, b.label as label, sum(list_distance(a.embedding::double[], b.embedding::double[])) as total, count(*) as n
               from embeddings a join embeddings b on true group by all),
    p as (select id, max(case when own = label and n > 1 then total / (n - 1) end) as a, min(case when own <> label then total / n end) as b from d group by 1)
    select count(*) as n, {r('avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end)', 5)} as silhouette from p""")
def silhouette(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return round_all(cluster.silhouette(labels, "id", [], "label", embedding_vectors(spark, sf)), 5)


@query("wcss", f"""
    select c_mktsegment, count(*) as n, {r('var_pop(c_acctbal) * count(*) + var_pop(c_nationkey) * count(*)', 2)} as wcss from customer group by 1""")
def wcss(spark, sf):
    return round_all(cluster.wcss(table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]), 2)


@query("cluster_insights", f"""
    with s as (select label, count(*) as n from embeddings group by 1), t as (select sum(n)::double as total from s)
    select count(*) as n_clusters, sum(n)::bigint as n_clustered, 0::bigint as n_noise, arg_max(label, (n, -label)) as largest, max(n) as largest_rows,
      {r('max(n) * 100.0::double / (select total from t)', 6)} as largest_pct, arg_min(label, (n, label)) as smallest, min(n) as smallest_rows,
      {r('min(n) * 100.0::double / (select total from t)', 6)} as smallest_pct from s""")
def cluster_insights(spark, sf):
    return round_all(cluster.cluster_insights(table(spark, sf, "embeddings"), "label"), 6)
