"""Sources, sinks and catalog on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableloom.functions.scalars import table_key
from tableloom.plans.base import query, table, tables
from tableloom.session import work_path
from tableloom.sources import catalog, files

ALL_TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("parquet_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 250000")
def parquet_scan(spark, sf):
    orders = files.load(spark, f"{sf}/orders.parquet", "parquet")
    return orders.where(F.col("o_totalprice") > 250000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("csv_roundtrip", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(spark, sf):
    path = files.write_csv(table(spark, sf, "customer"), work_path(spark, "customer_csv"))
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return files.load(spark, path, "csv", schema)


@query("csv_inferred", "select c_custkey::int as c_custkey, c_name, case when c_custkey % 7 <> 0 then c_acctbal end as c_acctbal, case when c_custkey % 5 <> 0 then c_nationkey::int end as c_nationkey from customer")
def csv_inferred(spark, sf):
    """Columns whose gaps are written as tokens are still numbers."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("string")).otherwise("NA").alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).otherwise("null").alias("c_nationkey"))
    return files.load(spark, files.write_csv(rows, work_path(spark, "customer_gaps")), "csv")


@query("catalog_lookup", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def catalog_lookup(spark, sf):
    stored = {"Part.v1.csv": table(spark, sf, "part"), "Customer-List.csv": table(spark, sf, "customer")}
    root = work_path(spark, "catalog")
    for name, df in stored.items():
        files.write_table(df, root, name, catalog.PREFIXES["onboarding"])
    return catalog.read_registered(spark, catalog.register(stored), root, "Part.v1.csv")


@query("json_records", """
    select to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment})::varchar as record
    from customer""")
def json_records(spark, sf):
    return files.json_records(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("table_registry", " union all ".join(
    f"select 'onboarding_table_{t}' as table_name, '{t}' as original_name, count(*) as row_count, {n}::bigint as column_count from {t}"
    for t, n in ALL_TABLES.items()))
def table_registry(spark, sf):
    return catalog.register(tables(spark, sf, *ALL_TABLES))


@query("name_normalise", """
    select doc_id, lower(replace(split_part(upper(source) || '-' || lang || '.V2.csv', '.', 1), '-', '_')) as table_key from documents""")
def name_normalise(spark, sf):
    name = F.concat(F.upper("source"), F.lit("-"), F.col("lang"), F.lit(".V2.csv"))
    return table(spark, sf, "documents").select("doc_id", table_key(name).alias("table_key"))


@query("latest_per_key", """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_per_key(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return catalog.latest_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("upsert_latest", """
    select c_custkey as key, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as segment from customer
    union all select s_suppkey + 1000000000 as key, 'SUPPLIER' as segment from supplier""")
def upsert_latest(spark, sf):
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    base = customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    delta = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit("DEBT").alias("segment")).unionByName(
        supplier.select((F.col("s_suppkey") + 1000000000).alias("key"), F.lit("SUPPLIER").alias("segment")))
    return catalog.upsert(base, delta, ["key"])


@query("schema_evolve", """
    select c_custkey as key, c_name as name, null::double as balance from customer
    union all select s_suppkey as key, s_name as name, s_acctbal as balance from supplier""")
def schema_evolve(spark, sf):
    log = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return catalog.append_evolving(log, new)


@query("mapping_json", """
    select p_partkey, 'product_id' as role, p_name as column_name from part
    union all select p_partkey, 'target' as role, p_brand as column_name from part where p_size <= 25
    union all select p_partkey, 'timestamp' as role, p_type as column_name from part""")
def mapping_json(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("product_id"), F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("target"),
        F.col("p_type").alias("timestamp"))
    return catalog.decode_mapping(catalog.encode_mapping(rows, ["product_id", "target", "timestamp"]))
