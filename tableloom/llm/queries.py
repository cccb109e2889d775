"""The queries of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableloom.llm import bitslices, decontaminate, language, lines, manifest, mixing, packing, secrets, shards, simhash, urls, warc, whitening
from tableloom.llm.common import QUERIES, SQL, query, table


@query("op1_simhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its group."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_context_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under context mixing and under single words, learned outside the held-out fold."""
    return mixing.score(table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 7, 2), kind_col="lang")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_nnls_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    found = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(found.drop("ids"))


OP4_SQL = r"""
with fold(a, b) as (values ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents, fold),
i as (select item_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark, fold),
g as (select distinct item_id, least(10, len(w)) n, array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') gram
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) pos from i where len(w) > 0)),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) pos from d, (select distinct n from g)),
m as (select doc_id, item_id, pos, p.n from p join g on g.n = p.n and g.gram = array_to_string(w[pos:pos + p.n - 1], ' ')),
h as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(pos, pos + n)) k from m) group by doc_id),
o as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from m) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join o using (doc_id)"""


@query("op4_contamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten consecutive words of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_fuzzy_lines")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, alike or nearly so, an earlier one."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), wide=True)


OP6_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
r as (select page_id, octet_length(encode(html)) payload_bytes, max(page_id) over (partition by html) first_id, sha1(html) hex from p),
b as (select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4)::int + 1, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int + 1, 1), '' order by k) digest
  from r, range(32) t(k) group by page_id)
select page_id, payload_bytes::bigint payload_bytes, digest payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id <> first_id then first_id end refers_to from r join b using (page_id)"""


@query("op6_warc_archives", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back from them."""
    path = warc.archive_path(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The bytes of a text, one nibble after the other, through the CRC's table of sixteen.
OP7_SQL = """
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 size, md5(text) k, coalesce(text, '') t from documents),
c as (select doc_id, size, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(t)), '..')]),
  lambda c, b: xor(xor(xor(c, b) >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
    3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1]) >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444,
    1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(xor(c, b) >> 4,
    [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920,
    2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1]) & 15) + 1]))) crc from d),
s as (select doc_id, size, crc, k, sum(size) over (order by k nulls first, doc_id) upto, sum(size) over () total, row_number() over (order by k nulls first, doc_id) nth from c),
p as (select *, least(23, ((2 * upto - size) * 24) // (2 * total))::int shard from s)
select doc_id, size::bigint size, crc text_crc32, 'bytes' law, shard, (nth - min(nth) over (partition by shard))::bigint slot, null::int grown_shard from p"""


@query("op7_prefix_shards", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of equal bytes."""
    found = shards.assign_shards(table(spark, sf_dir, "documents"), 24)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_guess_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed shapes, and all spans."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = secrets.spans_text(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"))


OP9_SQL = """
with v as (select vec_id, [floor(64 * x::double) for x in embedding] v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s
qualify rank <= 20"""


@query("op9_bitslice_search", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20, against all others."""
    found = bitslices.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op10_crf_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(language.held_out(F.col("doc_id"), 4, 2), F.lit(False))
    found = language.predict(docs, language.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


# (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

OP11_SQL = r"""
with p as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r(rh, rp, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path, (select arg_max(rh || rp, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as "rule",
  coalesce((select arg_max(verdict, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)), 'allow') verdict from u"""


@query("op11_url_filters", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, and the rule that gives it."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP12_SQL = r"""
with recursive e as (select doc_id, coalesce('+' || source, '') tree, crc32n % 2 = 0 bad,
    concat(case when doc_id is null then '-' else length(doc_id::varchar) || ':' || doc_id end, case when source is null then '-' else octet_length(encode(source)) || ':' || source end,
      case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end, case when n_chars is null then '-' else length(n_chars::varchar) || ':' || n_chars end) head, text, replace(text, chr(10), '') cut
  from (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(doc_id::varchar)), '..')]),
    lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end))) crc32n from documents)),
l as (select doc_id, tree, bad, sha256(head || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) leaf,
  sha256(head || case when cut is null then '-' else octet_length(encode(cut)) || ':' || cut end) cut_leaf from e),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 at0 from l),
low(tree, lvl, idx, h, n) as (
  select tree, 0, at0, leaf, count(*) over (partition by tree) from p
  union all select tree, any_value(lvl) + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from low where n > 1 group by tree, idx // 3),
s as (select tree, h subroot, row_number() over (order by tree) - 1 at1 from low where n = 1),
high(lvl, idx, h, n) as (
  select 0, at1, subroot, count(*) over () from s
  union all select any_value(lvl) + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from high where n > 1 group by idx // 3),
steps as (
  select p.tree, at0, 0 part, a.lvl, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') l, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') r
  from p join low a on a.tree = p.tree and a.n > 1 and a.idx = p.at0 // (3 ** a.lvl)::bigint join low b on b.tree = a.tree and b.lvl = a.lvl and b.idx // 3 = a.idx // 3 group by all
  union all select p.tree, at0, 1, a.lvl, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), ''), coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '')
  from p join s using (tree) join high a on a.n > 1 and a.idx = s.at1 // (3 ** a.lvl)::bigint join high b on b.lvl = a.lvl and b.idx // 3 = a.idx // 3 group by all),
o as (select tree, at0, sha256(string_agg(l || r, '' order by part, lvl)) proof, list([l, r] order by part, lvl) lr from steps group by all),
f as (select doc_id, leaf, subroot, (select h from high where n = 1) root, coalesce(proof, sha256('')) proof_sha256,
    list_reduce(list_prepend([case when bad then cut_leaf else leaf end, ''], coalesce(lr, [])), lambda x, y: [sha256(y[1] || x[1] || y[2]), ''])[1] folded_root
  from p join s using (tree) left join o using (tree, at0))
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from f"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and whether the proof holds when every other text loses its line ends."""
    text = F.col("text")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = manifest.manifest(table(spark, sf_dir, "documents"), tamper={"text": cut})
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.sha(manifest.siblings_text(F.col("proof"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_feast_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four components of largest variance, whitened."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), id_col="vec_id", vec_col="embedding", scale=256, components=4)
    return found.select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


def load_queries() -> tuple[dict, dict]:
    return dict(QUERIES), dict(SQL)
