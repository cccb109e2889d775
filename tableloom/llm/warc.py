"""WARC archives with an index first: written by Spark, read back by coalesced byte ranges.

Every task that reads pages writes one archive, so pages do not move. Of equal payloads the one with the largest page
id is the response; the others are revisits that refer to it and carry HTTP headers only. One pass over the archives
reads the heads of their records and writes the index: archive, offset, length, URL, digest. A reader takes the index
rows it wants, sorts them by offset, joins ranges that lie close together and reads each range once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableloom.llm.common import col
from tableloom.session import cut_lineage, work_path

# Digests of payloads that occur again, which go to all executors; more are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000
# Bytes of an archive that the indexer holds, in which heads are found.
HELD_BYTES = 4 << 20
# Ranges closer than this are read as one, up to the largest read.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

INDEX = (
    "page_id bigint, url string, archive string, offset bigint, length bigint, digest string, record_type string, refers_to bigint, payload_bytes bigint")
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, body_digest string, payload binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits, which are five hex digits, make four of its digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest."""
    rows = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))


def _headed(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """With `again`, for revisits, and `head`, all of the record before its payload."""
    rows = rows.join(firsts, ["digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    rows = rows.withColumn("again", again).withColumn("record_type", F.when(F.col("again"), "revisit").otherwise("response"))
    rows = rows.withColumn("refers_to", F.when(F.col("again"), F.col("first_id")))
    uuid = lambda key: F.regexp_replace(F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    # Blanks and control characters would end a header line.
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    body = F.when(F.col("again"), F.lit(0).cast("bigint")).otherwise(F.col("payload_bytes"))
    revisit = F.when(F.col("again"), F.concat(
        line("WARC-Refers-To", uuid(name(F.col("refers_to")))), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")), line("WARC-Profile", F.lit(PROFILE)))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uuid(name(F.col("page_id")))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")), F.coalesce(line("WARC-Page", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), revisit,
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.octet_length(http) + body).cast("string")), F.lit("\r\n"), http)
    return rows.withColumn("head", head)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write `path`/archives and `path`/index; the index (see `INDEX`) is returned.

    Of rows with equal payloads of at least `least` bytes, those with the largest page id are responses and the others
    revisits; shorter payloads are all responses. A null html is empty, a null URL is left out of the record, a row
    without page id never is the first of its payload. Repeated rows get a record each. An empty table has no records.
    """
    spark = pages.sparkSession
    rows = _pages(pages, id_col, url_col, html_col)
    # Counted on the map side. Only payloads that occur again are looked up, so that the others need not move for it.
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = cut_lineage(firsts.where("n > 1 and first_id is not null").drop("n"))
    if firsts.count() <= BROADCAST_DIGESTS:
        firsts = F.broadcast(firsts)
    record = F.concat("head", F.when(F.col("again"), "").otherwise(F.col("payload")))
    _headed(rows, firsts).select(record.alias("record")).write.option("lineSep", END).text(f"{path}/archives")
    index_archives(spark, path).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _open(file: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", file))
    return system.open_input_file(name)


def heads(data, held_bytes: int = HELD_BYTES) -> Iterator[tuple[int, int, dict, int]]:
    """(offset, length, header fields, payload bytes) of the records of an open archive, one after the other."""
    size, offset, start, held = data.size(), 0, 0, b""
    while offset < size:
        more = held_bytes
        while True:
            at = offset - start
            end = held.find(b"\r\n\r\n", at)
            http = held.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if http >= 0:
                break
            if start + len(held) >= size and start == offset:
                raise ValueError("an archive that ends within a record")
            held, start, more = data.read_at(min(more, size - offset), offset), offset, 2 * more
        fields = dict(x.split(": ", 1) for x in held[at:end].decode().split("\r\n")[1:])
        length = end + 4 - at + int(fields["Content-Length"]) + len(END)
        yield offset, length, fields, int(re.search(rb"\r\nContent-Length: (\d+)", held[end:http])[1])
        offset += length
        if offset - start >= len(held):
            held, start = b"", offset


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all records in `path`/archives; every archive is read by one task, a window at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").where("length > 0").select("path")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file in part.column(0).to_pylist():
                out, name = [], file.rsplit("/", 1)[1]
                with _open(file) as data:
                    for offset, length, fields, size in heads(data):
                        number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
                        out.append({
                            "page_id": number("WARC-Page"), "url": fields.get("WARC-Target-URI"), "archive": name, "offset": offset, "length": length,
                            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
                            "refers_to": number("WARC-Refers-To-Page"), "payload_bytes": size})
                        if len(out) == 10_000:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    return files.mapInArrow(run, INDEX)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    numbers = {"page_id", "offset", "length", "refers_to", "payload_bytes"}
    return pa.RecordBatch.from_pylist(rows, pa.schema([
        (name, pa.int64() if name in numbers else pa.string()) for name in (c.split()[0] for c in INDEX.split(", "))]))


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, largest: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(offset, length, how many) of the reads that cover sorted (offset, length) ranges."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= largest:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([offset, length, 1])
    return [tuple(x) for x in out]


def parse(record: bytes) -> dict:
    """Headers and payload of one record; what the record says of itself is checked."""
    if not record.endswith(END.encode()):
        raise ValueError("a record without its end")
    head, _, block = record[:-len(END)].partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the start of a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if int(fields["Content-Length"]) != len(block):
        raise ValueError("the length of the block is not as stated")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    body = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if response and (body != digest or len(payload) != size):
        raise ValueError("the payload is not as stated")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("WARC-Page"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page"), "body_digest": body if response else None,
        "payload": payload if response else None}


def read_records(spark: SparkSession, path: str, index: DataFrame, gap: int = GAP_BYTES, payloads: bool = True) -> DataFrame:
    """The records that `index` rows name, with the headers and, for responses, payloads that lie in the archives of `path`."""
    wanted = index.select("archive", "offset", "length")
    count = max(1, wanted.select("archive").distinct().count())
    wanted = wanted.repartition(count, "archive").sortWithinPartitions("archive", "offset")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            files, rows = part.column(0).to_pylist(), list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and files[to] == files[at]:
                    to += 1
                with _open(f"{path}/archives/{files[at]}") as data:
                    for start, length, many in coalesce_ranges(rows[at:to], gap):
                        held = data.read_at(length, start)
                        found = [parse(held[o - start:o - start + n]) for o, n in rows[at:at + many]]
                        if not payloads:
                            found = [x | {"payload": None} for x in found]
                        at += many
                        yield pa.RecordBatch.from_pylist(found, pa.schema([
                            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("body_digest", pa.string()), ("payload", pa.binary())]))

    return wanted.mapInArrow(run, RECORD)


def archive_path(spark: SparkSession) -> str:
    return work_path(spark, "warc")
