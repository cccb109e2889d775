"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by blanks, in bytes. Every run of `window` words of an item, or a
whole shorter item, is one pattern of the automaton, with a blank at either end so that only whole words match. Each
document is scanned once; ends of matches map back to words, and words to places in the original text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tableloom.llm.common import col
from tableloom.session import cut_lineage

WINDOW = 10
# Items go to the workers up to this many bytes at once; a larger benchmark is scanned part by part.
PART_BYTES = 32 << 20

# A-Z to lower case; every other byte below 0x80 that is neither a digit nor a letter to a blank. Bytes of other characters stay.
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))

def _result(id_type: T.DataType) -> T.StructType:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def build(items: list[tuple[str, bytes | None]], window: int):
    """The automaton; every pattern holds its number of words and the ids of its items. None without patterns."""
    import ahocorasick

    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(0, len(words) - window) + 1 if words else 0):
            run = words[at:at + window]
            # One character for each byte.
            found.setdefault((b" " + b" ".join(run) + b" ").decode("latin-1"), (len(run), set()))[1].add(item)
    if not found:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, value in found.items():
        automaton.add_word(pattern, value)
    automaton.make_automaton()
    return automaton


def scan(automaton, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs [from, to) of hit words, and ids of the items that occur."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    items: set[str] = set()
    runs: list[tuple[int, int]] = []
    starts = None
    for end, (n, ids) in automaton.iter(line):
        if starts is None:
            starts = list(accumulate((len(w) + 1 for w in words), initial=1))
        # The match ends with the blank after its last word.
        to = bisect_right(starts, end)
        items |= ids
        runs.append((to - n, to))
    return len(words), merge(runs), items


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def places(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges of runs of words in the original text, from its first to its last word."""
    folded, bounds, at = text.translate(_FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    chars = lambda b: len(text[:b].decode("utf-8", "replace"))
    return [(chars(bounds[a][0]), chars(bounds[b - 1][1])) for a, b in runs]


def _scan_part(rows: DataFrame, items: list[tuple[str, bytes | None]], window: int, id_type: T.DataType) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(items, window)
        for part in parts:
            n_words, n_hit, ids, spans = [], [], [], []
            for text in part.column(1).to_pylist():
                n, runs, found = scan(automaton, text)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in runs))
                ids.append(sorted(found))
                spans.append([{"start": a, "end": b} for a, b in places(text, runs)] if runs else [])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return rows.mapInArrow(run, _result(id_type))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids sorted as strings, spans) per row of `docs`.

    A word is hit if it lies in any occurrence of a window; spans are the hit runs as code points of the original
    text, end exclusive. Null and empty texts have no words, items without words no windows; items without id count
    for hits under the id ''. Repeated rows stay repeated; an item that is listed twice counts once. Other columns
    are not looked at. A benchmark above `part_bytes` is scanned in parts, whose hits are merged per document.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    items = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(item_text_col).cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if total <= part_bytes:
        return _scan_part(rows, [tuple(r) for r in items.collect()], window, id_type)
    # Numbers of parts stand in for the keys, so that a part has a bounded size; a single larger item is a part of its own.
    parts = -(-2 * total // part_bytes)
    items = cut_lineage(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))))
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    merged = None
    for p in range(parts):
        listed = [tuple(r) for r in items.where(F.col("part") == p).select("item", "text").collect()]
        found = _scan_part(rows.select(F.struct("uid", "doc_id").alias("doc_id"), "text"), listed, window, T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type)]))
        merged = found if merged is None else merged.unionByName(found)
    merged = merged.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return _recount(rows.select(F.struct("uid", "doc_id").alias("doc_id"), "text").join(merged, "doc_id"), id_type)


def _recount(found: DataFrame, id_type: T.DataType) -> DataFrame:
    """Merge the spans of several parts and count the words in them."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_hit, spans = [], []
            for text, found_spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                whole = (text or b"").decode("utf-8", "replace")
                joined = []
                for s in found_spans:
                    # Runs that meet or overlap share words or have none between them.
                    if joined and not words_of(whole[joined[-1][1]:max(s["start"], joined[-1][1])].encode()):
                        joined[-1][1] = max(joined[-1][1], s["end"])
                    else:
                        joined.append([s["start"], s["end"]])
                n_hit.append(sum(len(words_of(whole[a:b].encode())) for a, b in joined))
                spans.append([{"start": a, "end": b} for a, b in joined])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").field("doc_id"), part.column("n_words"), pa.array(n_hit, pa.int64()), part.column("item_ids").cast(pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return found.mapInArrow(run, _result(id_type))


def items_digest(item_ids):
    """SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(item_ids, ",").cast("binary"), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
