"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. A block of rows keeps, per attribute, the least value and the bits above it as
slices: one bitmap over the rows for each bit. For a query every attribute value is written in signed digits; a digit
adds the attribute's slices at its weight, a negative one their complements. Carry-save adders sum the bitmaps of
equal weight, which leaves the slices of the score of all rows of the block at once. From the most significant slice
downward, rows with the bit are taken while no more than k are, else the others are put aside. What remains at the end
are rows with one equal score at the boundary, of which the smallest ids are taken.

Every block meets every chunk of queries; both have a bounded number of rows. A meeting sends on k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.llm.common import col
from tableloom.session import cut_lineage

BLOCK_ROWS = 16_384
CHUNK_QUERIES = 128
# Quantised components beyond this are no whole numbers of 64 bits; their vectors take no part.
LARGEST = 1 << 62
# Scores are ranked as bytes that sort like the whole numbers, of whatever size; so many bits hold any of them.
SCORE_BYTES = 20
LONG = 1 << 63


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column, scale: int) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) >= float(LARGEST)))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integers (rows, attributes): least value and number of bits per attribute, and all slices, attribute by attribute, as (slices, words)."""
    n, d = values.shape
    low = values.min(axis=0) if n else np.zeros(d, np.int64)
    above = (values - low).astype(np.uint64)
    bits = np.array([int(x).bit_length() for x in (above.max(axis=0) if n else low)], np.int64)
    words = -(-n // 64)
    slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for a in range(d):
        for j in range(bits[a]):
            packed = np.packbits(((above[:, a] >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            slices[at, :len(packed)] = packed
            at += 1
    return low, bits, slices.view(np.uint64)


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(weight, +1 or -1) with sum(sign << weight) = q and no two weights in a row."""
    out, at = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((at, sign))
            q -= sign
        q >>= 1
        at += 1
    return out


def add_slices(levels: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum bitmaps, given as (maps, words) by weight, per row: the slices of the sums, least significant first."""
    out, weight = [], 0
    while levels:
        parts = levels.pop(weight, [])
        if not parts:
            out.append(None)
            weight += 1
            continue
        maps, carries = np.concatenate(parts) if len(parts) > 1 else parts[0], []
        while len(maps) > 2:
            k = len(maps) // 3
            a, b, c = maps[:k], maps[k:2 * k], maps[2 * k:3 * k]
            either = a ^ b
            carries.append((a & b) | (either & c))
            maps = np.concatenate([either ^ c, maps[3 * k:]])
        if len(maps) == 2:
            carries.append(maps[:1] & maps[1:])
            maps = maps[:1] ^ maps[1:]
        if carries:
            levels.setdefault(weight + 1, []).extend(carries)
        out.append(maps[0])
        weight += 1
    return out


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def score_slices(query: list[int], low, bits, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The slices of the scores of all rows, and the constant to add to what they hold."""
    starts = np.concatenate([[0], np.cumsum(bits)])
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    constant = 0
    for a, q in enumerate(query):
        q = int(q)
        constant += q * int(low[a])
        for weight, sign in signed_digits(q):
            for j in range(int(bits[a])):
                (plus if sign > 0 else minus).setdefault(weight + j, []).append(int(starts[a]) + j)
            if sign < 0:
                constant -= ((1 << int(bits[a])) - 1) << weight
    levels = {w: [slices[rows]] for w, rows in plus.items()}
    for w, rows in minus.items():
        levels.setdefault(w, []).append(~slices[rows])
    return add_slices(levels), constant


def top_rows(slices: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Of the rows in the bitmap `rows`, the k with the highest sums; at the boundary those that come first."""
    taken, open_ = np.zeros_like(rows), rows
    n = 0
    for s in reversed(slices):
        if s is None:
            continue
        hit = open_ & s
        more = int(np.bitwise_count(hit).sum())
        if n + more > k:
            open_ = hit
        else:
            taken |= hit
            n += more
            open_ = open_ & ~s
            if n == k:
                return _rows_of(taken)
    return np.concatenate([_rows_of(taken), _rows_of(open_)[:k - n]])


def search_block(low, bits, slices, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, own_of: np.ndarray, k: int):
    """Per query: its number, the rows of the block and their scores. Rows are sorted by id; `own` names the row itself."""
    n = len(ids)
    everyone = np.zeros(slices.shape[1] * 8, np.uint8)
    everyone[:-(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    everyone = everyone.view(np.uint64)
    for i, query in enumerate(queries):
        rows = everyone
        mine = np.flatnonzero(own == own_of[i])
        if len(mine):
            rows = rows.copy()
            rows[mine[0] >> 6] &= ~(np.uint64(1) << np.uint64(mine[0] & 63))
        sums, constant = score_slices(list(query) + [0] * (len(low) - len(query)), low, bits, slices)
        best = top_rows(sums, rows, k)
        score = [constant] * len(best)
        for w, s in enumerate(sums):
            if s is not None:
                bit = (s[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)
                score = [x + (int(b) << w) for x, b in zip(score, bit)]
        yield i, best, score


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """The usable rows (own, id, v), the index with a row per block, and the number of blocks. Both lie in the shared folder."""
    rows = df.where(usable(col(vector_col), scale) & col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("own"), col(id_col).cast("bigint").alias("id"), quantised(col(vector_col), scale).alias("v"))
    rows = cut_lineage(rows)
    blocks = max(1, -(-rows.count() // block_rows))

    def build(part: pa.Table) -> pa.Table:
        vectors = part.column("v").to_pylist()
        order = np.lexsort([part.column("own").to_numpy(), part.column("id").to_numpy()])
        low, bits, slices = build_slices(_matrix(vectors, max(map(len, vectors), default=0))[order])
        return pa.table({
            "block": part.column("block").slice(0, 1), "low": [low.tobytes()], "bits": [bits.tobytes()], "slices": [slices.tobytes()],
            "ids": [part.column("id").to_numpy()[order].tobytes()], "owns": [part.column("own").to_numpy()[order].tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(blocks)))
    index = dealt.groupBy("block").applyInArrow(build, "block bigint, low binary, bits binary, slices binary, ids binary, owns binary")
    return rows, cut_lineage(index), blocks


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
    block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner products for each row that `is_query`, an expression over `id`.

    Candidates are all rows but the query's own; equal scores go by the smaller id. Rows without id and vectors that
    are null or hold null, non-finite or (scaled) components of 2^62 and more take no part; a score beyond a bigint is
    ranked in full and given as null; of vectors of unequal length, missing components
    count as 0. Repeated rows are candidates, and queries, each by itself. An empty table gives none.
    """
    rows, index, blocks = build_index(df, id_col, vector_col, scale, block_rows)
    asked = rows.where(is_query)
    chunks = max(1, -(-asked.count() // chunk_queries))
    packed = asked.withColumn("chunk", F.pmod(F.xxhash64("own"), F.lit(chunks))).groupBy("chunk").agg(
        F.collect_list(F.struct("own", "id", "v")).alias("queries"))
    # A stated query set against all rows, in blocks.
    meetings = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).repartition("chunk", "block").join(index, "block")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: np.frombuffer(x, np.int64)
        for part in parts:
            for meeting in part.to_pylist():
                low, bits, ids, owns = (whole(meeting[c]) for c in ("low", "bits", "ids", "owns"))
                slices = np.frombuffer(meeting["slices"], np.uint64).reshape(int(bits.sum()), -1)
                if not len(slices):
                    slices = np.zeros((0, -(-len(ids) // 64)), np.uint64)
                queries, out = meeting["queries"], []
                own_of = np.array([q["own"] for q in queries], np.int64)
                # Components that a block lacks are 0 in all its rows.
                vectors = [q["v"][:len(low)] for q in queries]
                for i, best, scores in search_block(low, bits, slices, ids, owns, vectors, own_of, k):
                    out += [(queries[i]["own"], queries[i]["id"], int(ids[r]), s if -LONG <= s < LONG else None, int(owns[r]), (s + (1 << 8 * SCORE_BYTES - 1)).to_bytes(SCORE_BYTES)) for r, s in zip(best, scores)]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], ["own", "query_id", "vec_id", "score", "row", "height"])

    found = meetings.select("queries", "low", "bits", "slices", "ids", "owns").mapInArrow(
        search, "own bigint, query_id bigint, vec_id bigint, score bigint, row bigint, height binary")
    best = Window.partitionBy("own").orderBy(F.desc("height"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
