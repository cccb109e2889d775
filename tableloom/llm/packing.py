"""Packing of documents into windows by non-negative least squares.

Every document is tokenised and cut at multiples of the window. Piece lengths are counted by units of `GRAIN` tokens.
All combinations of up to `DEPTH` unit lengths that fill a window are columns of a matrix; non-negative least squares
solves for how often each is used so that the histogram of lengths is met. Counts are rounded down and held to what is
there, and what is left over is packed greedily. All this works on the histogram, which has as many rows as a window
has units. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.llm.common import col
from tableloom.session import cut_lineage

WINDOW = 2048
GRAIN = 16
DEPTH = 3
# Longer runs of blanks or of other characters are left to the slower encoder, which gives the same ids.
LONG_RUN = 4096
END_ID = 1

PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


class Encoder:
    """Ids of the byte-level vocabulary at `vocabulary`, a file of the `tokenizers` library.

    Plain text goes through the same vocabulary as ranks, if `ranks` names the file, which is several times faster.
    Text with other characters, or with what may be a special token, is left to the first library.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import re

        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.fast = None
        # Letters, digits, signs and blanks on which both libraries' classes agree.
        self.plain = re.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞]*")
        # A run of blanks, or of anything else, that the fast library's expression would have to go back over.
        self.long_run = re.compile(r"\s{%d}|\S{%d}" % (LONG_RUN, LONG_RUN))
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text and self.plain.fullmatch(text) and (len(text) < LONG_RUN or not self.long_run.search(text)):
            return self.fast.encode_to_numpy(text).astype("<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(
    df: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) per piece of at most `window` ids; a null text is empty and has its end alone."""
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        for part in parts:
            which, out = [], []
            for i, text in enumerate(part.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array(end_id, "<u4"))
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window].tobytes()
                    which.append(i)
                    out.append((start, len(piece) // 4, zlib.crc32(piece), len(ids), piece if keep_ids else None))
            start, length, crc, total, kept = zip(*out) if out else [[]] * 5
            big = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(which, pa.int64())), *big, pa.array(kept, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return rows.mapInArrow(cut, PIECES.format(id=id_type))


def combinations(units: int, depth: int, least: int = 1) -> Iterator[tuple[int, ...]]:
    """All ascending tuples of up to `depth` lengths with the sum `units`."""
    if units >= least:
        yield (units,)
    if depth > 1:
        for first in range(least, units // 2 + 1):
            for rest in combinations(units - first, depth - 1, first):
                yield (first, *rest)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        free = np.where(passive, -np.inf, slope)
        best = int(np.argmax(free))
        if free[best] <= tolerance:
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if len(s) == 0 or s.min() > 0:
                break
            # Go towards s as far as all stay at or above 0; what gets there leaves.
            short = s <= 0
            step = np.min(x[at][short] / np.maximum(x[at][short] - s[short], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[short & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[short][np.argmin(x[at][short])][None]
            passive[gone] = False
            x[gone] = 0.0
        x[:] = 0.0
        x[at] = s
        slope = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(unit lengths that share a window, how many windows)], which use up the histogram exactly."""
    left = np.zeros(units + 1, np.int64)
    for u, n in histogram.items():
        left[u] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], most: int) -> None:
        times = min([most, *(int(left[u]) // combo.count(u) for u in set(combo))])
        if times > 0:
            for u in combo:
                left[u] -= times
            out.append((combo, times))

    # Full windows need no partner.
    use((units,), int(left[units]))
    combos = [c for c in combinations(units, depth) if len(c) > 1 and all(left[u] for u in c)]
    if combos:
        a = np.zeros((units, len(combos)))
        for j, c in enumerate(combos):
            for u in c:
                a[u - 1, j] += 1
        x = nnls(a, left[1:].astype(float))
        for j in np.argsort(-x, kind="stable"):
            use(combos[j], int(x[j] + 1e-6))
    while left.any():
        # The longest that is left, and time and again the longest that still fits.
        combo, room, have = [], units, left.copy()
        while room and (fits := np.flatnonzero(have[:room + 1])).size:
            u = int(fits[-1])
            combo.append(u)
            have[u] -= 1
            room -= u
        use(tuple(combo), int(left.sum()))
    return out


def pack(found: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 within a sequence of at most `window` ids.

    Pieces of equal length are interchangeable: their rank, by partitions and then by id, start and content, says
    which place they take, so a length that a third of all pieces have is ranked in parts. No piece, no sequence.
    """
    spark = found.sparkSession
    units = window // grain
    found = cut_lineage(found.withColumn("unit", F.ceil(F.col("length") / grain)).withColumn("part", F.spark_partition_id()))
    counts = cut_lineage(found.groupBy("part", "unit").agg(F.count(F.lit(1)).alias("n")))
    # At most `units` rows.
    histogram = {r["unit"]: r["n"] for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    places, used, sequences = [], dict.fromkeys(histogram, 0), 0
    for combo, times in plan(histogram, units, depth):
        for u in sorted(set(combo)):
            many = combo.count(u)
            places.append((u, used[u], used[u] + many * times, many, sequences))
            used[u] += many * times
        sequences += times
    # A few rows per unit length.
    places = F.broadcast(spark.createDataFrame(places, "unit bigint, from_rank bigint, to_rank bigint, many bigint, base bigint"))
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    local = Window.partitionBy("part", "unit").orderBy("doc_id", "start", "ids_crc32")
    ranked = found.withColumn("nth", F.row_number().over(local)).join(offsets, ["part", "unit"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    seated = ranked.join(places, "unit").where("rank >= from_rank and rank < to_rank").withColumn(
        "sequence_id", F.expr("base + (rank - from_rank) div many"))
    # A window holds at most `units` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("unit", "part", "nth", "before", "rank", "from_rank", "to_rank", "many", "base")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids binary): the ids of each window, little-endian unsigned 32-bit; for pieces with `keep_ids`."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.concat_ws("", whole)).alias("ids"))
