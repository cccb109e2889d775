"""All-against-all work on vectors without ever listing all pairs as rows.

Each block of vectors travels as one row (ids + packed matrix); two blocks meet once in a cogroup, and numpy multiplies
them there. A tile sends on only what the question needs: the local best N per vector, the pairs above a threshold, a
histogram or per-vector counts.

Where cosines are asked for, vectors are dealt into blocks by direction: each goes to the nearest of a few pivots, and a
crowded direction is cut by a hash of the id. A block knows its centre and its widest angle from it, which bounds the
similarities of two blocks from above and below. Pairs of blocks that cannot reach the threshold, or the N-th value that
their vectors have found within their own block, are never brought together; where a bound decides all cells of a
pair, they are counted without being worked out. Distances need no directions: there blocks are dealt by the hash alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.session import cut_lineage

# Similarities are compared and ranked in full; only the noise of the last digits of a double is taken off, so that
# equal directions are equal and go by the smaller id.
DIGITS = 12
# Statistics of the whole matrix count its cells by steps of the sixth digit.
STEP_DIGITS = 6
PAIR_BLOCK = 2048
MAX_BLOCK = 32_768
CHUNK_CELLS = 4_000_000
MAX_PARTITIONS = 20_000
# Vectors in a block that is dealt by direction; small blocks are narrow, so more pairs are decided.
NARROW_BLOCK = 4096
# Fewer vectors are dealt by the hash: all their pairs take less than finding directions does.
DIRECTED = 100_000
# Centres of all blocks, which every task is told. Where they would be larger, blocks go by the hash and all pairs meet.
SUMMARY_BYTES = 32 << 20
# Up to so many blocks their pairs are listed here, without a job.
FEW_BLOCKS = 128
# What rounding may do to an angle near zero.
ANGLE_SLACK = 1e-7


def quoted(x: np.ndarray) -> np.ndarray:
    return np.round((x + 10.0 ** -(DIGITS + 3)) * 10.0**DIGITS) / 10.0**DIGITS


def _block_rows(vectors: DataFrame, n: int, largest: int) -> int:
    """Larger blocks mean fewer copies of each vector; enough blocks must remain to fill the cluster."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # About sqrt(2 * cores) blocks give one tile per core.
    return int(min(largest, max(256, n / (2 * cores) ** 0.5)))


@dataclass(frozen=True)
class Summary:
    """What is known of all blocks dealt by direction: sizes, unit centres, widest angles and which hold a vector of length zero."""

    rows: np.ndarray
    centres: np.ndarray
    reach: np.ndarray
    zero: np.ndarray

    def bounds(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest similarity that block `b` may have with each block."""
        angle = np.arccos(np.clip((self.centres * self.centres[b]).sum(axis=1), -1, 1))
        spread = self.reach + self.reach[b] + ANGLE_SLACK
        low, high = np.cos(np.minimum(np.pi, angle + spread)), np.cos(np.maximum(0, angle - spread))
        zero = self.zero | self.zero[b]
        return np.where(zero, np.minimum(low, 0), low), np.where(zero, np.maximum(high, 0), high)


@dataclass(frozen=True)
class Packed:
    """Blocks of vectors as one row each (b, ids, mat, labels), their number, and what is known of them if they were dealt by direction."""

    rows: DataFrame
    blocks: int
    summary: Summary | None = None


def _unit(mat: np.ndarray) -> np.ndarray:
    length = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    return np.divide(mat, length, out=np.zeros_like(mat), where=length > 0)


def pack_blocks(
    vectors: DataFrame, block_rows: int | None = None, largest: int = MAX_BLOCK, label: str | None = None, by_direction: bool = False,
) -> Packed:
    """Deal the vectors into blocks; pass the result to several questions about the same vectors."""
    # Computed once: the count decides on the blocks, then the same rows are packed.
    vectors = cut_lineage(vectors.select("id", "vec", (F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")).alias("label")))
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    size = block_rows or _block_rows(vectors, n, largest)
    by_direction = by_direction and (block_rows is not None or n >= DIRECTED)
    if by_direction and block_rows is None:
        size = min(size, max(NARROW_BLOCK, n * 8 * (width + 4) // SUMMARY_BYTES))
    blocks = max(1, -(-n // size))
    kind = vectors.schema["id"].dataType
    schema = T.StructType([
        T.StructField("b", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("mat", T.BinaryType()), T.StructField("labels", T.ArrayType(T.LongType())),
        T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("reach", T.DoubleType()), T.StructField("zero", T.BooleanType()),
    ])
    by_direction = by_direction and blocks > 1 and blocks * 8 * (width + 4) <= SUMMARY_BYTES

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        mat = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
        centre, reach, zero = [], 0.0, False
        if by_direction:
            unit = _unit(mat)
            sound = unit[(mat != 0).any(axis=1)]
            zero, mean = len(sound) < len(mat), sound.sum(axis=0, keepdims=True)
            centre = _unit(mean)[0]
            # Without a centre (only vectors of length zero, or directions that cancel out) nothing is known.
            reach = float(np.arccos(np.clip(sound @ centre, -1, 1)).max(initial=0)) if centre.any() else (np.pi if len(sound) else 0.0)
        return pd.DataFrame({
            "b": [key[0]], "ids": [pdf["id"].tolist()], "mat": [mat.tobytes()], "labels": [pdf["label"].tolist()],
            "centre": [list(centre)], "reach": [reach], "zero": [zero]})

    if not by_direction:
        tagged = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return Packed(tagged.groupBy("b").applyInPandas(pack, schema).drop("centre", "reach", "zero"), blocks)
    tagged, blocks = _by_pivots(vectors, blocks, size)
    rows = cut_lineage(tagged.groupBy("b").applyInPandas(pack, schema))
    # One row per block.
    known = rows.select("b", F.size("ids").alias("n"), "centre", "reach", "zero").toPandas()
    places = known["b"].to_numpy()
    count, centres, reach, zero = np.zeros(blocks, dtype=np.int64), np.zeros((blocks, width)), np.zeros(blocks), np.zeros(blocks, dtype=bool)
    count[places], reach[places], zero[places] = known["n"], known["reach"], known["zero"]
    if len(known):
        centres[places] = np.stack(known["centre"].to_numpy())
    return Packed(rows.drop("centre", "reach", "zero"), blocks, Summary(count, centres, reach, zero))


def _by_pivots(vectors: DataFrame, blocks: int, size: int) -> tuple[DataFrame, int]:
    """The vectors with their block `b`, by the nearest of as many pivots as there are blocks, and the number of blocks.

    Pivots are vectors chosen by the hash of their id. They only decide which blocks are narrow; the answers do not depend on them.
    """
    chosen = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(blocks).select("vec").collect()
    pivots = np.unique(_unit(np.array([r["vec"] for r in chosen], dtype=np.float64)).round(9), axis=0)

    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            mat = _unit(np.stack(part.to_numpy()).astype(np.float64)) if len(part) else np.zeros((0, pivots.shape[1]))
            step = max(1, CHUNK_CELLS // len(pivots))
            yield pd.Series(np.concatenate([(mat[at:at + step] @ pivots.T).argmax(axis=1) for at in range(0, max(1, len(mat)), step)]).astype(np.int32))

    spark = vectors.sparkSession
    placed = vectors.withColumn("cell", F.pandas_udf(nearest, "int")("vec"))
    counts = placed.groupBy("cell").count().orderBy("cell").collect()
    first, table = 0, []
    for row in counts:
        parts = -(-row["count"] // size)
        table.append((row["cell"], first, parts))
        first += parts
    cells = F.broadcast(spark.createDataFrame(table, "cell int, first int, parts int"))
    return placed.join(cells, "cell").withColumn("b", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("cell", "first", "parts"), max(1, first)


def tile_partitions(tiles: int) -> int:
    """Partitions for this many tiles. Tiles are small to ship but heavy to work on, so they must not be merged."""
    return max(1, min(2 * tiles, MAX_PARTITIONS))


class Tile:
    """Two blocks side by side; `same` when a block meets itself."""

    def __init__(self, left, right, same: bool, unit: bool):
        self.same = same
        self.ids_a, self.a, self.labels_a = self._open(left, unit)
        self.ids_b, self.b, self.labels_b = (self.ids_a, self.a, self.labels_a) if same else self._open(right, unit)

    @staticmethod
    def _open(row, unit: bool):
        ids = np.asarray(row["ids"])
        mat = np.frombuffer(row["mat"], dtype=np.float64).reshape(len(ids), -1)
        if unit:
            mat = _unit(mat)
        return ids, mat, np.asarray(row["labels"])

    def sides(self) -> Iterator[tuple]:
        """Each direction once: rows of one block against all of the other."""
        yield self.ids_a, self.a, self.ids_b, self.b, self.labels_b
        if not self.same:
            yield self.ids_b, self.b, self.ids_a, self.a, self.labels_a


def _chunks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, CHUNK_CELLS // max(1, len(y)))
    for start in range(0, len(x), step):
        yield start, x[start:start + step]


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return quoted(x @ y.T)


def squared_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] <= 16:
        total = np.zeros((len(x), len(y)))
        for k in range(x.shape[1]):
            total += (x[:, k, None] - y[None, :, k]) ** 2
        return total
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    total = np.maximum(size - 2 * x @ y.T, 0)
    # Where the difference of large numbers leaves few digits, the distance is worked out by components.
    rows, cols = np.nonzero(total < 1e-6 * size)
    step = max(1, CHUNK_CELLS // x.shape[1])
    for at in range(0, len(rows), step):
        r, c = rows[at:at + step], cols[at:at + step]
        total[r, c] = ((x[r] - y[c]) ** 2).sum(1)
    return total


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distance(x, y))


def tiles_of(packed: Packed, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], same: bool = True) -> DataFrame | None:
    """(i, j) for the unordered pairs of blocks that have to meet, i = j included if `same`; None for all, where nothing is known of the blocks.

    `wanted` says of the pairs of a block with all others, by their least and largest similarity, which cannot be left out.
    """
    spark, blocks, summary = packed.rows.sparkSession, packed.blocks, packed.summary
    if summary is None:
        return None
    tasks = min(blocks, 4 * spark.sparkContext.defaultParallelism)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part["id"]:
                keep = wanted(b, *summary.bounds(b))
                keep[:b if same else b + 1] = False
                j = np.nonzero(keep)[0].astype(np.int32)
                yield pd.DataFrame({"i": np.full(len(j), b, dtype=np.int32), "j": j})

    if blocks <= FEW_BLOCKS:
        return spark.createDataFrame(pd.concat(listed([pd.DataFrame({"id": range(blocks)})])), "i int, j int")
    return cut_lineage(spark.range(0, blocks, 1, tasks).mapInPandas(listed, "i int, j int"))


def over_tiles(
    vectors: DataFrame, kernel: Callable[[Tile], pd.DataFrame], schema: T.StructType | str,
    block_rows: int | None = None, unit: bool = False, label: str | None = None, largest: int = MAX_BLOCK,
    packed: Packed | None = None, tiles: DataFrame | None = None,
) -> DataFrame:
    """Run `kernel` once for every pair of blocks in `tiles`, without it for every unordered pair, a block with itself included."""
    packed = packed or pack_blocks(vectors, block_rows, largest, label)
    blocks = packed.blocks
    # Aliased, so that the two sides have columns of their own.
    content = [F.col(c).alias(c) for c in ("ids", "mat", "labels")]
    if tiles is None:
        number = blocks * (blocks + 1) // 2
        left = packed.rows.select(*content, F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("j"))
        right = packed.rows.select(*content, F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"))
    else:
        number = tiles.count()
        left = packed.rows.join(tiles, F.col("b") == F.col("i")).select(*content, F.col("i").alias("i"), F.col("j").alias("j"))
        right = packed.rows.join(tiles, F.col("b") == F.col("j")).select(*content, F.col("i").alias("i"), F.col("j").alias("j"))

    parts = tile_partitions(number)
    left, right = left.repartition(parts, "i", "j"), right.repartition(parts, "i", "j")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame()
        tile = Tile(a.iloc[0], b.iloc[0], key[0] == key[1], unit)
        tile.i, tile.j = key
        return kernel(tile)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)


def _best(values: np.ndarray, n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the n largest cells per row, ties to the lower column; cells below `floor` never."""
    width = values.shape[1]
    bar = np.partition(values, width - n, axis=1)[:, width - n, None] if n < width else np.full((len(values), 1), -np.inf)
    if floor is not None:
        bar = np.maximum(bar, floor)
    rows, cols = np.nonzero((values >= bar) & np.isfinite(values))
    order = np.lexsort((cols, -values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < n
    return rows[keep], cols[keep]


def _neighbour_schema(vectors: DataFrame, value: str) -> T.StructType:
    kind = vectors.schema["id"].dataType
    return T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField(value, T.DoubleType())])


def _concat(parts: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)


def cosine_topn(vectors: DataFrame, n: int, min_sim: float | None = None, block_rows: int | None = None) -> DataFrame:
    """(id, other, similarity, rank): the n most similar others of every vector with similarity >= min_sim."""
    if block_rows is None:
        # Imported here, as boxes build on this module.
        from tableloom.operators import boxes

        vectors = cut_lineage(vectors.select("id", "vec"))
        if boxes.suits(vectors):
            return boxes.cosine_topn(vectors, n, min_sim)
    packed = pack_blocks(vectors, block_rows, by_direction=True)
    bar = -np.inf if min_sim is None else min_sim
    kind = vectors.schema["id"].dataType
    schema = T.StructType([
        T.StructField("b", T.IntegerType()), T.StructField("floor", T.DoubleType()), T.StructField("id", T.ArrayType(kind)),
        T.StructField("other", T.ArrayType(kind)), T.StructField("similarity", T.ArrayType(T.DoubleType()))])

    def best_of(tile: Tile, sides: list[int]) -> tuple[list, list, list, float]:
        """The best of the tile, and the least N-th value that a vector found there."""
        found, floor = ([], [], []), np.inf
        for nth, (ids, x, others, y, _) in enumerate(tile.sides()):
            if nth not in sides:
                continue
            for start, chunk in _chunks(x, y):
                sims = _cosine(chunk, y)
                if tile.same:
                    sims[np.arange(len(chunk)), np.arange(start, start + len(chunk))] = -np.inf
                r, c = _best(sims, n, min_sim)
                # `_best` goes by rows and falls within them.
                last = np.full(len(chunk), bar)
                enough = np.bincount(r, minlength=len(chunk)) >= n
                ends = np.cumsum(np.bincount(r, minlength=len(chunk))) - 1
                last[enough] = sims[r[ends[enough]], c[ends[enough]]]
                floor = min(floor, last.min(initial=np.inf))
                for into, more in zip(found, (ids[start + r], others[c], sims[r, c])):
                    into.append(more)
        return *found, floor

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    if packed.summary is None:

        def everything(tile: Tile) -> pd.DataFrame:
            *found, _ = best_of(tile, [0, 1])
            return pd.DataFrame(dict(zip(("id", "other", "similarity"), map(np.concatenate, found))))

        local = over_tiles(vectors, everything, _neighbour_schema(vectors, "similarity"), packed=packed, unit=True)
        return local.withColumn("rank", rank).where(F.col("rank") <= n)

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                *found, floor = best_of(Tile(row, row, True, True), [0])
                yield pd.DataFrame({"b": [row["b"]], "floor": [floor], **{c: [np.concatenate(x).tolist()] for c, x in zip(("id", "other", "similarity"), found)}})

    own = cut_lineage(packed.rows.select("b", "ids", "mat", "labels").repartition(tile_partitions(packed.blocks), "b").mapInPandas(within, schema))
    # What every vector of a block has found at home.
    floors = np.full(packed.blocks, bar)
    for row in own.select("b", "floor").collect():
        floors[row["b"]] = row["floor"]
    slack = 10.0**-DIGITS
    summary = packed.summary
    tiles = tiles_of(packed, lambda b, low, high: high >= np.minimum(floors, floors[b]) - slack, same=False)

    def kernel(tile: Tile) -> pd.DataFrame:
        high = summary.bounds(tile.i)[1][tile.j]
        sides = [nth for nth, b in enumerate((tile.i, tile.j)) if high >= floors[b] - slack]
        *found, _ = best_of(tile, sides)
        return pd.DataFrame(dict(zip(("id", "other", "similarity"), map(np.concatenate, found))))

    local = over_tiles(vectors, kernel, _neighbour_schema(vectors, "similarity"), packed=packed, unit=True, tiles=tiles)
    local = local.unionByName(own.select(F.explode(F.arrays_zip("id", "other", "similarity")).alias("x")).select("x.*"))
    # At most n rows per id and block reach the window.
    return local.withColumn("rank", rank).where(F.col("rank") <= n)


def cosine_pairs(vectors: DataFrame, min_sim: float, block_rows: int | None = None) -> DataFrame:
    """(id_a < id_b, similarity) for all pairs at or above `min_sim`."""

    def kernel(tile: Tile) -> pd.DataFrame:
        parts = []
        for start, chunk in _chunks(tile.a, tile.b):
            sims = _cosine(chunk, tile.b)
            r, c = np.nonzero(sims >= min_sim)
            a, b = tile.ids_a[start + r], tile.ids_b[c]
            if tile.same:
                keep = a < b
                parts.append(pd.DataFrame({"id_a": a[keep], "id_b": b[keep], "similarity": sims[r, c][keep]}))
            else:
                flip = a > b
                parts.append(pd.DataFrame({"id_a": np.where(flip, b, a), "id_b": np.where(flip, a, b), "similarity": sims[r, c]}))
        return _concat(parts, ["id_a", "id_b", "similarity"])

    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("similarity", T.DoubleType())])
    # Every hit is a row of the answer, so tiles stay small.
    packed = pack_blocks(vectors, block_rows, PAIR_BLOCK, by_direction=True)
    tiles = tiles_of(packed, lambda _, low, high: high >= min_sim - 10.0**-DIGITS)
    return over_tiles(vectors, kernel, schema, unit=True, packed=packed, tiles=tiles)


# Bucket k holds the similarities in (0.001 (k - 1), 0.001 k].
BUCKETS = 1000


def _buckets(cells: np.ndarray) -> np.ndarray:
    """The bucket of each similarity, which counts in full but for the noise of its last digits."""
    # Whole steps of the last digit; half a step off, so that the end of a bucket stays inside it.
    steps = cells * 10.0**DIGITS
    steps += 10.0**-3
    np.rint(steps, out=steps)
    steps -= 0.5
    steps *= BUCKETS / 10.0**DIGITS
    return np.ceil(steps, out=steps).astype(np.int32)


def cosine_buckets(vectors: DataFrame, packed: Packed | None = None) -> DataFrame:
    """(bucket, n, total) over the full symmetric matrix, diagonal included: cells and sum of similarities per bucket."""
    edge = BUCKETS + 1

    def kernel(tile: Tile) -> pd.DataFrame:
        n, total = np.zeros(2 * edge + 1, dtype=np.int64), np.zeros(2 * edge + 1)
        for _, chunk in _chunks(tile.a, tile.b):
            cells = (chunk @ tile.b.T).ravel()
            place = _buckets(cells) + edge
            n += np.bincount(place, minlength=len(n))
            total += np.bincount(place, weights=cells, minlength=len(n))
        found = np.nonzero(n)[0]
        # A block with itself is the full square already; two different blocks stand for two squares.
        times = 1 if tile.same else 2
        return pd.DataFrame({"bucket": found - edge, "n": n[found] * times, "total": total[found] * times})

    tiles = over_tiles(vectors, kernel, "bucket long, n long, total double", unit=True, packed=packed)
    return tiles.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def cosine_values(vectors: DataFrame, buckets: list[int], packed: Packed | None = None) -> DataFrame:
    """(bucket, step, n) of the cells inside the named buckets, by steps of the sixth digit; pairs of blocks without such cells do not meet."""
    edge = BUCKETS + 1
    wanted = np.zeros(2 * edge + 1, dtype=bool)
    wanted[np.array(buckets, dtype=int) + edge] = True

    def kernel(tile: Tile) -> pd.DataFrame:
        parts = []
        for _, chunk in _chunks(tile.a, tile.b):
            cells = (chunk @ tile.b.T).ravel()
            place = _buckets(cells)
            inside = wanted[place + edge]
            steps = np.rint((cells[inside] + 10.0 ** -(STEP_DIGITS + 3)) * 10.0**STEP_DIGITS).astype(np.int64)
            both, n = np.unique(place[inside].astype(np.int64) * (4 * 10**STEP_DIGITS) + steps + 2 * 10**STEP_DIGITS, return_counts=True)
            parts.append(pd.DataFrame({"bucket": both // (4 * 10**STEP_DIGITS), "step": both % (4 * 10**STEP_DIGITS) - 2 * 10**STEP_DIGITS, "n": n}))
        found = _concat(parts, ["bucket", "step", "n"]).groupby(["bucket", "step"], as_index=False)["n"].sum()
        found["n"] *= 1 if tile.same else 2
        return found

    packed = packed or pack_blocks(vectors, by_direction=True)
    ends = np.array(sorted(buckets)) / BUCKETS
    slack = 10.0**-DIGITS

    def holds(_: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        # The first bucket that ends above the least similarity must begin below the largest.
        at = np.searchsorted(ends, low - slack)
        return (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] - 1 / BUCKETS <= high + slack)

    tiles = over_tiles(vectors, kernel, "bucket long, step long, n long", unit=True, packed=packed, tiles=tiles_of(packed, holds))
    return tiles.groupBy("bucket", "step").agg(F.sum("n").alias("n"))


def cosine_counts(vectors: DataFrame, min_sim: float, block_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """(id, n): how many vectors, itself included, reach `min_sim`; where more than `at_most` are not told apart, no more need be counted."""
    if block_rows is None:
        from tableloom.operators import boxes

        vectors = cut_lineage(vectors.select("id", "vec"))
        if boxes.suits(vectors):
            return boxes.cosine_counts(vectors, min_sim, at_most)
    packed = pack_blocks(vectors, block_rows, by_direction=True)
    summary, slack = packed.summary, 10.0**-DIGITS

    def kernel(tile: Tile) -> pd.DataFrame:
        parts = []
        for nth, (ids, x, _, y, _) in enumerate(tile.sides()):
            hits = np.concatenate([(_cosine(chunk, y) >= min_sim).sum(axis=1) for _, chunk in _chunks(x, y)]).astype("int64")
            if tile.same and summary:
                # Blocks all of whose vectors are near enough count as they are.
                low = summary.bounds(tile.i)[0]
                low[tile.i] = -np.inf
                hits += summary.rows[low >= min_sim + slack].sum()
            parts.append(pd.DataFrame({"id": ids, "n": hits}))
        return _concat(parts, ["id", "n"])

    def undecided(b: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        open_ = (high >= min_sim - slack) & (low < min_sim + slack)
        open_[b] = True
        return open_

    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("n", T.LongType())])
    tiles = over_tiles(vectors, kernel, schema, unit=True, packed=packed, tiles=tiles_of(packed, undecided))
    return tiles.groupBy("id").agg(F.sum("n").alias("n"))


def cosine_counts_of(vectors: DataFrame, asked: DataFrame, min_sim: float) -> DataFrame:
    """(id, n) as `cosine_counts`, for the few vectors `asked` (id, vec) alone: every task is told these, and all others pass by once."""
    rows = asked.select("id", "vec").collect()
    if not rows:
        return asked.select("id", F.lit(0).cast("bigint").alias("n"))
    wanted = _unit(np.array([r["vec"] for r in rows], dtype=np.float64))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(wanted), dtype=np.int64)
        for part in parts:
            if len(part):
                n += (_cosine(wanted, _unit(np.stack(part["vec"].to_numpy()).astype(np.float64))) >= min_sim).sum(axis=1)
        yield pd.DataFrame({"place": np.arange(len(n), dtype=np.int32), "n": n})

    counts = vectors.select("vec").mapInPandas(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    names = vectors.sparkSession.createDataFrame([(r["id"], i) for i, r in enumerate(rows)], T.StructType([asked.schema["id"], T.StructField("place", T.IntegerType())]))
    return names.join(counts, "place").select("id", "n")


def nearest_distances(vectors: DataFrame, k: int = 1, block_rows: int | None = None) -> DataFrame:
    """(id, distance): Euclidean distance of every vector to its k-th nearest other."""

    def kernel(tile: Tile) -> pd.DataFrame:
        parts = []
        for ids, x, _, y, _ in tile.sides():
            for start, chunk in _chunks(x, y):
                dist = _distance(chunk, y)
                if tile.same:
                    dist[np.arange(len(chunk)), np.arange(start, start + len(chunk))] = np.inf
                m = min(k, dist.shape[1])
                near = np.partition(dist, m - 1, axis=1)[:, :m]
                parts.append(pd.DataFrame({"id": np.repeat(ids[start:start + len(chunk)], m), "distance": near.ravel()}))
        found = _concat(parts, ["id", "distance"])
        return found[np.isfinite(found["distance"])]

    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    local = over_tiles(vectors, kernel, schema, block_rows)
    if k == 1:
        return local.groupBy("id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance"))
    return local.withColumn("rk", rank).where(F.col("rk") == k).select("id", "distance")


def cluster_distances(vectors: DataFrame, label: str, block_rows: int | None = None) -> DataFrame:
    """(id, label, total, n): sum of distances from every vector to the members of every cluster, itself included."""

    def kernel(tile: Tile) -> pd.DataFrame:
        parts = []
        for ids, x, _, y, labels in tile.sides():
            names, codes = np.unique(labels, return_inverse=True)
            member = np.zeros((len(y), len(names)))
            member[np.arange(len(y)), codes] = 1
            total = np.concatenate([_distance(chunk, y) @ member for _, chunk in _chunks(x, y)])
            parts.append(pd.DataFrame({
                "id": np.repeat(ids, len(names)), "label": np.tile(names, len(ids)),
                "total": total.ravel(), "n": np.tile(member.sum(axis=0).astype("int64"), len(ids)),
            }))
        return _concat(parts, ["id", "label", "total", "n"])

    schema = T.StructType([
        T.StructField("id", vectors.schema["id"].dataType), T.StructField("label", T.LongType()),
        T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()),
    ])
    tiles = over_tiles(vectors, kernel, schema, block_rows, label=label)
    return tiles.groupBy("id", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
