"""Whitening of integer vectors by their leading components, which FEAST finds.

Spark keeps each distinct vector once, adds up their exact sums and then the products of what is centred. What is left is
a symmetric matrix of the dimension, whatever the number of rows. Counts of inertia (how many eigenvalues lie above a shift)
bracket the wanted eigenvalues and put the ends of intervals into gaps between them. For every interval a contour integral of
the shifted inverse projects a few vectors onto its eigenvectors: each quadrature node is one complex solve, and tasks
of Spark do the solves of all nodes and intervals. Rayleigh-Ritz takes eigenpairs from the projection, which is repeated until
their residuals are those of double precision. An interval counts as done only when it gave as many eigenvalues as
the inertia of its ends says that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableloom.llm.common import col
from tableloom.session import cut_lineage

NODES = 8
# An interval ends at the first wide enough gap after so many eigenvalues.
PER_INTERVAL = 3
# Eigenvalues nearer to each other than this share of the largest are in one interval.
GAP = 1e-3
ROUNDS = 40
RESIDUAL = 2e-15
# Eigenvalues below this share of the largest are no components: what they measure is rounding.
LEAST_SHARE = 1e-12
LONG = 1 << 63


class Interval(NamedTuple):
    low: float
    high: float
    count: int


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, x array<bigint>) of the usable rows, x = floor(scale * c), and the dimension."""
    vec = col(vec_col)
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LONG))
    rows = df.where(vec.isNotNull() & F.forall(vec, sound)).select(col(id_col).alias("id"), F.transform(vec, lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    return rows.where(F.size("x") == d), d


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _tasks(df: DataFrame) -> DataFrame:
    """No more tasks than keep the cores busy, as each sends on a matrix."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, as integers."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for part in parts:
            x = _matrix(part.column("x"), d)
            if len(x):
                wide = max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= LONG
                n, total = n + len(x), total + (x.astype(object) if wide else x).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d + 1), pa.int32()), "s": pa.array([Decimal(int(v)) for v in (*total, n)], pa.decimal128(38, 0))})

    found = fit.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    *sums, n = [int(r["s"]) for r in found] or [0]
    return n, sums


def covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance matrix with divisor n; every vector is centred before it is multiplied."""
    d = len(mean)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for part in parts:
            x = _matrix(part.column("x"), d).astype(np.float64) - mean
            total += x.T @ x
        for i in range(d):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i] * d, pa.int32()), "j": pa.array(range(d), pa.int32()), "v": total[i]})

    found = _tasks(fit).mapInArrow(add, "i int, j int, v double").where("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros((d, d))
    v[found["i"], found["j"]] = v[found["j"], found["i"]] = found["v"] / n
    return v


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix congruent to `v` by reflections, so with its inertia at every shift."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = u @ u
        if size > 0:
            p = 2 / size * (a[k + 1:, k + 1:] @ u)
            w = p - (u @ p) / size * u
            a[k + 1:, k + 1:] -= np.outer(u, w) + np.outer(w, u)
            a[k + 1:, k] -= 2 / size * (u @ a[k + 1:, k]) * u
            a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(shifts: np.ndarray, diagonal: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each shift: the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for a, b in zip(diagonal[1:], squares):
        pivot = a - shifts - b / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def intervals(diagonal: np.ndarray, squares: np.ndarray, k: int) -> list[Interval]:
    """Intervals from the top down that together hold the k largest eigenvalues, with ends in gaps and the number that each holds."""
    d = len(diagonal)
    off = np.sqrt(squares)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    top, bottom = float((diagonal + reach).max()), float((diagonal - reach).min())
    pad = GAP * max(abs(top), abs(bottom))
    wanted = k
    while True:
        # Bracket the `wanted` largest and the next one by bisection, all at once.
        number = np.arange(1, min(d, wanted + 1) + 1)
        low, high = np.full(len(number), bottom - pad), np.full(len(number), top + pad)
        while (high - low).max() > pad / 4:
            middle = (low + high) / 2
            reached = above(middle, diagonal, squares) >= number
            low, high = np.where(reached, middle, low), np.where(reached, high, middle)
        gaps = low[:-1] - high[1:]
        if len(number) < wanted + 1 or gaps[wanted - 1] > pad or wanted >= d:
            break
        wanted = min(d, 2 * wanted)
    found, upper, held = [], top + pad, 0
    for i in range(len(number)):
        held += 1
        last = i == d - 1
        if last or (i < len(gaps) and gaps[i] > pad and (held >= PER_INTERVAL or i + 1 >= k)):
            edge = bottom - pad if last else float((low[i] + high[i + 1]) / 2)
            found.append(Interval(edge, upper, held))
            upper, held = edge, 0
            if i + 1 >= k:
                break
    return found


def feast(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix."""
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max())
    if k < 1 or size == 0:
        return np.zeros(0), np.zeros((d, 0))
    shape = tridiagonal(v)
    todo = dict(enumerate(intervals(*shape, k)))
    random = np.random.default_rng(0)
    width = {i: min(d, part.count + part.count // 2 + 3) for i, part in todo.items()}
    start = {i: random.standard_normal((d, width[i])) for i in todo}
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + x))
    matrix = spark.sparkContext.broadcast(v)
    best = dict.fromkeys(todo, np.inf)
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    try:
        for _ in range(ROUNDS):
            held = spark.sparkContext.broadcast(start)

            def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for row in part.itertuples():
                        y, around = held.value[row.part], row.radius * complex(row.re, row.im)  # noqa: B023
                        q = np.linalg.solve((row.centre + around) * np.eye(d) - matrix.value, y.astype(complex))
                        yield pd.DataFrame({"part": [row.part], "q": [(row.weight / 2 * (around * q).real).tobytes()]})

            nodes = [
                (i, (part.low + part.high) / 2, (part.high - part.low) / 2, float(t.real), float(t.imag), float(w))
                for i, part in todo.items() if i not in done for t, w in zip(turn, weight)]
            frame = spark.createDataFrame(nodes, "part int, centre double, radius double, re double, im double, weight double")
            sums = {i: np.zeros((d, width[i])) for i in todo if i not in done}
            for row in frame.repartition(len(nodes)).mapInPandas(solve, "part int, q binary").collect():
                sums[row["part"]] += np.frombuffer(row["q"]).reshape(d, -1)
            held.unpersist()
            for i, q in sums.items():
                part = todo[i]
                basis, strength, _ = np.linalg.svd(q, full_matrices=False)
                basis = basis[:, strength > 1e-14 * strength[0]]
                values, small = np.linalg.eigh(basis.T @ v @ basis)
                vectors = basis @ small
                inside = (values > part.low) & (values <= part.high)
                residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0) / size
                if inside.sum() == part.count and (residual <= RESIDUAL or (residual <= 1e-13 and residual > best[i] / 2)):
                    done[i] = values[inside], vectors[:, inside]
                    continue
                best[i] = residual if inside.sum() == part.count else np.inf
                more = random.standard_normal((d, width[i] - vectors.shape[1]))
                start[i] = np.hstack([vectors, more])
            if len(done) == len(todo):
                break
        else:
            raise ArithmeticError("an interval did not give as many eigenvalues as its inertia counts")
    finally:
        matrix.unpersist()
    values = np.concatenate([done[i][0] for i in done])
    vectors = np.hstack([done[i][1] for i in done])
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    # Either sign would do; the largest entry is positive.
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def identity_error(fit: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    d, k = axes.shape

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, centre, spread = 0, np.zeros(k), np.zeros((k, k))
        for part in parts:
            y = (_matrix(part.column("x"), d).astype(np.float64) - mean) @ axes
            if len(y):
                n, centre, spread = _merged((n, centre, spread), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        yield pa.RecordBatch.from_pydict({"n": [n], "centre": [centre.tolist()], "spread": [spread.ravel().tolist()]})

    # One small row per task.
    total = (0, np.zeros(k), np.zeros((k, k)))
    for row in _tasks(fit).mapInArrow(measure, "n bigint, centre array<double>, spread array<double>").where("n > 0").collect():
        total = _merged(total, (row["n"], np.array(row["centre"]), np.array(row["spread"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _merged(one: tuple, other: tuple) -> tuple:
    """Count, mean and sum of centred products of two sets together."""
    n = one[0] + other[0]
    apart = other[1] - one[1]
    return n, one[1] + apart * (other[0] / n), one[2] + other[2] + np.outer(apart, apart) * (one[0] * other[0] / n)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable row and each of the leading components.

    Vectors become floor(scale * c). The components are those of the distinct vectors, `n` of them, by falling eigenvalue e
    from 1: `whitened` is the centred vector on the component over sqrt(e), `explained` its share of all variance,
    `deviation` the exact sum of squares of n * x - S, S the sums of the distinct vectors (decimal(38, 0)).
    Rows take no part whose vector is null, or has an entry that is null, not finite or beyond a long when scaled, or is of
    another length than most (of equally frequent lengths the larger counts). Repeated rows and null ids stay. There are no
    more components than dimensions, and none without variance: a table with one distinct vector gives no rows, as does an
    empty one. Other columns are not looked at. The driver holds matrices of the dimension squared, and of the rows nothing.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows, d = integer_vectors(df, id_col, vec_col, scale)
    n = 0
    if d:
        # Equal vectors, however many, are one row before they move.
        fit = cut_lineage(rows.select("x").distinct())
        n, sums = exact_sums(fit, d)
    if n:
        mean = np.array([s / n for s in sums])
        v = covariance(fit, n, mean)
        values, vectors = feast(spark, v, min(components, d))
        kept = values > LEAST_SHARE * values.max(initial=0)
        values, vectors = values[kept], vectors[:, kept]
    if not n or not len(values):
        return rows.limit(0).select(
            "id", F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    axes = vectors / np.sqrt(values)
    error = identity_error(fit, mean, axes)

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("x"), d)
            y = (x.astype(np.float64) - mean) @ axes
            reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
            if reach * reach * d < LONG:
                away = n * x - np.array(sums, dtype=np.int64)
                deviation = pa.array((away * away).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                away = n * x.astype(object) - np.array(sums, dtype=object)
                deviation = pa.array([Decimal(int(s)) for s in (away * away).sum(axis=1)], pa.decimal128(38, 0))
            spots = pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("id"), deviation, pa.ListArray.from_arrays(spots, pa.array(y.ravel()))], ["id", "deviation", "whitened"])

    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    found = rows.mapInArrow(project, schema).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"))
