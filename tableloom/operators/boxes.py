"""Cosines of all against all for many vectors of few dimensions, by boxes.

Equal vectors become one with a weight. The others are dealt to boxes of about as many vectors each, by cuts along single
axes of their directions. A box knows the least and largest coordinate of its vectors, which bounds the similarity of any
vector with all of them. Each vector is compared within its own box first, and then asks those other boxes only that can
still change its answer: its N-th similarity, or the count that it has reached, is known by then. Counts over the whole
matrix meet box by box, and a limit that the bounds decide for two boxes is not looked at there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.operators.pairwise import DIGITS, STEP_DIGITS, _best, _unit, quoted, tile_partitions
from tableloom.session import cut_lineage

# Vectors of so few dimensions, and so many of them, go by boxes.
DIMENSIONS = 8
MANY = 20_000
# Vectors in a box, and the most boxes; beyond that boxes grow.
BOX, MOST_BOXES = 1024, 2048
# A box with so many times as many vectors, as happens where they are nearly equal, is cut by a hash of their ids.
CROWDED = 4
# Vectors per box in the sample that decides on the cuts, which no answer depends on.
SAMPLE = 32
# Cells worked on at once.
CELLS = 250_000
# Vectors that may ask one box from one task.
ASKING = 1_000_000
# What rounding may do to a bound.
SLACK = 1e-11


@dataclass(frozen=True)
class Cuts:
    """Where the space is cut: per node the axis (-1 at a leaf), the value from which on vectors go right, and both children; a leaf's `left` is its number."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            axis = self.axis[at]
            inner = np.nonzero(axis >= 0)[0]
            if not len(inner):
                return self.left[at]
            node = at[inner]
            right = x[inner, axis[inner]] >= self.value[node]
            at[inner] = np.where(right, self.right[node], self.left[node])


def cuts_of(sample: np.ndarray, leaves: int) -> Cuts:
    """Cuts at medians of the sample along its widest axis, until there are so many leaves."""
    axis, value, left, right, count = [], [], [], [], 0
    # (node, rows of the sample, leaves wanted below)
    todo = [(0, sample, leaves)]
    axis.append(-1), value.append(0.0), left.append(0), right.append(0)
    while todo:
        node, rows, wanted = todo.pop()
        widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) > 1 else -1
        if wanted < 2 or widest < 0 or rows[:, widest].min() == rows[:, widest].max():
            left[node], count = count, count + 1
            continue
        column, half = np.sort(rows[:, widest]), wanted // 2
        cut = column[len(column) * half // wanted]
        if cut == column[0]:
            cut = column[np.searchsorted(column, cut, side="right")]
        beyond = rows[:, widest] >= cut
        axis[node], value[node], left[node], right[node] = widest, cut, len(axis), len(axis) + 1
        for part, share in ((rows[~beyond], half), (rows[beyond], wanted - half)):
            todo.append((len(axis), part, share))
            axis.append(-1), value.append(0.0), left.append(0), right.append(0)
    return Cuts(np.array(axis), np.array(value), np.array(left), np.array(right))


def suits(vectors: DataFrame) -> bool:
    """Whether there are enough of the vectors (id, vec), a written table, and few enough dimensions."""
    rows, least, most = vectors.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    return rows >= MANY and 0 < least == most <= DIMENSIONS


def merged(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vector once as (id, vec, weight) with the smallest of its ids, and the members (id, vector) of each; ids are given once each."""
    rows = vectors.select("id", F.transform("vec", lambda x: x + 0.0).alias("vec"))
    heads = cut_lineage(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "vec", "weight"))
    members = rows.join(heads.select(F.col("id").alias("vector"), "vec"), "vec").select("id", "vector")
    return heads, members


@dataclass(frozen=True)
class Boxes:
    """A row per box (b, ids, mat, weights, ...), and their least and largest coordinates, numbers of vectors and weights."""

    rows: DataFrame
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    weight: np.ndarray

    def near(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """No less than the similarity of each of `x` with all vectors of the boxes."""
        gap = np.zeros((len(x), len(which)))
        for k in range(x.shape[1]):
            at = x[:, k, None]
            gap += np.maximum(np.maximum(self.low[which, k] - at, at - self.high[which, k]), 0) ** 2
        # Two unit vectors; one of length zero has similarity zero with all, and a box may hold some.
        bound = 1 - gap / 2
        bound[:, self.hollow[which]] = np.maximum(bound[:, self.hollow[which]], 0)
        bound[~x.any(axis=1)] = 0
        return bound + SLACK

    def far(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """No more than that."""
        gap = np.zeros((len(x), len(which)))
        for k in range(x.shape[1]):
            at = x[:, k, None]
            gap += np.maximum(np.abs(self.low[which, k] - at), np.abs(self.high[which, k] - at)) ** 2
        bound = 1 - gap / 2
        bound[:, self.hollow[which]] = np.minimum(bound[:, self.hollow[which]], 0)
        bound[~x.any(axis=1)] = 0
        return bound - SLACK

    @property
    def hollow(self) -> np.ndarray:
        """Boxes that hold the origin and so may hold vectors of length zero."""
        return ((self.low <= 0) & (self.high >= 0)).all(axis=1)

    def between(self, b: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest similarity that vectors of box `b` may have with those of the others."""
        least = np.maximum(np.maximum(self.low[others] - self.high[b], self.low[b] - self.high[others]), 0)
        most = np.maximum(self.high[others] - self.low[b], self.high[b] - self.low[others])
        low, high = 1 - (most**2).sum(axis=1) / 2 - SLACK, 1 - (least**2).sum(axis=1) / 2 + SLACK
        hollow = self.hollow
        zero = hollow[others] | hollow[b]
        return np.where(zero, np.minimum(low, -SLACK), low), np.where(zero, np.maximum(high, SLACK), high)


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(row["ids"])
    return ids, np.frombuffer(row["mat"], dtype=np.float64).reshape(len(ids), -1), np.frombuffer(row["weights"], dtype=np.int64)


def in_boxes(vectors: DataFrame, n: int, within=None, columns: Sequence[T.StructField] = (), box: int | None = None) -> Boxes:
    """Deal `n` vectors (id, vec, weight) into boxes; `within` works out more columns of a box from its ids, unit vectors and weights."""
    size = box or max(BOX, -(-n // MOST_BOXES))
    leaves = -(-n // size)
    share = -(-n // (SAMPLE * leaves))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit("cut")), F.lit(share)) == 0).select("vec").limit(2 * SAMPLE * leaves).toPandas()["vec"]
    width = len(vectors.first()["vec"])
    sample = _unit(np.array([list(v) for v in sample], dtype=np.float64).reshape(-1, width))
    cuts = cuts_of(sample, leaves)

    def placed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = _unit(np.stack(part.to_numpy()).astype(np.float64)) if len(part) else np.zeros((0, width))
            yield pd.Series(cuts.leaf(x).astype(np.int32))

    rows = vectors.withColumn("leaf", F.pandas_udf(placed, "int")("vec"))
    rows = cut_lineage(rows)
    table, first = [], 0
    for r in rows.groupBy("leaf").count().orderBy("leaf").collect():
        parts = -(-r["count"] // (CROWDED * size)) if r["count"] > CROWDED * size else 1
        table.append((r["leaf"], first, parts))
        first += parts
    spark = vectors.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(table, "leaf int, first int, parts int")), "leaf")
    rows = rows.select("id", "vec", "weight", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("b"))
    kind = vectors.schema["id"].dataType
    schema = T.StructType([
        T.StructField("b", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("mat", T.BinaryType()),
        T.StructField("weights", T.BinaryType()), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("weight", T.LongType()), *columns])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]]))
        ids, weights = pdf["id"].to_numpy(), pdf["weight"].to_numpy(dtype=np.int64)
        more = within(ids, x, weights) if within else {}
        return pd.DataFrame({
            "b": [key[0]], "ids": [ids.tolist()], "mat": [x.tobytes()], "weights": [weights.tobytes()], "low": [x.min(axis=0).tolist()],
            "high": [x.max(axis=0).tolist()], "weight": [weights.sum()], **{c: [v] for c, v in more.items()}})

    # Named, so that few heavy boxes do not share a task.
    spread = rows.repartition(tile_partitions(first), "b")
    rows = cut_lineage(spread.groupBy("b").applyInPandas(pack, schema))
    known = rows.select("b", "low", "high", F.size("ids").alias("n"), "weight").toPandas()
    low, high, count, weight = np.full((first, width), np.inf), np.full((first, width), -np.inf), np.zeros(first, dtype=np.int64), np.zeros(first, dtype=np.int64)
    places = known["b"].to_numpy()
    low[places], high[places] = np.stack(known["low"].to_numpy()), np.stack(known["high"].to_numpy())
    count[places], weight[places] = known["n"], known["weight"]
    return Boxes(rows.drop("low", "high", "weight"), low, high, count, weight)


def _chunks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _asked(boxes: Boxes, schema: T.StructType, ask, answer, answers: T.StructType | str) -> DataFrame:
    """What the boxes answer: `ask` gives of a box's row, and for each other box, the places of the vectors that ask it and columns about them."""
    rows, groups = boxes.rows, -(-int(boxes.size.sum()) // ASKING)

    def asking(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(schema.names, (t, key[0] % groups, *rest))) for t, *rest in ask(pdf.iloc[0])], columns=schema.names)

    def met(key: tuple, questions: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or box.empty:
            return pd.DataFrame()
        return answer(questions, box.iloc[0])

    parts = tile_partitions(len(boxes.size))
    questions = rows.repartition(parts, "b").groupBy("b").applyInPandas(asking, schema)
    ends = rows.select("ids", "mat", "weights", F.col("b").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    questions, ends = questions.repartition(parts, "t", "g"), ends.repartition(parts, "t", "g")
    return questions.groupBy("t", "g").cogroup(ends.groupBy("t", "g")).applyInPandas(met, answers)


def _questions(kind: T.DataType, *more: str) -> T.StructType:
    return T.StructType([
        T.StructField("t", T.IntegerType()), T.StructField("g", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("mat", T.BinaryType()), *[T.StructField(c, T.BinaryType()) for c in more]])


def _joined(questions: pd.DataFrame, width: int, *more: tuple[str, type]) -> tuple:
    ids = np.concatenate([np.asarray(i) for i in questions["ids"]])
    x = np.concatenate([np.frombuffer(m, dtype=np.float64) for m in questions["mat"]]).reshape(len(ids), width)
    return ids, x, *[np.concatenate([np.frombuffer(m, dtype=t) for m in questions[c]]) for c, t in more]


def topn(vectors: DataFrame, heads: int, n: int, min_sim: float | None, box: int | None = None) -> DataFrame:
    """(id, other, similarity) of `heads` vectors (id, vec, weight), each once: among them the n most similar others of each, and maybe some more."""
    kind = vectors.schema["id"].dataType
    bar = -np.inf if min_sim is None else min_sim

    def within(ids: np.ndarray, x: np.ndarray, weights: np.ndarray) -> dict:
        floors, found = np.full(len(x), bar), ([], [], [])
        for part in _chunks(len(x), len(x)):
            sims = quoted(x[part] @ x.T)
            sims[np.arange(len(sims)), np.arange(part.start, part.start + len(sims))] = -np.inf
            r, c = _best(sims, n, min_sim)
            times = np.bincount(r, minlength=len(sims))
            last = np.cumsum(times) - 1
            full = np.nonzero(times >= n)[0]
            floors[part.start + full] = sims[r[last[full]], c[last[full]]]
            for into, more in zip(found, (part.start + r, c, sims[r, c])):
                into.append(more)
        one, other, similarity = map(np.concatenate, found)
        return {"floors": floors.tobytes(), "one": ids[one].tolist(), "other": ids[other].tolist(), "similarity": similarity.tolist()}

    boxes = in_boxes(vectors, heads, within, [
        T.StructField("floors", T.BinaryType()), T.StructField("one", T.ArrayType(kind)), T.StructField("other", T.ArrayType(kind)),
        T.StructField("similarity", T.ArrayType(T.DoubleType()))], box)
    known = Boxes(boxes.rows.select("b", "ids", "mat", "weights", "floors"), boxes.low, boxes.high, boxes.size, boxes.weight)
    bounds = Boxes(None, boxes.low, boxes.high, boxes.size, boxes.weight)

    def ask(row: pd.Series) -> Iterator[tuple]:
        (ids, x, _), floors = _opened(row), np.frombuffer(row["floors"], dtype=np.float64)
        everyone = np.arange(len(bounds.size))
        _, high = bounds.between(row["b"], everyone)
        which = everyone[(high >= floors.min()) & (everyone != row["b"])]
        wanted = np.concatenate([bounds.near(x[part], which) >= floors[part, None] for part in _chunks(len(x), len(which))])
        for at, t in enumerate(which):
            places = np.nonzero(wanted[:, at])[0]
            if len(places):
                yield int(t), ids[places].tolist(), x[places].tobytes(), floors[places].tobytes()

    def answer(questions: pd.DataFrame, box: pd.Series) -> pd.DataFrame:
        others, y, _ = _opened(box)
        ids, x, floors = _joined(questions, y.shape[1], ("floors", np.float64))
        found = ([], [], [])
        for part in _chunks(len(x), len(y)):
            sims = x[part] @ y.T
            r, c = np.nonzero(sims >= floors[part, None] - SLACK)
            values = quoted(sims[r, c])
            good = values >= floors[part][r]
            r, c, values = r[good], c[good], values[good]
            # The vectors of a box lie by their ids.
            order = np.lexsort((c, -values, r))
            r, c, values = r[order], c[order], values[order]
            first = np.arange(len(r)) - np.searchsorted(r, r, side="left") < n
            for into, more in zip(found, (ids[part][r[first]], others[c[first]], values[first])):
                into.append(more)
        return pd.DataFrame(dict(zip(("id", "other", "similarity"), map(np.concatenate, found))))

    schema = T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField("similarity", T.DoubleType())])
    away = _asked(known, _questions(kind, "floors"), ask, answer, schema)
    home = boxes.rows.select(F.explode(F.arrays_zip(F.col("one").alias("id"), "other", "similarity")).alias("x")).select("x.id", "x.other", "x.similarity")
    return home.unionByName(away)


def cosine_topn(vectors: DataFrame, n: int, min_sim: float | None = None, box: int | None = None) -> DataFrame:
    """(id, other, similarity, rank): as `pairwise.cosine_topn`. Of equal vectors only the n + 1 smallest ids can be an answer."""
    merged_rows, members = merged(vectors)
    heads, rows = merged_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "other"))
    found = topn(merged_rows, heads, n, min_sim, box)
    if heads == rows:
        return found.withColumn("rank", best("id")).where(F.col("rank") <= n)
    members = cut_lineage(members)
    shown = members.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= n + 1)
    shown = cut_lineage(shown.select(F.col("vector").alias("near"), F.col("id").alias("other")))
    zero = F.forall("vec", lambda x: x == 0)
    itself = merged_rows.where("weight > 1").select("id", F.col("id").alias("near"), F.when(zero, 0.0).otherwise(1.0).alias("similarity"))
    if min_sim is not None:
        itself = itself.where(F.col("similarity") >= min_sim)
    # The n + 1 best of each vector are enough for each of its members, whichever of them it is itself.
    near = found.select("id", F.col("other").alias("near"), "similarity").withColumn("nth", F.row_number().over(
        Window.partitionBy("id").orderBy(F.col("similarity").desc(), "near"))).where(F.col("nth") <= n).select("id", "near", "similarity")
    offered = near.unionByName(itself).join(shown, "near").select(F.col("id").alias("vector"), "other", "similarity")
    offered = cut_lineage(offered.withColumn("nth", best("vector")).where(F.col("nth") <= n + 1).select("vector", "other", "similarity"))
    answers = members.join(offered, "vector").where(F.col("id") != F.col("other")).select("id", "other", "similarity")
    return answers.withColumn("rank", best("id")).where(F.col("rank") <= n)


def cosine_counts(vectors: DataFrame, min_sim: float, at_most: int | None = None, box: int | None = None) -> DataFrame:
    """(id, n): as `pairwise.cosine_counts`; with `at_most`, counts from there on may be smaller than they are, but not below it."""
    merged_rows, members = merged(vectors)
    heads = merged_rows.count()
    kind = vectors.schema["id"].dataType
    enough = np.iinfo(np.int64).max if at_most is None else at_most

    def within(ids: np.ndarray, x: np.ndarray, weights: np.ndarray) -> dict:
        return {"hits": np.concatenate([(quoted(x[part] @ x.T) >= min_sim) @ weights for part in _chunks(len(x), len(x))]).tobytes()}

    boxes = in_boxes(merged_rows, heads, within, [T.StructField("hits", T.BinaryType())], box)
    bounds = Boxes(None, boxes.low, boxes.high, boxes.size, boxes.weight)

    def sure(row: pd.Series) -> tuple:
        """What a box counts itself, boxes wholly near enough included, and which boxes remain to be asked."""
        (ids, x, _), hits = _opened(row), np.frombuffer(row["hits"], dtype=np.int64).copy()
        everyone = np.arange(len(bounds.size))
        low, high = bounds.between(row["b"], everyone)
        others = everyone != row["b"]
        hits += bounds.weight[others & (low >= min_sim)].sum()
        which = everyone[others & (low < min_sim) & (high >= min_sim)]
        asks = np.zeros((len(x), len(which)), dtype=bool)
        if (hits < enough).any():
            for part in _chunks(len(x), len(which)):
                inside = bounds.far(x[part], which) >= min_sim
                hits[part] += inside @ bounds.weight[which]
                asks[part] = (bounds.near(x[part], which) >= min_sim) & ~inside
            asks[hits >= enough] = False
        return ids, x, hits, which, asks

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, hits, _, _ = sure(pdf.iloc[0])
        return pd.DataFrame({"id": ids, "n": hits})

    def ask(row: pd.Series) -> Iterator[tuple]:
        ids, x, _, which, asks = sure(row)
        for at, t in enumerate(which):
            places = np.nonzero(asks[:, at])[0]
            if len(places):
                yield int(t), ids[places].tolist(), x[places].tobytes()

    def answer(questions: pd.DataFrame, box: pd.Series) -> pd.DataFrame:
        _, y, weights = _opened(box)
        ids, x = _joined(questions, y.shape[1])
        return pd.DataFrame({"id": ids, "n": np.concatenate([(quoted(x[part] @ y.T) >= min_sim) @ weights for part in _chunks(len(x), len(y))])})

    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())])
    first = boxes.rows.repartition(tile_partitions(len(boxes.size)), "b").groupBy("b").applyInPandas(own, schema)
    known = Boxes(boxes.rows, boxes.low, boxes.high, boxes.size, boxes.weight)
    away = _asked(known, _questions(kind), ask, answer, schema)
    counts = first.unionByName(away).groupBy("id").agg(F.sum("n").alias("n"))
    return members.join(counts.withColumnRenamed("id", "vector"), "vector").select("id", "n")


# Steps of the sixth digit from 0 to 1.
STEPS = 10**STEP_DIGITS
# Vectors that guess where a quantile lies, and how far to both sides of it, as a share of all, it is sought first.
GUESSED, AROUND = 4096, 0.01


def _step(x: np.ndarray) -> np.ndarray:
    return np.rint((x + 10.0 ** -(STEP_DIGITS + 3)) * STEPS).astype(np.int64)


def _least(holds, near: float) -> float:
    """The least number close to `near` for which `holds`, which then holds for all larger ones."""
    low, high = near - 1e-8, near + 1e-8
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (low, middle) if holds(np.array([middle]))[0] else (middle, high)
    return high


def _cut_of_step(step: int) -> float:
    return _least(lambda x: _step(x) >= step, (step - 0.5) / STEPS)


def _cut_above(limit: float) -> float:
    return _least(lambda x: quoted(x) > limit, limit)


def _cells_of(boxes: Boxes, cuts: Sequence[float], ranges: Sequence[tuple[float, int, int]]) -> tuple[list[int], list[dict[int, int]]]:
    """Of the whole matrix, by weights: how many cells reach each cut, and per range (cut, first step, end) its cells from the cut on by steps."""
    from tableloom.operators.pairwise import MAX_BLOCK, Packed, over_tiles

    spark, count = boxes.rows.sparkSession, len(boxes.size)
    # Enough tiles for all cores, and few copies of a vector.
    rows = int(boxes.size.sum())
    together = max(1, int(count * min(MAX_BLOCK, rows / (8 * spark.sparkContext.defaultParallelism) ** 0.5) // rows))
    blocks = -(-count // together)
    bounds = Boxes(None, boxes.low, boxes.high, boxes.size, boxes.weight)

    def side_by_side(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_opened(row) for _, row in pdf.sort_values("b").iterrows()]
        return pd.DataFrame({
            "b": [key[0]], "ids": [list(range(sum(len(x) for _, x, _ in parts)))], "mat": [b"".join(x.tobytes() for _, x, _ in parts)],
            "labels": [np.concatenate([w for _, _, w in parts]).tolist()]})

    packed = Packed(boxes.rows.groupBy((F.col("b") / together).cast("int").alias("s")).applyInPandas(
        side_by_side, "b int, ids array<bigint>, mat binary, labels array<bigint>"), blocks)

    def number(mask: np.ndarray, one: np.ndarray | None, other: np.ndarray | None) -> int:
        return np.count_nonzero(mask) if one is None else int(one @ (mask @ other))

    def kernel(tile) -> pd.DataFrame:
        n, inside = np.zeros(len(cuts), dtype=np.int64), [np.zeros(end - first, dtype=np.int64) for _, first, end in ranges]
        ends_a = np.cumsum(np.append(0, bounds.size[tile.i * together:(tile.i + 1) * together]))
        ends_b = np.cumsum(np.append(0, bounds.size[tile.j * together:(tile.j + 1) * together]))
        others = np.arange(tile.j * together, tile.j * together + len(ends_b) - 1)
        for p in range(len(ends_a) - 1):
            low, high = bounds.between(tile.i * together + p, others)
            x, wx = (v[ends_a[p]:ends_a[p + 1]] for v in (tile.a, tile.labels_a))
            for q in range(p if tile.same else 0, len(others)):
                y, wy = (v[ends_b[q]:ends_b[q + 1]] for v in (tile.b, tile.labels_b))
                # A box with itself is the full square already; two different boxes stand for two squares.
                times = 1 if tile.same and p == q else 2
                whole = int(wx.sum()) * int(wy.sum()) * times
                open_ = [k for k, cut in enumerate(cuts) if low[q] < cut <= high[q]]
                for k, cut in enumerate(cuts):
                    if cut <= low[q]:
                        n[k] += whole
                sought = [k for k, (cut, _, end) in enumerate(ranges) if high[q] >= cut and _step(low[q:q + 1])[0] < end]
                if not open_ and not sought:
                    continue
                plain = wx.max() == 1 and wy.max() == 1
                for part in _chunks(len(x), len(y)):
                    cells = x[part] @ y.T
                    one, other = (None, None) if plain else (wx[part].astype(np.float64), wy.astype(np.float64))
                    for k in open_:
                        n[k] += number(cells >= cuts[k], one, other) * times
                    for k in sought:
                        cut, first, end = ranges[k]
                        mask = (cells >= cut) & (cells < (end + 1) / STEPS)
                        steps = _step(cells[mask])
                        good = (steps >= first) & (steps < end)
                        weights = None if plain else np.outer(one, other)[mask][good]
                        inside[k] += np.bincount(steps[good] - first, weights, end - first).astype(np.int64) * times
        # Cuts first, then the ranges.
        found = [(-1, k, v) for k, v in enumerate(n.tolist())] + [
            (k, ranges[k][1] + int(at), int(hist[at])) for k, hist in enumerate(inside) for at in np.nonzero(hist)[0]]
        return pd.DataFrame(found, columns=["range", "place", "n"])

    tiles = over_tiles(packed.rows, kernel, "range int, place long, n long", packed=packed)
    counts, hists = [0] * len(cuts), [{} for _ in ranges]
    for r in tiles.groupBy("range", "place").agg(F.sum("n").alias("n")).collect():
        if r["range"] < 0:
            counts[r["place"]] = r["n"]
        else:
            hists[r["range"]][r["place"]] = r["n"]
    return counts, hists


def matrix_facts(vectors: DataFrame, shares: dict[str, float], limits: Sequence[float], box: int | None = None) -> dict:
    """Of all similarities, diagonal included: `size` of the matrix, `mean`, `max`, how many are `above` each limit, and of the positive ones the
    `quantiles`, between two cells in proportion, to the sixth digit.

    A sample guesses where the quantiles lie; one pass over the matrix counts the cells below the guesses and those within by steps, which shows
    whether they were right. Where they were not, another pass looks at what is left.
    """
    rows, _ = merged(vectors)
    boxes = in_boxes(rows, rows.count(), box=box)
    size = int(boxes.weight.sum())
    total = np.zeros(boxes.low.shape[1])

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                _, x, weights = _opened(row)
                yield pd.DataFrame({"s": [(weights @ x).tolist()], "nonzero": [int(weights[x.any(axis=1)].sum())]})

    sums = boxes.rows.select("ids", "mat", "weights").mapInPandas(added, "s array<double>, nonzero long").collect()  # one row per box
    for r in sums:
        total += np.array(r["s"])
    facts = {"size": size, "mean": float(total @ total) / size**2, "max": 1.0 if any(r["nonzero"] for r in sums) else 0.0}
    share = -(-len(rows.select("id").limit(GUESSED + 1).collect()) // GUESSED)
    every = -(-int(boxes.size.sum()) // GUESSED) if share > 1 else 1
    sample = _unit(np.array([list(r["vec"]) for r in rows.where(F.pmod(F.xxhash64("id", F.lit("guess")), F.lit(every)) == 0).select("vec").limit(2 * GUESSED).collect()]
                            or [[0.0] * len(total)]))
    guess = (sample @ sample.T).ravel()
    guess = np.sort(_step(guess[quoted(guess) > 0]))
    positive = _cut_above(0.0)

    def around(share_: float) -> tuple[int, int]:
        if not len(guess):
            return 0, STEPS + 2
        low, high = (int(guess[int(np.clip(share_ + side, 0, 1) * (len(guess) - 1))]) for side in (-AROUND, AROUND))
        # The smallest of the sample lies among all.
        return (0 if share_ - AROUND <= 0 else low), high + 1

    wanted, quantiles = {name: around(p) for name, p in shares.items()}, dict.fromkeys(shares)
    if "min_positive" in wanted and len(guess):
        wanted["min_positive"] = (0, int(guess[0]) + 1)
    while wanted:
        names = list(wanted)
        start = {s: max(positive, _cut_of_step(s)) for ends in wanted.values() for s in ends}
        cuts = [positive, *[_cut_above(limit) for limit in limits], *[start[s] for name in names for s in wanted[name]]]
        counts, hists = _cells_of(boxes, cuts, [(start[wanted[name][0]], *wanted[name]) for name in names])
        n, facts["above"] = counts[0], counts[1:1 + len(limits)]
        if not n:
            break
        again = {}
        for k, name in enumerate(names):
            rank = shares[name] * (n - 1)
            at, part = int(rank), rank - int(rank)
            below, upto = (n - c for c in counts[1 + len(limits) + 2 * k:3 + len(limits) + 2 * k])
            if at < below:
                again[name] = (0, wanted[name][1])
            elif at + (part > 0) >= upto:
                again[name] = (wanted[name][0], STEPS + 2)
            else:
                steps = sorted(hists[k])
                reach = below + np.cumsum([hists[k][s] for s in steps])
                first, second = (steps[int(np.searchsorted(reach, r, side="right"))] / STEPS for r in (at, at + (part > 0)))
                quantiles[name] = first + (second - first) * part
        wanted = again
    return {**facts, "positive": n, "quantiles": quantiles}
