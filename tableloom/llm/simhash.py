"""Near duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint is cut into `max_distance // 2 + 1` segments, so that two fingerprints within the distance have a
segment that differs by at most one bit. Every fingerprint indexes each segment once per position, with that
position wildcarded; equal variants meet and are verified. Equal fingerprints collapse beforehand.

A variant held by two fingerprints is a pair. Fingerprints in a variant of three or more are crowded, as the copies
of one text with small changes are: they are linked by the same trick with the whole fingerprint as one segment,
where each lists itself and its one-bit changes. Two of them at a distance of two or less meet there, and all that
meet are within two of each other, so a star says it all: work grows with the number of crowded fingerprints, at any
size of the group, and no pairs within a group are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableloom.llm import crowds
from tableloom.llm.common import col
from tableloom.operators.components import connected_components
from tableloom.session import cut_lineage

BITS = 64
SEED = 42
# Hashes whose bits are counted at once.
SLICE = 1 << 15
# Bands by which texts of similar shingle sets meet, and the least hashes that a band joins.
BANDS, BAND_ROWS = 20, 5


def shingles_of(text: bytes | None, shingle: int) -> list[bytes]:
    """Runs of `shingle` words, repeats included; all words, if they are fewer; none of a blank text."""
    # On bytes, lower() touches A-Z alone and split() takes the six ASCII blanks.
    words = (text or b"").lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def fingerprint(shingles: list[bytes], seed: int = SEED) -> int:
    """Bit i is set if more than half of the shingle hashes have it."""
    import xxhash

    return _majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, len(shingles)))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, fp bigint) per row, with fp2 and so on for more seeds. Null and blank texts have fingerprint 0; texts of up to `shingle` words have one shingle."""
    out = df.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    names = [f"fp{i + 1 if i else ''}" for i in range(len(seeds))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cut = [shingles_of(t, shingle) for t in part.column(1).to_pylist()]
            found = [np.array([fingerprint(c, seed) for c in cut], np.uint64).view(np.int64) for seed in seeds]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], ["id", *names])

    return out.mapInArrow(run, T.StructType([out.schema["id"], *[T.StructField(n, T.LongType()) for n in names]]))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _variants(fps: DataFrame, max_distance: int, node: str = "fp") -> DataFrame:
    """(key, node): for every segment of fp and every position in it, the segment without that bit."""
    segments = max_distance // 2 + 1
    if BITS // segments > 32:
        segments = 2  # segment and position share a bigint with the bits
    width = -(-BITS // segments)
    at = F.col("at")
    segment = F.shiftright(F.col("fp"), 0) if segments == 1 else F.expr(
        f"shiftrightunsigned(fp, cast(at div {width} as int) * {width}) & {(1 << width) - 1}L")
    hole = F.expr(f"~shiftleft(1L, cast(at % {width} as int))")
    return fps.select(F.col(node).alias("node"), "fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("at")).select(
        F.shiftleft(at.cast("bigint"), 32).bitwiseOR(segment.bitwiseAND(hole)).alias("key"), "node")


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect just what is connected by pairs of `fps` (column fp, distinct) within the distance, 1 or 2."""
    if max_distance not in (1, 2):
        raise ValueError("max_distance is 1 or 2")
    a, b = F.col("a"), F.col("b")
    pairs, crowd = crowds.meetings(_variants(fps, max_distance))
    pairs = pairs.where(_distance(a, b) <= max_distance)
    crowded = crowd.select(F.col("node").alias("fp")).distinct()
    if max_distance == 1:
        near = F.expr(f"transform(sequence(0, {BITS - 1}), i -> struct(i as at, fp & ~shiftleft(1L, i) as bits))")
    else:
        near = F.expr(f"concat(array(struct(0 as at, fp as bits)), transform(sequence(0, {BITS - 1}), i -> struct(0 as at, fp ^ shiftleft(1L, i) as bits)))")
    # At most 65 distinct fingerprints share a neighbour.
    stars = cut_lineage(crowded).select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("members"))
    stars = stars.where(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars.where(_distance(a, b) <= max_distance)).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2,
) -> DataFrame:
    """(id, fp bigint, component_id): the smallest id that can be reached over links, per row of `df`.

    Null and blank texts share fingerprint 0 and so a component. A null id keeps its row and counts as no id; a
    component without ids has null. Repeated rows stay repeated. Other columns are not looked at. An empty table gives none.
    """
    prints = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    fps = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    groups = connected_components(links(fps.select("fp"), max_distance)).select(F.col("node").alias("fp"), F.col("label").alias("root"))
    rooted = cut_lineage(fps.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root"), "fp").join(least, "root").select("id", "fp", "component_id")


def _set_marks(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, t1, t2, s1, s2, size, fp, fp2, bands): hashes of the text, of its set of shingles, the size of that, two SimHash fingerprints of it and `BANDS` keys of its least hashes."""
    out = df.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("t1"), F.xxhash64(F.lit("text"), col(text_col)).alias("t2"), col(text_col).cast("binary").alias("text"))
    names = ["s1", "s2", "size", "fp", "fp2"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(SEED)
        odd = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
        for part in parts:
            marks, bands = [], []
            for text in part.column(3).to_pylist():
                found = set(shingles_of(text, shingle))
                hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), found), np.uint64, len(found))
                mixed = (hashes ^ (hashes >> np.uint64(29))) * odd[0]
                mixed ^= mixed >> np.uint64(32)
                again = mixed * odd[1]
                marks.append((hashes.sum(dtype=np.uint64), mixed.sum(dtype=np.uint64), len(hashes), _majority(hashes), _majority(again ^ (again >> np.uint64(29)))))
                least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(hashes), SLICE):
                    cut = hashes[at:at + SLICE]
                    for i in range(len(odd)):
                        turned = (cut ^ salt[i]) * odd[i]
                        least[i] = min(least[i], (turned ^ (turned >> np.uint64(31))).min())
                rows = least.reshape(BANDS, BAND_ROWS)
                bands.append([xxhash.xxh64_intdigest(rows[j].tobytes(), seed=j) for j in range(BANDS)] if found else [])
            columns = np.array(marks, np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), *[pa.array(columns[:, i]) for i in range(len(names))],
                 pa.array([np.array(x, np.uint64).view(np.int64) for x in bands], pa.list_(pa.int64()))], ["id", "t1", "t2", *names, "bands"])

    fields = [out.schema["id"], *[T.StructField(n, T.LongType()) for n in ("t1", "t2", *names)], T.StructField("bands", T.ArrayType(T.LongType()))]
    return out.mapInArrow(run, T.StructType(fields))


def _set_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): variants of both fingerprints of `nodes`, as `near_duplicates` has them, and bands for similar sets that these miss."""
    some = nodes.where("size > 0")
    again = _variants(some.select("node", F.col("fp2").alias("fp")), 2, "node").withColumn("key", F.col("key") + F.lit(BITS << 32))
    return _variants(some, 2, "node").unionByName(again).unionByName(some.select(F.explode("bands").alias("key"), "node"))


def _jaccard_at_least(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of `pairs` (a, b, sa, sb) whose texts have this Jaccard similarity of shingle sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep, last, one = [], None, set()
            for a, sa, sb in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if a != last:
                    last, one = a, set(shingles_of(sa, shingle))
                other = set(shingles_of(sb, shingle))
                both = len(one & other)
                keep.append(both >= similarity * (len(one) + len(other) - both) - 1e-9)
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(id, component_id) as `near_duplicates`, for texts whose shingle sets have at least this Jaccard similarity.

    Texts meet by the deletion variants of two SimHash fingerprints of their shingles: with probability 0.13 at similarity 0.8,
    0.46 at 0.9 and 0.78 at 0.95, bits taken as independent. Those that these miss meet by `BANDS` bands of `BAND_ROWS` least hashes of their shingles: with probability 1 - (1 - s^5)^20 at similarity s,
    0.9996 at 0.8. The similarity of those that meet is worked out from their texts, so none below it are linked.
    """
    prints = cut_lineage(_set_marks(df, id_col, text_col, shingle))
    sets = ["s1", "s2", "size"]
    nodes = prints.groupBy(*sets).agg(F.min("id").alias("least"), F.min(F.struct("t1", "t2")).alias("t"), *[F.first(c).alias(c) for c in ("fp", "fp2", "bands")])
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    texts = df.select(F.xxhash64(col(text_col)).alias("t1"), F.xxhash64(F.lit("text"), col(text_col)).alias("t2"), col(text_col).cast("binary").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = crowds.small(cut_lineage(nodes.select("node", "t.*").join(wanted, "node")))
        # Rows that repeat a text give it once.
        spelled = cut_lineage(texts.join(wanted, ["t1", "t2"]).groupBy("node").agg(F.min("text").alias("spelled")))
        both = pairs.join(spelled.select(F.col("node").alias("a"), F.col("spelled").alias("sa")), "a").join(
            spelled.select(F.col("node").alias("b"), F.col("spelled").alias("sb")), "b")
        return cut_lineage(_jaccard_at_least(both, shingle, similarity))

    # Sets that differ more in size cannot be as similar.
    within = lambda one, other: F.least(one("size"), other("size")) >= similarity * F.greatest(one("size"), other("size")) - 1e-9
    met = crowds.groups(_set_keys(nodes), nodes.select("node", "size"), within, verify)
    rooted = cut_lineage(nodes.join(met, "node", "left").select(*sets, F.coalesce("root", "node").alias("root"), "least"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.drop("least"), sets).join(least, "root").select("id", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
