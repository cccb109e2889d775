"""Scores of texts by logistic context mixing.

A text is its lower-cased words and an end. They are predicted in their order, bit by bit: from the words before each,
and from what the text did so far, see `phrases`. Frequent words have codes; any other is an escape, and then spelled.

A word is spelled in bytes and ended by a blank. Every byte is predicted bit by bit. Several predictors look at hashed
contexts (the place in the word, its last one to four bytes, all of it so far), and each gives the log odds of the bit
from how often its context saw 0 and 1 in the corpus. A gate, how often the word so far and its last bytes have been
seen, and a second one, the place in word and byte, choose the weights that mix them; a table of corrections, by gate and
mixed odds, refines the result. Weights and corrections are learned online, words after words, every word being left out
of the counts while it is learned from. The spelling of a word costs the sum over its bits.

Texts are of kinds, such as languages. A second model spells all words and adapts to the kind as the words of a text go
by: with P(kind|word) from the corpus, a text has the mean, over kinds, of the product of P(word) P(kind|word) / P(kind).
The probability of a text is the mean of what the two models give it.

Each distinct word is spelled once: counts of words are gathered by a shuffle, predictors live in tables, and the costs
go back to the texts by joins. Words in their order are costed text by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableloom.llm import phrases
from tableloom.llm.common import col
from tableloom.session import cut_lineage, forget_shuffles

# log2 of the slots of each predictor: place, last 1, 2, 3 and 4 bytes, word so far.
TABLE_BITS = (12, 16, 18, 20, 21, 22)
ORDERS = len(TABLE_BITS)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
SLOTS = int(OFFSETS[-1])
# Slots that travel as one row.
BLOCK = 1 << 16
# Words of a chunk, which is scored as one; bytes of words that one task counts.
CHUNK_WORDS = 8_000_000
COUNT_BYTES = 8 << 20
# Words whose order one task learns from, at least.
LEARN_TOKENS = 8_000_000
# Words that are learned from at once, and that are scored at once.
LEARN_WORDS = 4_096
SCORE_WORDS = 16_384
PRIOR = 0.4
RATE = 0.03
# Gates: sights of the word so far, by powers of two, and of its last four bytes (none, some, many).
SIGHTS = 12
NEAR = 3
# Steps of the table of corrections, and the log odds it reaches to.
STEPS = 32
REACH = 12.0
END = b"\n"

# Kinds of texts that the score tells apart; rarer ones are taken together.
KINDS = 8
# Sightings that P(kind) is worth in P(kind|word).
KIND_PRIOR = 0.5

COUNTED = "block bigint, counts binary"
TOKENS = "chunk bigint, number int, word binary, n array<bigint>, doc_id {id}, held_out boolean, tokens binary, size bigint"


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(
    df: DataFrame, held_out: Column, kinds: list[str] = (), kind_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Rows of two sorts: (chunk, number, word, n) for the words of a chunk, n per kind of training texts; (chunk, doc_id, held_out, tokens, size) for its texts, the numbers of their words packed.

    The last kind is that of all texts whose kind is null or not listed.
    """
    kind = F.lit(len(kinds))
    for i, name in enumerate(kinds):
        kind = F.when(col(kind_col).cast("string") == name, i).otherwise(kind)
    rows = df.select(
        col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), kind.alias("kind"))
    sorts = len(kinds) + 1
    id_type = rows.schema["doc_id"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([
            ("chunk", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.list_(pa.int64())), ("doc_id", to_arrow_type(id_type)),
            ("held_out", pa.bool_()), ("tokens", pa.binary()), ("size", pa.int64())])
        chunk, known, seen, size = TaskContext.get().partitionId() << 32, _Vocabulary(), np.zeros((1 << 16, sorts), np.int64), 0

        def words() -> Iterator[pa.RecordBatch]:
            every = list(known)
            for at in range(0, len(every), 1 << 16):
                some = every[at:at + (1 << 16)]
                counts = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * sorts, seen[at:at + len(some)].ravel())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), chunk)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some, pa.binary()), counts,
                    pa.nulls(len(some), schema.field("doc_id").type), pa.nulls(len(some), pa.bool_()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64())], schema=schema)

        for part in parts:
            out, sizes = [], []
            for text, held, own in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                spelled = (text or b"").lower().split()
                spelled.append(END)
                numbers = np.fromiter(map(known.__getitem__, spelled), np.uint32, len(spelled))
                while len(seen) < len(known):
                    seen = np.concatenate([seen, np.zeros_like(seen)])
                if not held:
                    # Only the counts of its own words are touched for a text.
                    np.add.at(seen[:, own], numbers, 1)
                out.append(pa.compress(numbers.tobytes(), "zstd", asbytes=True))
                sizes.append(len(numbers))
                size += len(spelled)
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * len(out), pa.int64()), none.cast(pa.int32()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.list_(pa.int64())), part.column(0),
                part.column(2), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], schema=schema)
            if size >= chunk_words:
                yield from words()
                chunk, known, seen, size = chunk + 1, _Vocabulary(), np.zeros((1 << 16, sorts), np.int64), 0
        if size:
            yield from words()

    return rows.mapInArrow(run, TOKENS.format(id=id_type.simpleString()))


def _batches(words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, bytes as a matrix, lengths) of up to `most` words with their blanks, longest first; long words by themselves."""
    spelled = [w if w == END else w + b" " for w in words]  # the end stands alone
    lengths = np.array([len(w) for w in spelled], np.int64)
    # Classes of up to 32, 64, 128 ... bytes, so that a matrix holds little but words.
    classes = np.maximum(np.ceil(np.log2(np.maximum(lengths, 1))), 5).astype(int)
    for c in np.unique(classes):
        group = np.flatnonzero(classes == c)
        step = max(1, min(most, (most * 64) >> c))
        for at in range(0, len(group), step):
            some = group[at:at + step]
            some = some[np.argsort(-lengths[some], kind="stable")]
            width = int(lengths[some[0]])
            yield some, np.frombuffer(b"".join(spelled[i].ljust(width) for i in some), np.uint8).reshape(len(some), width), lengths[some]


def bits_of(spelled: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bit after bit, (slots of all predictors, the bits, place in byte and word) of the words that reach so far, which come first."""
    n, width = spelled.shape
    data = spelled.astype(np.uint64)
    live = n - np.searchsorted(lengths[::-1], np.arange(width), side="right")
    so_far = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    masks = np.array([(1 << b) - 1 for b in TABLE_BITS], np.uint64)[:, None]
    salts = np.arange(1, ORDERS + 1, dtype=np.uint64)[:, None]
    for i in range(width):
        m = int(live[i])
        contexts = np.empty((ORDERS, m), np.uint64)
        contexts[0] = min(i, 15)
        last = np.zeros(m, np.uint64)
        for k in range(1, 5):
            # Before the word lies a mark.
            last = (last << np.uint64(8)) | (data[:m, i - k] if i >= k else np.uint64(1))
            contexts[k] = last
        so_far = so_far[:m]
        contexts[5] = so_far
        base = (contexts + salts) * np.uint64(0x9FB21C651E98DF25)
        base ^= base >> np.uint64(29)
        node = np.ones(m, np.uint64)
        for b in range(7, -1, -1):
            slots = (base + node) * np.uint64(0xD6E8FEB86659FD93)
            bit = (data[:m, i] >> np.uint64(b)) & np.uint64(1)
            yield ((slots >> np.uint64(32)) & masks).astype(np.int64) + OFFSETS[:-1, None], bit.astype(np.int64), min(i, 3) * 8 + b
            node = (node << np.uint64(1)) | bit
        so_far = (so_far ^ data[:m, i]) * np.uint64(0x100000001B3)
        so_far ^= so_far >> np.uint64(31)


class Counts:
    """The predictors' counts by blocks, packed on their way; a worker unpacks them once."""

    def __init__(self, blocks: dict[int, bytes]):
        self.blocks = blocks
        self.counts = None

    def __getstate__(self):
        return {"blocks": self.blocks, "counts": None}

    def whole(self) -> np.ndarray:
        if self.counts is None:
            self.counts = np.zeros(2 * SLOTS, np.float32)
            for block, held in self.blocks.items():
                held = np.frombuffer(zlib.decompress(held), np.float32)
                self.counts[2 * block * BLOCK:2 * block * BLOCK + len(held)] = held
        return self.counts


def count(words: DataFrame) -> Counts:
    """How often every slot saw 0 and 1; `words` has (word, n). At most `SLOTS` pairs of counts reach the driver, packed."""
    total = words.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    tasks = max(1, -(-total // COUNT_BYTES))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * SLOTS, np.float32)
        for part in parts:
            spelled, n = part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.float32)
            for at, some, lengths in _batches(spelled, SCORE_WORDS):
                weight = n[at]
                for slots, bit, _ in bits_of(some, lengths):
                    for k in range(ORDERS):
                        np.add.at(counts, 2 * slots[k] + bit, weight[:len(bit)])
        for block in range(0, SLOTS, BLOCK):
            held = counts[2 * block:2 * (block + BLOCK)]
            if held.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block // BLOCK], pa.int64()), "counts": [zlib.compress(held.tobytes(), 1)]})

    return Counts(_added_up(words.select("word", F.col("n").cast("bigint").alias("n")).repartition(tasks).mapInArrow(add, COUNTED), tasks))


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.float32).tobytes(), 1)


def _unpack(held: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held), np.float32)


def _added_up(tables: DataFrame, tasks: int, pack=_pack, unpack=_unpack) -> dict[int, bytes]:
    """The packed sums of the packed `counts` by `block`, which come from so many tasks; those of negative blocks are plain numbers."""

    def merge(part: pa.Table) -> pa.Table:
        into, out = (unpack, pack) if part.column("block")[0].as_py() >= 0 else (_unpack, _pack)
        return pa.table({"block": part.column("block").slice(0, 1), "counts": [out(sum(into(c.as_py()) for c in part.column("counts")))]})

    # A block meets in two steps, so that no task gets more than a few hundred of its copies.
    some = tables.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks ** 0.5)))))
    half = some.groupBy("block", "part").applyInArrow(merge, COUNTED)
    return {r["block"]: bytes(r["counts"]) for r in half.groupBy("block").applyInArrow(merge, COUNTED).collect()}


class Mixer:
    """Weights by gate and corrections; with the counts of the predictors, a model."""

    def __init__(self):
        start = np.full(ORDERS + 1, 0.2, np.float32)
        self.by_sight = np.tile(start, (SIGHTS * NEAR, 1))
        self.by_place = np.tile(start, (32, 1))
        self.refined = np.tile(np.linspace(-REACH, REACH, STEPS + 1, dtype=np.float32), (SIGHTS * NEAR, 1))
        self.spent = [np.full_like(a, 1e-4) for a in self.arrays()]

    def arrays(self) -> list[np.ndarray]:
        return [self.by_sight, self.by_place, self.refined]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> Mixer:
        mixer = Mixer()
        mixer.by_sight, mixer.by_place, mixer.refined = arrays
        return mixer

    def inputs(self, counts: np.ndarray, slots: np.ndarray, bit: np.ndarray | None):
        """Log odds of a 1 per predictor, and the gate; with `bit`, without one sight of it."""
        # Both counts of a slot lie side by side and are fetched as one.
        both = counts.view(np.complex64)[slots]
        pairs = both.view(np.float32)
        if bit is not None:
            both -= (1 - bit) + 1j * bit
            np.maximum(pairs, 0, out=pairs)
        # How often the word so far has been seen, and whether its last four bytes were.
        near, whole = both[4].real + both[4].imag, both[5].real + both[5].imag
        gate = np.minimum(np.log2(whole + 1), SIGHTS - 1).astype(np.int64) * NEAR + (near > 0) + (near > 8)
        pairs += np.float32(PRIOR)
        return np.log(both.imag / both.real), gate

    def mix(self, x: np.ndarray, gate: np.ndarray, place: int):
        # The weights of a bit are picked predictor by predictor, from few gates.
        weights = (self.by_sight + self.by_place[place]).T.copy()
        mixed = weights[ORDERS][gate]
        for k in range(ORDERS):
            mixed += weights[k][gate] * x[k]
        at = (np.clip(mixed, -REACH + 1e-3, REACH - 1e-3) + np.float32(REACH)) * np.float32(STEPS / (2 * REACH))
        low = at.astype(np.int64)
        share = at - low.astype(np.float32)
        step, refined = gate * (STEPS + 1) + low, self.refined.ravel()
        fine = refined[step] * (1 - share) + refined[step + 1] * share
        return mixed, step, share, (mixed + fine) / 2

    def learn(self, counts: np.ndarray, slots: np.ndarray, bit: np.ndarray, place: int, weight: np.ndarray) -> None:
        """One online step on a bit of several words, with a rate per weight that falls as it is used."""
        bit = bit.astype(np.float32)
        x, gate = self.inputs(counts, slots, bit)
        mixed, step, share, final = self.mix(x, gate, place)
        weight = weight / weight.sum()
        error = (bit - 1 / (1 + np.exp(-mixed))) * weight
        by_gate = lambda v: np.bincount(gate, v, SIGHTS * NEAR)
        slope = np.stack([*(by_gate(error * x[k]) for k in range(ORDERS)), by_gate(error)], axis=1)
        self._go(0, slope.astype(np.float32), RATE)
        at_place = np.zeros_like(self.by_place)
        at_place[place] = slope.sum(axis=0)
        self._go(1, at_place, RATE)
        error = (bit - 1 / (1 + np.exp(-final))) * weight
        fine = np.bincount(step, error * (1 - share), self.refined.size) + np.bincount(step + 1, error * share, self.refined.size)
        self._go(2, fine.astype(np.float32).reshape(self.refined.shape), RATE)

    def _go(self, which: int, slope: np.ndarray, rate: float) -> None:
        array, spent = self.arrays()[which], self.spent[which]
        spent += slope ** 2
        array += rate * slope / np.sqrt(spent)

    def cost(self, counts: np.ndarray, spelled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of words, longest first."""
        total = np.zeros(len(spelled))
        for slots, bit, place in bits_of(spelled, lengths):
            x, gate = self.inputs(counts, slots, None)
            final = np.clip(self.mix(x, gate, place)[3], -20, 20)
            # log(1 + exp(-final)) for a 1, log(1 + exp(final)) for a 0.
            wrong = np.where(bit == 1, -final, final)
            total[:len(bit)] -= np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))
        return total / np.log(10)


def fit(words: DataFrame) -> tuple:
    """A broadcast model of (word, n), the words of the training texts: counts, weights and corrections.

    Every task learns weights on its words in turn, and weights are averaged by what was learned from; a row per task.
    """
    sc = words.sparkSession.sparkContext
    # Plain values: executors need no copy of this package to read them.
    held = sc.broadcast(count(words).blocks)

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, learned, counts = Mixer(), 0.0, Counts(held.value).whole()
        for part in parts:
            spelled, n = part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.float32)
            for at, some, lengths in _batches(spelled, LEARN_WORDS):
                weight = n[at]
                learned += float(weight.sum())
                for slots, bit, place in bits_of(some, lengths):
                    mixer.learn(counts, slots, bit, place, weight[:len(bit)])
        if learned:
            yield pa.RecordBatch.from_pydict({"learned": pa.array([learned]), "arrays": [b"".join(a.astype(np.float32).tobytes() for a in mixer.arrays())]})

    rows = words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(learn, "learned double, arrays binary").collect()
    mixer = Mixer()
    if rows:
        total = sum(r["learned"] for r in rows)
        mean = sum(np.frombuffer(r["arrays"], np.float32) * (r["learned"] / total) for r in rows)
        at = 0
        for array in mixer.arrays():
            array[...] = mean[at:at + array.size].reshape(array.shape)
            at += array.size
    return held, sc.broadcast(mixer.arrays())


def fit_order(texts: DataFrame, words: DataFrame, train_tokens: int) -> tuple:
    """The words of (word, n) that have codes, and a broadcast model of how words follow each other in `texts` (text), which are learned from.

    At most `phrases.CODED` words and the slots of two orders of contexts reach the driver.
    """
    spark = texts.sparkSession
    top = words.orderBy(F.desc("n"), "word").select("word", "n").limit(phrases.CODED).collect()
    codes = phrases.tree([train_tokens - sum(r["n"] for r in top) + 1, *(r["n"] for r in top)])
    named, table = [bytes(r["word"]) for r in top], phrases.table_bits(train_tokens)
    shared = spark.sparkContext.broadcast((named, codes))

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, codes = shared.value
        number, learner = {w: i + 1 for i, w in enumerate(named)}, phrases.Learner(codes, table)
        for part in parts:
            spelled = [(t or b"").lower().split() + [END] for t in part.column(0).to_pylist()]
            learner.learn([np.fromiter((number.get(w, 0) for w in text), np.int32, len(text)) for text in spelled])
        if learner.learned:
            # Block -1 holds the weights, by what they were learned from.
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([-1], pa.int64()), "counts": [_pack(np.append(learner.weights.ravel() * learner.learned, learner.learned))]})
            flat = learner.counts.ravel()
            for at in range(0, flat.size, 2 * BLOCK):
                if flat[at:at + 2 * BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([at // (2 * BLOCK)], pa.int64()), "counts": [phrases.packed(flat[at:at + 2 * BLOCK])]})

    # A task learns from many words, as every one sends on its counts.
    tasks = max(spark.sparkContext.defaultParallelism, train_tokens // LEARN_TOKENS)
    found = _added_up(texts.coalesce(tasks).mapInArrow(learn, COUNTED), tasks, phrases.packed, phrases.unpacked)
    learner = phrases.Learner(codes, table)
    flat = learner.counts.reshape(-1)
    for block, held in found.items():
        if block >= 0:
            held = phrases.unpacked(held)
            flat[2 * block * BLOCK:2 * block * BLOCK + len(held)] = held
        else:
            held = _unpack(held)
            learner.weights = (held[:-1] / held[-1]).reshape(learner.weights.shape)
    model = {k: (v.shape, zlib.compress(v.tobytes(), 1)) for k, v in phrases.model(learner.counts).items()}
    return shared, table, spark.sparkContext.broadcast((model, learner.weights))


def word_scores(words: DataFrame, model: tuple, named=None) -> DataFrame:
    """`words` with score, the log10 probability of each distinct word, and its code, 0 unless the broadcast `named` lists it; the column word comes first."""
    held, arrays = model

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, counts = Mixer.of(arrays.value), Counts(held.value).whole()
        number = {w: i + 1 for i, w in enumerate(named.value[0])} if named else {}
        for part in parts:
            out, spelled = np.zeros(part.num_rows), part.column(0).to_pylist()
            for at, some, lengths in _batches(spelled, SCORE_WORDS):
                out[at] = mixer.cost(counts, some, lengths)
            yield part.append_column("score", pa.array(out)).append_column("code", pa.array([number.get(w, 0) for w in spelled], pa.int32()))

    return words.mapInArrow(run, f"{words.schema.simpleString()[7:-1]},score:double,code:int")


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; learns from rows that are not `held_out`.

    base_score is that of single words with one added to every count; score is the log10 probability under context
    mixing, in which the order of words and their repeats count. Kinds are the `KINDS` most frequent values of `kind_col` in the training texts, of which alone it is read.
    A null text is empty and has its end alone; where `held_out` is null, a row is learned from. Repeated rows count as
    often as they stand; other columns are not looked at. Without any training text both scores are those of an
    untrained model. An empty table gives none.
    """
    spark = df.sparkSession
    kinds: list[str] = []
    if kind_col is not None:
        trained = df.where(~F.coalesce(held_out, F.lit(False))).select(col(kind_col).cast("string").alias("kind")).where("kind is not null")
        kinds = sorted(r["kind"] for r in trained.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(KINDS).collect())
    sorts = range(len(kinds) + 1)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    cut = cut_lineage(tokens(df, held_out, kinds, kind_col, id_col, text_col))
    spoken = cut.where("word is not null").select("chunk", "number", "word", "n")
    texts = cut.where("tokens is not null").select(F.col("chunk").alias("of_chunk"), "doc_id", "held_out", "tokens", "size")
    # Words come in large batches, as a step on few words costs as much as one on many.
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(4 * SCORE_WORDS))
    sums = [F.sum(F.col("n")[k]).alias(f"n{k}") for k in sorts]
    words = spoken.groupBy("word").agg(*sums).withColumn("n", sum((F.col(f"n{k}") for k in sorts), F.lit(0).cast("bigint")))
    words = cut_lineage(words)
    forget_shuffles(spark)
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    fitted = fit(words.where("n > 0"))
    forget_shuffles(spark)
    spark.conf.set(conf, before)
    learned_from = df.where(~F.coalesce(held_out, F.lit(False))).select(col(text_col).cast("binary").alias("text"))
    named, table, order = fit_order(learned_from, words.where("n > 0"), train_tokens)
    forget_shuffles(spark)
    spark.conf.set(conf, str(4 * SCORE_WORDS))
    scored = cut_lineage(word_scores(words, fitted, named))
    spark.conf.set(conf, before)
    forget_shuffles(spark)
    floor = np.log10(train_tokens + distinct + 1)
    # P(kind) is that of the words as the model has them, so that the kinds share out its probability.
    plain = [r / train_tokens if train_tokens else 1 / len(sorts) for r in words.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in sorts]).first()]
    given = lambda n, total, k: (n + KIND_PRIOR * plain[k]) / (total + KIND_PRIOR)
    masses = scored.where("n > 0").select(F.pow(F.lit(10.0), "score").alias("p"), "n", *[f"n{k}" for k in sorts]).agg(
        *[F.sum(F.col("p") * given(F.col(f"n{k}"), F.col("n"), k)).alias(f"m{k}") for k in sorts]).first()
    whole = sum(m or 0.0 for m in masses)
    prior = np.array([m / whole if whole else p for m, p in zip(masses, plain)])
    present = prior > 0

    def gather(own: pa.Table, found: pa.Table) -> pa.Table:
        model, weights = order.value
        learned = {k: np.frombuffer(zlib.decompress(held), np.int8).reshape(shape) for k, (shape, held) in model.items()}
        size = own.num_rows
        n, cost, code, shift = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int32), np.zeros((size, len(sorts)))
        at = own.column("number").to_numpy()
        n[at], cost[at], code[at] = own.column("n").to_numpy(), own.column("score").to_numpy(), own.column("code").to_numpy()
        for k in sorts:
            if present[k]:
                shift[at, k] = np.log(given(own.column(f"n{k}").to_numpy().astype(float), own.column("n").to_numpy(), k) / prior[k])
        shift[n == 0] = 0.0
        base, known = np.log10(n + 1.0) - floor, n > 0
        base_scores, scores, rows = [], [], [
            np.frombuffer(pa.decompress(t.as_py(), 4 * n, "zstd", asbytes=True), np.uint32) for t, n in zip(found.column("tokens"), found.column("size").to_pylist())]
        spelling = np.where(code == 0, cost, 0.0)
        for r, follow in zip(rows, phrases.costs(named.value[1], table, learned, weights, [code[r] for r in rows])):
            kind = np.log(prior[present]) + shift[r][:, present].sum(axis=0)
            base_scores.append(float(base[r].sum()))
            apart = cost[r].sum() * np.log(10) + np.logaddexp.reduce(kind)
            in_order = follow.sum() + spelling[r].sum() * np.log(10)
            scores.append(float((np.logaddexp(apart, in_order) - np.log(2)) / np.log(10)))
        return pa.table({
            "doc_id": found.column("doc_id"), "held_out": found.column("held_out"), "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
            "n_known": pa.array([int(known[r].sum()) for r in rows], pa.int64()), "train_tokens": pa.array([train_tokens] * len(rows), pa.int64()),
            "base_score": pa.array(base_scores, pa.float64()), "score": pa.array(scores, pa.float64())})

    id_type = texts.schema["doc_id"].dataType.simpleString()
    priced = spoken.select("chunk", "number", "word").join(scored, "word").select("chunk", "number", "n", "score", "code", *[f"n{k}" for k in sorts])
    # A task gets few chunks, as they are small but take long.
    chunks = max(1, texts.select("of_chunk").distinct().count())
    priced, texts = priced.repartition(2 * chunks, "chunk"), texts.repartition(2 * chunks, "of_chunk")
    return priced.groupBy("chunk").cogroup(texts.groupBy("of_chunk")).applyInArrow(
        gather, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
