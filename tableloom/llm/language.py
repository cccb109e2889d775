"""Languages of words and texts by a linear-chain conditional random field.

The words of a text, which may switch languages, are a chain. A word's score for a language sums learned weights of
its features: character n-grams with marks at both ends, so that affixes are n-grams of their own, and the word itself
as an entry of the lexicon. Transitions between languages are learned with them. Forward-backward gives every word a
probability per language; a text has the language with the largest share of its letters.

Training takes a bounded sample of labelled texts per language and mixes runs of words of several texts, so that the
chain sees switches. Long texts are labelled in runs of `RUN` words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tableloom.llm.common import col
from tableloom.session import cut_lineage

TABLE_BITS = 18
LONGEST_GRAM = 4
RUN = 256
# Bounds of the training sample: texts per language, words per text.
SAMPLE_TEXTS = 250
SAMPLE_WORDS = 400
# Words that a worker keeps the scores of.
KEPT_WORDS = 1 << 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and how many each word has."""
    data = [w.encode("utf-8", "replace") for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    # An n-gram starts at each byte and at the front mark, and may take in the end mark.
    counts = sum(np.maximum(sizes + 2 - n + 1, 0) for n in range(1, LONGEST_GRAM + 1)) + 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(starts[-1]), np.uint32)
    lexicon = np.fromiter((zlib.crc32(d) for d in data), np.uint32, len(data))
    at = starts[:-1].copy()
    flat[at] = _slot(lexicon ^ np.uint32(0x5BD1E995))
    at += 1
    # All words on end, each between its marks.
    text = np.frombuffer(b"".join(b"\x01" + d + b"\x02" for d in data), np.uint8).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes + 2)])
    position = np.arange(len(text)) - np.repeat(begins[:-1], sizes + 2)
    room = np.repeat(sizes + 2, sizes + 2) - position
    first = np.repeat(at, sizes + 2)
    gram = np.zeros(len(text), np.uint32)
    before = np.zeros(len(text), np.int64)
    for n in range(1, LONGEST_GRAM + 1):
        ahead = np.concatenate([text[n - 1:], np.zeros(n - 1, np.uint32)])
        gram = gram * np.uint32(0x01000193) ^ (ahead + np.uint32(n << 9))
        fits = room >= n
        flat[(first + before + position)[fits]] = _slot(gram[fits])
        before += np.repeat(np.maximum(sizes + 2 - n + 1, 0), sizes + 2)
    return flat, counts


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def scores(weights: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Score per word and language: the sum of its weights over the root of their number."""
    out = np.empty((len(counts), weights.shape[1]), np.float32)
    starts = np.concatenate([[0], np.cumsum(counts)])
    step = max(1, (1 << 20) // max(1, int(counts.max(initial=1))))
    for a in range(0, len(counts), step):
        b = min(a + step, len(counts))
        out[a:b] = np.add.reduceat(weights[flat[starts[a]:starts[b]]], starts[a:b] - starts[a], axis=0)
    return out / np.sqrt(counts, dtype=np.float32)[:, None]


def posteriors(emission: np.ndarray, lengths: np.ndarray, change: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains of sorted, falling `lengths`, whose scores stand time by time.

    `emission` is (steps, chains, languages). Returns probabilities of the same shape (0 beyond a chain's end) and, if
    asked, the expected number of each transition.
    """
    steps, chains, size = emission.shape
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    live = np.array([int((lengths > t).sum()) for t in range(steps)])
    move = np.exp(change)
    forward = np.zeros_like(local)
    for t in range(steps):
        k = live[t]
        now = local[t, :k] * (np.exp(start) if t == 0 else forward[t - 1, :k] @ move)
        forward[t, :k] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
    out, backward = np.zeros_like(local), np.ones((chains, size), local.dtype)
    moved = np.zeros((size, size))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        both = forward[t, :k] * backward[:k]
        out[t, :k] = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-30)
        if t:
            ahead = local[t, :k] * backward[:k]
            if pairs:
                joint = forward[t - 1, :k, :, None] * move * ahead[:, None, :]
                moved += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
            back = ahead @ move.T
            backward[:k] = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-30)
    return (out, moved) if pairs else out


class Model:
    """Learned weights: (features, languages), transitions and starts."""

    def __init__(self, languages: list[str]):
        size = len(languages)
        self.languages = languages
        self.weights = np.zeros((1 << TABLE_BITS, size), np.float32)
        self.change = np.zeros((size, size), np.float32)
        self.start = np.zeros(size, np.float32)


def train(texts: list[tuple[list[str], str]], rounds: int = 120, chains: int = 48, steps: int = 64, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit the field by stochastic gradients (with a rate per weight) on chains of runs of words from several texts."""
    languages = sorted({lang for words, lang in texts if words})
    model = Model(languages)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    by_language = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for words, lang in texts if lang == name and words] for name in languages]
    flat, counts = features(list(vocabulary))
    starts = np.concatenate([[0], np.cumsum(counts)])
    spent = np.full(model.weights.shape, 1e-3, np.float32)
    spent_change = np.full(model.change.shape, 1e-3, np.float32)
    for _ in range(rounds):
        tokens = np.zeros((steps, chains), np.int64)
        labels = np.zeros((steps, chains), np.int64)
        for c in range(chains):
            t = 0
            while t < steps:
                lang = int(rng.integers(len(languages)))
                words = by_language[lang][int(rng.integers(len(by_language[lang])))]
                many = min(steps - t, len(words), int(rng.integers(4, 40)))
                at = int(rng.integers(len(words) - many + 1))
                tokens[t:t + many, c], labels[t:t + many, c] = words[at:at + many], lang
                t += many
        used, inverse = np.unique(tokens, return_inverse=True)
        inverse = inverse.reshape(tokens.shape)
        which = np.concatenate([flat[starts[u]:starts[u + 1]] for u in used])
        emission = scores(model.weights, which, counts[used])[inverse]
        expected, moved = posteriors(emission, np.full(chains, steps), model.change, model.start, pairs=True)
        slope = -expected
        np.put_along_axis(slope, labels[:, :, None], np.take_along_axis(slope, labels[:, :, None], 2) + 1, 2)
        per_word = np.zeros((len(used), len(languages)), np.float32)
        np.add.at(per_word, inverse.ravel(), slope.reshape(-1, len(languages)))
        per_word /= np.sqrt(counts[used], dtype=np.float32)[:, None] * chains
        touched, back = np.unique(which, return_inverse=True)
        gradient = np.zeros((len(touched), len(languages)), np.float32)
        np.add.at(gradient, back, np.repeat(per_word, counts[used], axis=0))
        spent[touched] += gradient ** 2
        model.weights[touched] += rate * gradient / np.sqrt(spent[touched])
        seen = np.zeros_like(moved)
        np.add.at(seen, (labels[:-1].ravel(), labels[1:].ravel()), 1)
        gradient = ((seen - moved) / chains).astype(np.float32)
        spent_change += gradient ** 2
        model.change += 0.1 * rate * gradient / np.sqrt(spent_change)
    return model


class Labeller:
    """Word and text languages under a model; scores of words are kept while they fit."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.emission = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words in the tables of scores and letters."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        known, before, fresh, out = self.known, len(self.known), [], []
        for words in texts:
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
            out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if fresh:
            while len(self.letters) < len(known):
                self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            flat, counts = features(fresh)
            self.emission[before:len(known)] = scores(self.model.weights, flat, counts)
            self.letters[before:len(known)] = [letters_in(w) for w in fresh]
        return out

    def label(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """(words, languages) probabilities for each text, given the numbers of its words."""
        size = len(self.model.languages)
        runs = [(i, a, min(RUN, len(n) - a)) for i, n in enumerate(numbers) for a in range(0, len(n), RUN)]
        runs.sort(key=lambda r: -r[2])
        out = [np.zeros((len(n), size), np.float32) for n in numbers]
        for at in range(0, len(runs), 512):
            group = runs[at:at + 512]
            lengths = np.array([r[2] for r in group])
            emission = np.zeros((int(lengths[0]), len(group), size), np.float32)
            for c, (i, a, n) in enumerate(group):
                emission[:n, c] = self.emission[numbers[i][a:a + n]]
            found = posteriors(emission, lengths, self.model.change, self.model.start)
            for c, (i, a, n) in enumerate(group):
                out[i][a:a + n] = found[:n, c]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and the share of its letters, per text."""
        words = [words_of(t) for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out, every = [], self.numbers(words)
        for numbers, found in zip(every, self.label(every)):
            weight = self.letters[numbers].astype(np.float64)
            if not weight.sum():
                out.append((UNKNOWN, 0.0))
                continue
            share = weight @ found / weight.sum()
            best = int(np.argmax(share))
            out.append((self.model.languages[best], float(min(1.0, share[best]))))
        return out


def sample(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS) -> DataFrame:
    """Up to `texts` rows per language, by the least hash, each with up to `words` of its words from a place set by the hash."""
    rows = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(
        col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"), F.xxhash64(col(id_col).cast("string"), col(text_col)).alias("hash"))
    # Languages and hashes alone are ranked; a language's last hash then says which texts are read.
    ranked = rows.select("lang", "hash").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("nth") <= texts)
    last = cut_lineage(ranked.groupBy("lang").agg(F.max("hash").alias("last")))
    chosen = rows.join(last, "lang").where("hash <= last")
    ranked = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    parts = ranked.withColumn("words", F.split(F.trim("text"), "\\s+"))
    at = F.expr(f"cast(pmod(hash, greatest(size(words) - {words}, 0) + 1) as int) + 1")
    return parts.select("lang", F.concat_ws(" ", F.slice("words", at, F.lit(words))).alias("text"))


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS) -> Model:
    """A model of the labelled rows of `df`; the sample, languages x texts x words, is all that reaches the driver."""
    found = sample(df, lang_col, id_col, text_col, texts, words).orderBy("lang", "text").collect()
    return train([(words_of(r["text"]), r["lang"]) for r in found])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language of most letters and their share, 0 to 1.

    `und` with 0 for null texts, texts without a letter, and a model without languages. Whole texts are read; repeated
    rows stay repeated; other columns are not looked at. An empty table gives none.
    """
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = rows.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.change, model.start))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.languages, own.weights, own.change, own.start = held.value
        labeller = Labeller(own)
        for part in parts:
            found = labeller.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == fold
