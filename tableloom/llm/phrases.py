"""Words of a text predicted in their order, bit by bit, by logistic mixing.

The most frequent words of the corpus, and an escape for all others, have Huffman codes. Every bit of a code is
predicted by its place in the code tree: from all words of the corpus, from hashed contexts of the previous word and of
the previous two words with that place, and from what this text did at that place so far. A gate, how often the contexts
and the text came by, chooses the weights that mix the log odds.

Weights and counts are learned online in one pass: a task predicts the bits of some texts by what it has counted before,
corrects its weights, and only then counts these bits. Counts of all tasks are added, weights averaged by what they
were learned from.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np

# Words that have a code; all others share the escape, whose code is 0.
CODED = (1 << 16) - 1
# log2 of the slots of each order of contexts: as many slots as words learned from, within these bounds.
LEAST_BITS, MOST_BITS = 16, 22
# Words that are predicted at once; the text so far is remembered from one run of a long text to the next.
RUN = 1 << 13
# Bits that the weights are corrected by at once.
LEARN_BITS = 1 << 14
PRIOR = 0.4
RATE = 0.02
FINE = 12
# Predictors: all words, previous word, previous two, text so far, and a constant.
INPUTS = 5
# Gate: sightings of each order of contexts and of the place in the text so far, none, 1 to 3, 4 to 15 and more.
CLASSES = 4
GATES = CLASSES ** 3
START = np.array([0.3, 0.4, 0.3, 0.2, 0.0], np.float32)
SALTS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15], np.uint64)


def table_bits(words: int) -> int:
    return min(max(LEAST_BITS, int(words).bit_length()), MOST_BITS)


def tree(counts: list[int]) -> dict[str, np.ndarray]:
    """Huffman codes of symbols 0, 1 ...: where each path starts, its nodes and bits; and per node the log odds of a 1."""
    heap = [(n, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    symbols = len(counts)
    above, side = np.zeros(2 * symbols, np.int64), np.zeros(2 * symbols, np.int8)
    odds = np.zeros(max(symbols - 1, 1), np.float32)
    for node in range(symbols, 2 * symbols - 1):
        (zeros, a), (ones, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b], side[b] = node, node, 1
        odds[node - symbols] = np.log((ones + PRIOR) / (zeros + PRIOR))
        heapq.heappush(heap, (zeros + ones, node))
    nodes, bits, starts, root = [], [], [0], 2 * symbols - 2
    for at in range(symbols):
        path, turns = [], []
        while at != root:
            turns.append(side[at])
            at = above[at]
            path.append(at - symbols)
        nodes += path[::-1]
        bits += turns[::-1]
        starts.append(len(nodes))
    return {"starts": np.array(starts, np.int64), "nodes": np.array(nodes, np.int32), "bits": np.array(bits, np.int8), "odds": odds}


def _runs(lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """(text, from, to) that are predicted together: whole texts, or a part of a long one by itself."""
    some, size = [], 0
    for text, n in enumerate(lengths):
        if some and size + n > RUN:
            yield some
            some, size = [], 0
        if n > RUN:
            for at in range(0, n, RUN):
                yield [(text, at, min(at + RUN, n))]
            continue
        some.append((text, 0, n))
        size += n
    if some:
        yield some


class Bits:
    """The bits of a run of texts: word and place of each, its slots, and what its text did there before."""

    def __init__(self, codes: dict, table: int, texts: list[np.ndarray], run: list[tuple[int, int, int]], past: np.ndarray | None):
        marks = len(codes["starts"])
        words = np.concatenate([texts[t][a:b] for t, a, b in run]).astype(np.int64)
        # Before a text lie two marks.
        behind = [np.concatenate([np.full(max(0, back - a), marks), texts[t][max(0, a - back):max(0, b - back)]])[:b - a] for back in (1, 2) for t, a, b in run]
        last, second = (np.concatenate(behind[i * len(run):(i + 1) * len(run)]).astype(np.uint64) for i in (0, 1))
        own = np.repeat(np.arange(len(run)), [b - a for _, a, b in run])
        sizes = (codes["starts"][1:] - codes["starts"][:-1])[words]
        total = int(sizes.sum())
        self.word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(total) + np.repeat(codes["starts"][words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        self.node, self.bit = codes["nodes"][at].astype(np.int64), codes["bits"][at].astype(np.int64)
        one = (last + np.uint64(1)) * SALTS[0]
        two = ((second + np.uint64(1)) * SALTS[1] ^ one) * SALTS[0]
        shift = np.uint64(64 - table)
        self.slots = []
        nodes = self.node.view(np.uint64)
        for context in (one, two):
            context = context ^ (context >> np.uint64(29))
            mixed = np.repeat(context, sizes)
            mixed += nodes
            mixed *= SALTS[1]
            mixed ^= mixed >> np.uint64(32)
            mixed *= SALTS[2]
            mixed >>= shift
            self.slots.append(mixed.view(np.int64))
        # Bits by text and place, in their order: those before in their group are what the text did there so far.
        places = len(codes["odds"])
        wide = np.uint64(max(1, total).bit_length())
        order = np.repeat((own * places).astype(np.uint64), sizes)
        order += nodes
        order <<= wide
        order |= np.arange(total, dtype=np.uint64)
        order.sort()
        group, order = order >> wide, (order & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
        ones = np.cumsum(self.bit[order]) - self.bit[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if total else np.zeros(0, np.int64)
        since = np.repeat(first, np.diff(np.concatenate([first, [total]])))
        self.before = np.zeros((2, total), np.float32)
        self.before[1, order] = ones - ones[since]
        self.before[0, order] = np.arange(total) - since - (ones - ones[since])
        if past is not None:
            self.before += past[:, self.node]

    def remember(self, places: int) -> np.ndarray:
        return np.stack([np.bincount(self.node[self.bit == b], minlength=places) for b in (0, 1)]).astype(np.float32)


def all_bits(codes: dict, table: int, texts: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int, int]], Bits]]:
    past = None
    for run in _runs(list(map(len, texts))):
        text, start, end = run[0]
        if start == 0:
            past = None
        found = Bits(codes, table, texts, run, past)
        yield run, found
        if end - start < len(texts[text]):
            past = found.remember(len(codes["odds"])) + (0 if past is None else past)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))


def _class(seen: np.ndarray) -> np.ndarray:
    return (seen > 0).astype(np.int8) + (seen > 3) + (seen > 15)


def _inputs(codes: dict, found: Bits, orders: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray]:
    x = [codes["odds"][found.node], *[odds for odds, _ in orders], _odds(*found.before)]
    gate = _class(found.before.sum(axis=0)).astype(np.int64)
    for _, seen in orders:
        gate = gate * CLASSES + seen
    return x, gate


def _mixed(weights: np.ndarray, x: list, gate: np.ndarray) -> np.ndarray:
    return np.clip(sum((weights[i][gate] * x[i] for i in range(len(x))), weights[-1][gate]), -20, 20)


class Learner:
    """What one task learns: counts by slot, and weights by gate."""

    def __init__(self, codes: dict, table: int):
        self.codes, self.table, self.learned = codes, table, 0
        self.counts = np.zeros((2, 2 << table), np.float32)
        self.weights = np.tile(START[:, None], (1, GATES))
        self.spent = np.full_like(self.weights, 1e-4)

    def learn(self, texts: list[np.ndarray]) -> None:
        for _, found in all_bits(self.codes, self.table, texts):
            # Both counts of a slot lie side by side and are fetched as one.
            seen = [c.view(np.complex64)[s] for c, s in zip(self.counts, found.slots)]
            x, gate = _inputs(self.codes, found, [(_odds(n.real, n.imag), _class(n.real + n.imag)) for n in seen])
            bit = found.bit.astype(np.float32)
            for at in range(0, len(gate), LEARN_BITS):
                part = slice(at, at + LEARN_BITS)
                some, chosen = [v[part] for v in x], gate[part]
                error = (bit[part] - 1 / (1 + np.exp(-_mixed(self.weights, some, chosen)))) / np.float32(len(chosen))
                for i in range(INPUTS):
                    slope = np.bincount(chosen, error * some[i] if i < len(some) else error, GATES).astype(np.float32)
                    self.spent[i] += slope ** 2
                    self.weights[i] += RATE * slope / np.sqrt(self.spent[i])
            for c, s in zip(self.counts, found.slots):
                np.add.at(c, 2 * s + found.bit, np.float32(1))
            self.learned += len(gate)


def model(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Log odds, in steps of 1 / FINE, and classes of the slots, as they are read by `costs`."""
    zeros, ones = counts[:, 0::2], counts[:, 1::2]
    return {"slots": np.clip(np.rint(_odds(zeros, ones) * FINE), -127, 127).astype(np.int8), "seen": _class(zeros + ones).astype(np.int8)}


def packed(counts: np.ndarray) -> bytes:
    """Counts, whole numbers, on their way: the bytes of a value apart, as most are small."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def costs(codes: dict, table: int, learned: dict, weights: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Natural logarithms of the probabilities of the words of each text, an array of codes, after those before them."""
    out = [np.zeros(len(t)) for t in texts]
    # Odds and class of a slot lie side by side and are fetched as one.
    both = learned["slots"].astype(np.int16) * CLASSES + learned["seen"]
    for run, found in all_bits(codes, table, texts):
        held = [both[i][s] for i, s in enumerate(found.slots)]
        orders = [((h >> 2).astype(np.float32) * np.float32(1 / FINE), h & 3) for h in held]
        mixed = _mixed(weights, *_inputs(codes, found, orders))
        # log(1 + exp(-m)) for a 1, log(1 + exp(m)) for a 0.
        wrong = np.where(found.bit == 1, -mixed, mixed)
        price = np.maximum(wrong, 0) + np.log(1 + np.exp(-np.abs(wrong)))
        by_word = np.bincount(found.word, price, sum(b - a for _, a, b in run))
        at = 0
        for t, a, b in run:
            out[t][a:b] = -by_word[at:at + b - a]
            at += b - a
    return out
