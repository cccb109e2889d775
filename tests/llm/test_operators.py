"""Scores, packing, archives, shards, secrets, search and languages against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tableloom.llm import bitslices, language, mixing, packing, secrets, shards, warc
from tableloom.llm.common import batches
from tableloom.session import work_path

SF = "/root/testdata/sf0.001"
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return batches(spark).read.parquet(f"{SF}/documents.parquet")


# --- context mixing

TEXTS = ["the cat sat on the mat", "The CAT ate", None, "", "a\tb\na", "unseen words here", "the the the", "x" * 3000, "la casa roja es la casa", "the cat sat on the mat"]


def scored(spark, chunk_words=mixing.CHUNK_WORDS, monkeypatch=None, kind_col="kind"):
    rows = [(i, t, "es" if t and "casa" in t else None if i == 3 else "en", 1.5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, score double")
    if monkeypatch:
        monkeypatch.setattr(mixing.tokens, "__defaults__", (*mixing.tokens.__defaults__[:-1], chunk_words))
    return {r["doc_id"]: r for r in mixing.score(df, F.col("doc_id").isin(4, 5), kind_col=kind_col).collect()}


def test_base_scores_are_those_of_brute_force(spark, monkeypatch):
    got = scored(spark)
    tokens = [(t or "").lower().encode().split() + [b"\n"] for t in TEXTS]
    counts = Counter(w for i, t in enumerate(tokens) if i not in (4, 5) for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(counts[w] > 0 for w in t), n, i in (4, 5))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-12)
        assert r["score"] < 0
    # Copies cost the same, and chunks change nothing.
    assert got[0]["score"] == got[9]["score"]
    again = scored(spark, 4, monkeypatch)
    assert all(math.isclose(again[i]["score"], got[i]["score"], rel_tol=1e-9) for i in got)


def test_bits_of_a_byte_share_out_its_probability():
    mixer, counts = mixing.Mixer(), np.zeros(2 * mixing.SLOTS, np.float32)
    words = [bytes([b]) for b in range(33, 256)] + [mixing.END]
    for at, some, lengths in mixing._batches([b"abc", b"abd", b"zz"] * 3, 64):
        for slots, bit, place in mixing.bits_of(some, lengths):
            for k in range(mixing.ORDERS):
                np.add.at(counts, 2 * slots[k] + bit, 1)
            mixer.learn(counts, slots, bit, place, np.ones(len(bit), np.float32))
    # First bytes: the probabilities of all one-byte prefixes sum to no more than 1, and to 1 with those left out.
    first = np.zeros(256)
    data = np.arange(256, dtype=np.uint8).reshape(-1, 1)
    cost = mixer.cost(counts, data, np.ones(256, np.int64))
    first[:] = 10 ** cost
    assert math.isclose(first.sum(), 1.0, rel_tol=1e-5)
    assert len(words) == 224


def test_a_step_of_learning_is_the_plain_one_and_adds_nothing_bit_by_bit(monkeypatch):
    rng = np.random.default_rng(3)
    counts, n = np.zeros(2 * mixing.SLOTS, np.float32), 500
    slots = rng.integers(0, 4000, (mixing.ORDERS, n)) + mixing.OFFSETS[:-1, None]
    bit, weight = rng.integers(0, 2, n), rng.integers(1, 9, n).astype(np.float32)
    for k in range(mixing.ORDERS):
        np.add.at(counts, 2 * slots[k] + bit, weight)
    plain, mixer = mixing.Mixer(), mixing.Mixer()
    zeros, ones = np.maximum(counts[2 * slots] - (1 - bit), 0), np.maximum(counts[2 * slots + 1] - bit, 0)
    both = zeros + ones
    gate = np.minimum(np.log2(both[5] + 1), mixing.SIGHTS - 1).astype(int) * mixing.NEAR + (both[4] > 0) + (both[4] > 8)
    x = np.vstack([np.log((ones + mixing.PRIOR) / (zeros + mixing.PRIOR)), np.ones(n)]).T
    mixed = ((plain.by_sight[gate] + plain.by_place[5]) * x).sum(axis=1)
    step = ((bit - 1 / (1 + np.exp(-mixed))) * weight / weight.sum())[:, None] * x
    slope, at_place = np.zeros_like(plain.by_sight), np.zeros_like(plain.by_place)
    np.add.at(slope, gate, step)
    at_place[5] = step.sum(axis=0)
    plain._go(0, slope, mixing.RATE)
    plain._go(1, at_place, mixing.RATE)

    class Numpy:
        add = None

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(mixing, "np", Numpy())
    mixer.learn(counts, slots, bit, 5, weight)
    assert np.allclose(mixer.by_sight, plain.by_sight, atol=1e-5) and np.allclose(mixer.by_place, plain.by_place, atol=1e-5)
    assert (mixer.refined != mixing.Mixer().refined).any()


def test_mixing_learns(spark, docs):
    held = language.held_out(F.col("doc_id"), 7, 2)
    rows = mixing.score(docs, held, kind_col="lang").where("held_out").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    size = sum(len((texts[r["doc_id"]] or "").encode()) + 1 for r in rows)
    assert -sum(r["score"] for r in rows) / math.log10(2) / size < 3.0
    assert mixing.score(docs.limit(0), held).count() == 0


def test_order_and_repeats_count(spark):
    sentence = "the cat sat on the mat and saw the dog run to the old house"
    mixed = "mat the dog on house old the run saw and to the sat the cat"
    rows = [(i, sentence if i < 40 else f"{'cat dog mat house'.split()[i % 4]} the old run {i}", "en") for i in range(80)]
    rows += [(100, sentence, "en"), (101, mixed, "en"), (102, "qua " * 30, "en"), (103, "qua ", "en"), (104, "x" + " the" * (mixing.phrases.RUN + 5), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in mixing.score(df, F.col("doc_id") >= 100, kind_col="lang").collect()}
    assert got[100]["n_tokens"] == got[101]["n_tokens"] and got[100]["base_score"] == pytest.approx(got[101]["base_score"])
    assert got[100]["score"] > got[101]["score"] + 2
    # A word that the text has said before costs less.
    assert got[102]["score"] > 30 * got[103]["score"] + 10
    assert 0 > got[104]["score"] > got[104]["base_score"]


def test_codes_share_out_the_probability_of_a_word():
    rng = np.random.default_rng(1)
    codes = mixing.phrases.tree([5, *range(40, 0, -1)])
    learner = mixing.phrases.Learner(codes, 16)
    learner.learn([rng.integers(0, 41, n).astype(np.int32) for n in (0, 1, 300, 2000)])
    learned = mixing.phrases.model(learner.counts)
    before = np.array([3, 7, 3], np.int32)
    every = mixing.phrases.costs(codes, 16, learned, learner.weights, [np.append(before, s).astype(np.int32) for s in range(41)])
    assert math.isclose(sum(math.exp(c[-1]) for c in every), 1.0, rel_tol=1e-5)
    # One run or several, the text is the same.
    text = rng.integers(0, 41, mixing.phrases.RUN + 100).astype(np.int32)
    whole = mixing.phrases.costs(codes, 16, learned, learner.weights, [text])[0]
    run = mixing.phrases.RUN
    mixing.phrases.RUN = 1000
    try:
        assert np.allclose(whole, mixing.phrases.costs(codes, 16, learned, learner.weights, [text])[0], rtol=1e-5)
    finally:
        mixing.phrases.RUN = run


# --- packing

def test_pieces_and_sequences_round_trip(spark, docs):
    from tokenizers import Tokenizer

    odd = [(10_001, None), (10_002, ""), (10_003, "<|endoftext|> déjà vu 東京 ́ x ２３"), (10_004, "word " * 9000), (10_002, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumn("offset", F.lit("x"))
    found = packing.pack(packing.pieces(df, VOCABULARY, RANKS, keep_ids=True))
    rows = found.collect()
    encode = Tokenizer.from_file(VOCABULARY).encode
    want = Counter()
    for r in df.collect():
        ids = np.array(encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            want[r["doc_id"], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    full = sum(r["length"] for r in rows) / (2048 * len(by))
    assert full > 0.93
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(found).collect()}
    some = sorted(by[0], key=lambda r: r["offset"])
    assert whole[0] == b"".join(r["ids"] for r in some)
    assert packing.pack(packing.pieces(docs.limit(0), VOCABULARY, RANKS)).count() == 0


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.integers(0, 50, 12).astype(float)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert x.min() >= 0 and slope.max() < 1e-6 and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    for histogram in ({1: 5}, {u: rng.randrange(200) for u in range(1, 33)}, {32: 7, 31: 100, 1: 3}, {20: 1000}, {}):
        plan = packing.plan(dict(histogram), 32)
        used = Counter()
        for combo, times in plan:
            assert sum(combo) <= 32
            for u in combo:
                used[u] += times
        assert used == Counter({u: n for u, n in histogram.items() if n})


def test_one_length_for_all(spark):
    df = spark.createDataFrame([(i % 3, 0, 1000, 5, 1000) for i in range(900)], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    rows = packing.pack(df.repartition(7)).collect()
    assert len(rows) == 900 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 900 and len({r["sequence_id"] for r in rows}) == 450


# --- archives

def test_archives_round_trip(spark):
    rng = random.Random(4)
    pages = [(i, f"http://h/{i} x", "<p>" + rng.choice(["é", "a\r\n\r\nb", "same", "z" * 5000]) + str(rng.randrange(12)) * rng.randrange(3)) for i in range(120)]
    pages += [(500, None, None), (501, "http://e", ""), (502, "http://e\r\nEvil: 1", ""), (None, "u", "no id"), (3, "http://h/3 x", pages[3][2]), (504, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, digest int")
    path = work_path(spark, "warc")
    index = warc.write_archives(df.repartition(5), path)
    rows = warc.read_records(spark, path, index).collect()
    text = [(p, (h or "").encode()) for p, _, h in pages]
    last = {}
    for p, h in text:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    want = Counter()
    for p, h in text:
        again = last[h] not in (-1, p)
        want[p, len(h), digest(h), "revisit" if again else "response", last[h] if again else None, None if again else h] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows) == want
    some = index.where("page_id % 10 = 0")
    assert warc.read_records(spark, path, some).count() == some.count()
    assert index.select("archive").distinct().count() > 1
    # The index is that of the files: whole archives are their records on end.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/archives").select("path", "content").collect()
    by = {f["path"].rsplit("/", 1)[1]: bytes(f["content"]) for f in files}
    for r in index.collect():
        record = by[r["archive"]][r["offset"]:r["offset"] + r["length"]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert sum(map(len, by.values())) == index.agg(F.sum("length")).first()[0]


def test_short_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    path = work_path(spark, "warc")
    rows = warc.read_records(spark, path, warc.write_archives(df, path, least=3)).collect()
    assert {r["page_id"]: r["refers_to"] for r in rows} == {1: None, 2: None, 3: 4, 4: None}
    empty = work_path(spark, "warc")
    assert warc.write_archives(df.limit(0), empty).count() == 0


def test_ranges_are_coalesced():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (100, 5), (106, 4)], gap=1, largest=50) == [(0, 15, 2), (100, 10, 2)]
    assert warc.coalesce_ranges([(0, 30), (30, 30)], gap=5, largest=50) == [(0, 30, 1), (30, 30, 1)]
    assert warc.coalesce_ranges([]) == []
    class Archive:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at:at + n]

    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n"
    records = [b"WARC/1.1\r\nA: %d\r\nContent-Length: %d\r\n\r\n" % (n, len(http % n) + n) + http % n + b"x" * n + b"\r\n\r\n" for n in (0, 5, 300, 7)]
    for held in (16, 100, 10_000):
        found = list(warc.heads(Archive(b"".join(records)), held))
        assert [f[1] for f in found] == list(map(len, records)) and [f[3] for f in found] == [0, 5, 300, 7]
    with pytest.raises(ValueError):
        list(warc.heads(Archive(records[0][:-30]), 16))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


# --- shards

@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards_are_those_of_prefix_sums(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["same text"] * 3 + ["é" * rng.randrange(300), None, ""])) for i in range(400)] + [(None, "n"), (5, "z" * 2000), (5, "z" * 2000)]
    got = shards.assign_shards(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, shard string").repartition(6), n).collect()
    size = lambda t: len((t or "").encode()) + 8
    order = sorted(rows, key=lambda r: (r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    total, before, want, slots = sum(size(t) for _, t in rows), 0, Counter(), Counter()
    for i, t in order:
        shard = min(n - 1, ((2 * before + size(t)) * n) // (2 * total))
        want[i, size(t), zlib.crc32((t or "").encode()), shard, slots[shard]] += 1
        slots[shard] += 1
        before += size(t)
    assert Counter(tuple(r) for r in got) == want
    weights = Counter()
    for r in got:
        weights[r["shard"]] += r["size"]
    assert max(abs(w - total / n) for w in weights.values()) <= max(size(t) for _, t in rows)


def test_shards_of_nothing_and_on_disk(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id bigint, text string")
    assert shards.assign_shards(df.limit(0), 3).count() == 0
    found, path = shards.assign_shards(df, 4), work_path(spark, "shards")
    shards.write_shards(df, found, path)
    assert spark.read.parquet(path).select("doc_id", "shard").exceptAll(found.select("id", "shard")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# --- secrets

def base_spans(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_secrets_are_those_of_brute_force(spark, docs):
    key = "AKIA" + "Q7" * 9
    rng = random.Random(0)
    odd = [
        None, "", "é token = \"" + "a1" * 20 + "\" é", f"PASSWORD:'{key}'", "token: abc token: abcdef", "apikey=abcdefg api_key := no", "fedcba9876543210" * 2,
        "secret=" + key + "é" + "ab" * 13, "Key token=ſecret toKen=abcdef", "password=" * 3 + "password1", " ".join(f"{rng.getrandbits(90):x}" for _ in range(300))]
    rows = [(r["doc_id"], r["text"], "x") for r in docs.collect()] + [(10_000 + i, t, "y") for i, t in enumerate(odd)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in
           secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()}
    for i, t, _ in rows:
        assert [s for s in got[i] if s[0] != "guess"] == base_spans(t or "")
    assert any(got.values())
    assert secrets.secret_spans(docs.limit(0)).count() == 0


def test_guess_costs():
    cost = secrets.Guesser().cost
    for cheap in ("password", "Password1", "qwerty123456", "aaaaaaaaaaaaaaaaaaaa", "20240131admin", "changeme!", "P@ssw0rd2024", "abcabcabcabc", "01-02-1999", "zaq1zaq1zaq1"):
        assert cost(cheap) < secrets.LEAST_GUESSES, cheap
    for dear in ("kT9#vX2p!z", "hunter22kzq", "04dbebab91ab85687d33", "xK8-qL3_vB7"):
        assert cost(dear) >= secrets.LEAST_GUESSES, dear
    # Never more than brute force.
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abcdefgh12345QWERTY!@password") for _ in range(rng.randint(1, 20)))
        assert cost(text) <= sum(map(secrets._char, text)) + 1e-9
    assert secrets.Guesser().reaches("kT9#vX2p!z" * 1000, 8) and not secrets.Guesser(["qq"]).reaches("q" * 900, 8)


def test_guessed_secrets_and_redaction(spark):
    texts = [
        "login: kT9#vX2p!z, pwd=password1", "https://bob:Zx8vQ1mP0w@host/x", "auth => `xK8-qL3_vB7`", "the key is under the mat", "passphrase: changeme!", "token='" + "ab12" * 8 + "'"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.secret_spans(df)
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]] for r in found.collect()}
    assert got[0] == [("guess", "kT9#vX2p!z")] and got[1] == [("guess", "Zx8vQ1mP0w")] and got[2] == [("guess", "xK8-qL3_vB7")]
    assert got[3] == got[4] == [] and [k for k, _ in got[5]] == ["assign", "hex"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df.join(found, "doc_id"), F.col("spans")).collect()}
    assert clean[0] == "login: [SECRET], pwd=password1" and clean[3] == texts[3] and clean[5] == "[SECRET]'"


# --- search

def test_bit_sliced_search_is_exact(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=9).tolist() for _ in range(150)] + [[0.5] * 9] * 30 + [[-1.0] * 9] * 3
    rows = [(i, v) for i, v in enumerate(vectors)] + [(20, vectors[3]), (400, None), (401, [1.0, None] + [0.0] * 7), (402, [float("nan")] * 9), (403, [float("inf")] * 9), (404, [1e9] * 9), (None, [1.0] * 9), (420, [3.0, 1.0]), (421, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = sorted(map(tuple, bitslices.top_k(df, F.col("id") % 20 == 0, k=7, block_rows=32, chunk_queries=4).collect()), key=str)
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(valid):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(valid) if b != a)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:7])]
    assert got == sorted(want, key=str)
    assert bitslices.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(20, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in bitslices.top_k(df, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1, 8192), (20, 2, 2, -4096)]


@pytest.mark.parametrize("q", [0, 1, 7, -7, 33, -64, 1 << 41])
def test_signed_digits(q):
    digits = bitslices.signed_digits(q)
    assert sum(s << w for w, s in digits) == q and all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:]))


# --- languages

def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    emission, change, start = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    got, moved = language.posteriors(emission, lengths, change, start, pairs=True)
    pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        want, total, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = math.exp(start[path[0]] + sum(emission[t, c, y] for t, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert np.allclose(got[:n, c], want / total)
        pairs += own / total
    assert np.allclose(moved, pairs)


def test_features_are_grams_with_marks():
    words = ["ab", "é", "abcdef"]
    flat, counts = language.features(words)
    assert counts.tolist() == [1 + sum(max(0, len(w.encode()) + 3 - n) for n in range(1, 5)) for w in words]
    alone = [language.features([w])[0] for w in words]
    assert np.array_equal(flat, np.concatenate(alone))
    # `ab` and `abcdef` begin alike.
    assert len(set(alone[0]) & set(alone[2])) >= 5


def test_held_out_accuracy(spark, docs):
    out = language.held_out(F.col("doc_id"), 4, 2)
    found = language.predict(docs, language.fit(docs.where(~out))).join(docs.select("doc_id", "lang"), "doc_id").where(out).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark, docs):
    model = language.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (4, "²³ ½"), (None, "the that with and for"), (6, "the that " * 30_000), (6, "x" * 20_000)]
    got = [tuple(r) for r in language.predict(spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, score string"), model).collect()]
    assert [r[1:] for r in got[:4]] == [("und", 0.0)] * 4 and got[4][1] == "en" and got[5][1] == "en"
    assert language.predict(docs.limit(0), model).count() == 0
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert language.predict(docs, none).where("lang_pred <> 'und'").count() == 0


def test_switches_are_seen(spark, docs):
    labeller = language.Labeller(language.fit(docs))
    by = {r["lang"]: language.words_of(r["text"]) for r in docs.where(F.length("text") > 3000).collect()}
    mixed = by["en"][:40] + by["de"][:40] + by["es"][:40]
    found = labeller.label(labeller.numbers([mixed]))[0].argmax(axis=1)
    want = np.repeat([labeller.model.languages.index(x) for x in ("en", "de", "es")], 40)
    assert (found == want).mean() > 0.9


def test_scores_beyond_a_bigint_are_ranked_in_full(spark):
    rows = [(0, [1e15, 0.0]), (1, [1e15, 1.0]), (2, [2e15, 0.0]), (3, [-2e15, 5.0]), (4, [1e300, 0.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = bitslices.top_k(df, F.col("id") == 0, k=5).orderBy("rank").collect()
    # The first is the larger product; those that fit are given.
    assert [r["vec_id"] for r in found] == [2, 1, 5, 3] and [r["score"] for r in found] == [None, None, 64 * 64 * 10**15, None]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "word " + " " * 1_000_000 + "word", "x" * 1_000_000])
def test_long_runs_are_packed(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = packing.pieces(df, VOCABULARY, RANKS).select("start", "length", "doc_tokens").orderBy("start").collect()
    assert sum(r["length"] for r in found) == found[0]["doc_tokens"] and found[0]["start"] == 0


def test_fast_and_slow_encoders_agree_around_long_runs():
    fast, slow = packing.Encoder(VOCABULARY, RANKS), packing.Encoder(VOCABULARY)
    for text in (" " * 5000 + "x", "a" * 4095 + " b", "a" * 5000, "x" + "\n " * 3000, " " * 4095):
        assert (fast(text) == slow(text)).all()
