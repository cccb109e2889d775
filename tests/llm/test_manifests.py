"""URL filters, the Merkle manifest and whitening against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.llm import manifest, urls, whitening
from tableloom.llm.common import batches

# --- URL filters

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.Example.ORG/en/148.html?q=1", "ftp://example.org/en", "http://org/", "http://org", "http://com/fr/?x",
    "http://x.com/de/1#y", "http://x.com/de", "http://notexample.org/es/", "http://exam.com#/fr/", "http://a.com?/de/://b.org/es/", "http://É.org/Ä/", "x://y.org//es/", "://example.org/es/",
    "http://example.org:80/es/", "http://example.org./es/", "http://u@example.org/en/1", "http://example.org/en/1" + "z" * 50_000, "http://" + "a." * 3000 + "com/fr/", "http://x.com/de/1#y",
]
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("COM", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"),
    ("com", "/de/", "block"), (None, "/", "block"), ("y.org", None, "block"), ("b.example.org", "/en/14", "allow"),
]


def judged(url, rules, default):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host, path = (lower(found[1]), found[2]) if found else ("", "")
    fit = [(len(h) + len(p), len(h), h, p, v) for h, p, v in ((lower(h), p or "", v) for h, p, v in rules if h is not None) if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


@pytest.mark.parametrize("shapes", [urls.MAX_SHAPES, 2])
def test_urls_are_judged_as_by_brute_force(spark, monkeypatch, shapes):
    monkeypatch.setattr(urls, "MAX_SHAPES", shapes)
    tested = [u if shapes > 2 or len(u or "") < 5000 else u[:400] for u in URLS]
    df = spark.createDataFrame([(i if i else None, u, "x", "y", 3) for i, u in enumerate(tested)], "page_id bigint, url string, host string, rule string, row int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {(r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules, default="block").collect()}
    assert got == {(i if i else None, *judged(u, RULES, "block")) for i, u in enumerate(tested)}


def test_no_urls_and_no_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://example.org/es/"), (1, "http://example.org/es/")], "page_id bigint, url string")
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert [r["rule"] for r in urls.judge_urls(df, rules).collect()] == ["example.org/es/"] * 2
    assert [tuple(r)[3:] for r in urls.judge_urls(df, rules.limit(0)).collect()] == [(None, "allow")] * 2
    with pytest.raises(ValueError):
        urls.judge_urls(df, rules, default="maybe")


def test_urls_stay_outside_python(spark):
    df = spark.createDataFrame([(1, "http://example.org/es/")], "page_id bigint, url string")
    plan = urls.judge_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves, fanout):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def proof_of(levels, at, fanout):
    steps = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return steps


def manifest_of(rows, tamper, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = ordered, tree_of([leaf_of(r) for r in ordered], fanout)
    top = tree_of([trees[n][1][-1][0] for n in names], fanout)
    out = []
    for nth, name in enumerate(names):
        for at, row in enumerate(trees[name][0]):
            steps = proof_of(trees[name][1], at, fanout) + proof_of(top, nth, fanout)
            node = leaf_of(tamper(row))
            for before, after in steps:
                node = h(before + node + after)
            out.append((row[0], row[1], leaf_of(row), tuple(steps), trees[name][1][-1][0], top[-1][0], node))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree int, root string"


@pytest.mark.parametrize("fanout, height, sizes", [
    (3, 1, {"a": 1, "b": 2, "hot": 100, None: 4, "": 3}), (3, 2, {"é": 82, "z": 9, "y": 10, "x": 28}), (2, 1, {"p": 17, "q": 33, None: 1}), (3, 6, {"a": 40, "b": 1}), (4, 1, {str(i): i for i in range(1, 23)}),
    (3, 1, {None: 1})])
def test_manifest_is_that_of_brute_force(spark, fanout, height, sizes):
    draw = random.Random(fanout * 10 + height)
    rows = []
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((draw.choice([None, draw.randrange(10**6)]), source, draw.choice(["en", None, "ñ"]), draw.choice([None, 7]), draw.choice([None, "", "a\nb", "ü:5\n" * draw.randrange(2000)]), "l", 1, "r"))
        rows.append(rows[-1])  # a row twice
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    found = manifest.manifest(df, fanout=fanout, height=height, tamper={"text": F.when(odd, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))})
    got = sorted(((r["id"], r["group"], r["leaf"], tuple((s["before"], s["after"]) for s in r["proof"]), r["subroot"], r["root"], r["folded_root"]) for r in found.collect()), key=str)
    cut = lambda r: (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 else r[4])
    assert got == manifest_of([r[:5] for r in rows], cut, fanout)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


# --- whitening


def whitened(spark, vectors, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, component string, n int").repartition(3)
    return whitening.whiten(df, **options).collect()


def by_numpy(vectors, scale, k):
    d = len(vectors[0])
    x = np.floor(np.array(vectors) * scale).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:min(k, d)]
    y = (x - s / n) @ axes[:, order] / np.sqrt(values[order])
    deviation = [sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, y, values[order] / values.sum()


@pytest.mark.parametrize("d, k, scale", [(64, 4, 256), (5, 4, 256), (2, 4, 10**9), (12, 12, 256), (1, 4, 7)])
def test_whitening_is_that_of_numpy(spark, d, k, scale):
    draw = np.random.default_rng(d)
    vectors = (draw.standard_normal((300, d)) * np.linspace(1, 3, d) @ draw.standard_normal((d, d))).tolist()
    vectors += vectors[:40] * 3
    odd = [None, [], [None] * d, [float("nan")] * d, [float("inf")] * d, [0.5] * (d + 1), [1e300] * d]
    rows = whitened(spark, vectors + odd, scale=scale, components=k)
    n, deviation, y, share = by_numpy(vectors, scale, k)
    assert len(rows) == len(vectors) * min(k, d)
    got = np.zeros_like(y)
    for r in rows:
        got[r["id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviation[r["id"]]
        assert np.isclose(r["explained"], share[r["component"] - 1], rtol=1e-9) and 0 <= r["identity_error"] < 1e-9
    assert np.allclose(got * np.sign((got * y).sum(axis=0)), y, rtol=1e-8, atol=1e-9)


def test_whitening_without_variance(spark):
    assert whitened(spark, []) == [] and whitened(spark, [None, []]) == [] and whitened(spark, [[1.0, 2.0]] * 3) == []
    # One direction of variance: no more components than that.
    rows = whitened(spark, [[float(i), 2.0 * i, 0.0] for i in range(5)])
    assert {r["component"] for r in rows} == {1} and len(rows) == 5


def test_feast_finds_what_inertia_counts(spark):
    draw = np.random.default_rng(3)
    q, _ = np.linalg.qr(draw.standard_normal((30, 30)))
    for values in (np.r_[9, 9, 9, np.linspace(1, 0, 27)], np.r_[np.full(29, 2.0), 5], np.geomspace(1e6, 1e-6, 30), np.full(30, 3.0)):
        v = q * values @ q.T
        v = (v + v.T) / 2
        shifts = np.array([-1.0, 0.51, 4.0, 8.0, 1e9])
        assert (whitening.above(shifts, *whitening.tridiagonal(v)) == (values[:, None] > shifts).sum(axis=0)).all()
        found, vectors = whitening.feast(spark, v, 4)
        assert np.allclose(found, np.sort(values)[::-1][:4], rtol=1e-12)
        assert np.abs(v @ vectors - vectors * found).max() < 1e-12 * values.max() and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert whitening.feast(spark, np.zeros((3, 3)), 2)[0].size == 0


@pytest.fixture(autouse=True)
def bounded(spark):
    batches(spark)
