"""Near-duplicate documents, repeated lines and benchmark passages against brute force."""

import hashlib
import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tableloom import session
from tableloom.llm import crowds, decontaminate, lines, simhash

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "io", "ut", "ers")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def bits(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def variants(rng, text, n):
    """Copies of a text with a word or two changed."""
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    crowd = variants(rng, prose(rng, 400), 60)
    pairs = [t for _ in range(10) for t in variants(rng, prose(rng, 250), 2)]
    odd = [None, "", "  \n\t", "One", "one", "ONE two", "É é", "x" * 5000, prose(rng, 9000)]
    alone = [prose(rng, rng.randint(3, 80)) for _ in range(30)]
    out = crowd + pairs + odd + alone + crowd[:5]
    rng.shuffle(out)
    return out


def test_near_duplicates_are_those_of_brute_force(spark, texts):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = [bits(t, 3) for t in texts]
    linked = [(a, b) for a, b in combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = components(range(len(texts)), linked)
    assert got == {i: (prints[i], groups[i]) for i in range(len(texts))}
    assert len(set(groups.values())) < len(texts) - 15


def test_a_crowd_has_more_than_pairs_and_all_its_links(spark):
    base = 0x123456789ABCDEF0
    near = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 2) for b in range(0, 40, 2)})
    far = [base ^ 0xFF00FF, base ^ 0xFF00FF ^ 3]
    signed = [x - (1 << 64) if x >> 63 else x for x in near + far]
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for distance in (1, 2):
        found = [(r["a"], r["b"]) for r in simhash.links(fps, distance).collect()]
        want = components(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance])
        assert components(signed, found) == want
        assert len(found) < 65 * len(signed)


def test_fingerprint_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar_documents(none).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "other words here now"), (7, "a b c d")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["id"]), str(r["component_id"])) for r in got) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_similar_documents_join_copies_and_leave_others(spark):
    rng = random.Random(11)
    rows, group = [], {}
    for g in range(12):
        for t in [prose(rng, 500)] * 1 + variants(rng, prose(rng, 500), 0):
            for copy in [t, t, *variants(rng, t, 3)]:
                group[len(rows)] = g
                rows.append((len(rows), copy))
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = {g: min(i for i in group if group[i] == g) for g in set(group.values())}
    assert all(got[i] == first[group[i]] or got[i] == i for i in group)
    assert sum(got[i] == first[group[i]] for i in group) >= 0.9 * len(group)


def test_similar_documents_meet_by_deletion_variants(spark):
    words = [f"w{i * 7919 % 10_007}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))]
    marks = simhash._set_marks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text", 5)
    got = {r["id"]: r for r in marks.collect()}
    for i, text in enumerate(texts):
        assert got[i]["fp"] % 2 ** 64 == simhash.fingerprint(sorted(set(simhash.shingles_of(text.encode(), 5))))
    assert len({r["fp"] for r in got.values()} | {r["fp2"] for r in got.values()}) > 3
    by = {}
    for r in simhash._set_keys(marks.withColumnRenamed("id", "node")).collect():
        by.setdefault(r["node"], set()).add(r["key"])
    assert all(len(keys) == 2 * simhash.BITS + simhash.BANDS for keys in by.values())
    variants = {i: {k for k in keys if 0 <= k < 2 * simhash.BITS << 32} for i, keys in by.items()}
    assert variants[0] & variants[1] and not variants[0] & variants[2]


def test_similar_documents_are_those_of_the_jaccard_similarity(spark):
    rng, rows, pairs = random.Random(6), [], []
    runs = lambda words: set(zip(*(words[i:] for i in range(5))))
    for edits_made in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14):
        for _ in range(20):
            words = [f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(300)]
            other = list(words)
            for at in rng.sample(range(300), edits_made):
                other[at] = "new"
            one, two = runs(words), runs(other)
            pairs.append((len(rows), len(one & two) / len(one | two)))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i + 1] == i + 1 for i, s in pairs if s < 0.8)
    near = [i for i, s in pairs if s >= 0.8]
    assert len(near) >= 60 and sum(got[i + 1] == i for i in near) >= 0.99 * len(near)


def test_hubs_find_the_groups_of_all_links(spark):
    rng = random.Random(3)
    nodes = [(n, rng.randrange(12), float(rng.randrange(60))) for n in range(150)]
    rows = spark.createDataFrame(nodes, "node bigint, key bigint, at double")
    found = crowds.groups(rows.select("key", "node"), rows.select("node", "at"), lambda a, b: F.abs(a("at") - b("at")) <= 2)
    got = {r["node"]: r["root"] for r in found.collect()}
    want = components([n[0] for n in nodes], [(a[0], b[0]) for a, b in combinations(nodes, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 2])
    assert {n: got.get(n, n) for n in want} == want


def test_families_of_keys_meet_one_after_the_other_and_leave_no_meetings(spark, tmp_path):
    rng = random.Random(9)
    rows = spark.createDataFrame([(n, rng.randrange(40), rng.randrange(100, 115), float(rng.randrange(80))) for n in range(200)], "node bigint, k1 bigint, k2 bigint, at double")
    nodes = rows.select("node", "at", F.array(F.col("at")).alias("heavy"))
    families = [rows.select(F.col(k).alias("key"), "node") for k in ("k1", "k2")]
    close = lambda a, b: F.abs(F.get(a("heavy"), F.lit(0)) - F.get(b("heavy"), F.lit(0))) <= 2
    first = lambda a, b: F.abs(a("at") - b("at")) <= 5
    steps = []

    def verify(pairs):
        root = Path(session.work_path(spark, "none")).parents[1]
        steps.extend(spark.read.parquet(str(p)).columns for p in root.glob("*/step") if (p / "_SUCCESS").exists())
        return pairs

    found = session.settled(spark, lambda: crowds.groups(families, nodes, close, verify, first=first, large=("heavy",)))
    got = {r["node"]: r["root"] for r in found.collect()}
    at = [tuple(r) for r in rows.drop("heavy").collect()]
    want = components([r[0] for r in at], [(a[0], b[0]) for a, b in combinations(at, 2) if (a[1] == b[1] or a[2] == b[2]) and abs(a[3] - b[3]) <= 2])
    assert {n: got.get(n, n) for n in want} == want
    assert steps and ["key", "n", "a", "b"] not in steps


def test_bits_of_samples_bound_what_they_have_in_common(spark):
    rng = random.Random(12)
    pool = [rng.randrange(-1 << 31, 1 << 31) for _ in range(30)] + [i << 7 for i in range(6)]
    rows = [(i, rng.sample(pool, rng.randint(0, 10)), rng.sample(pool, rng.randint(1, 10))) for i in range(300)] + [(300, None, [1])]
    df = spark.createDataFrame(rows, "id int, x array<int>, y array<int>")
    for side in ("x", "y"):
        marks = df.select("*", F.col(side).alias("sample")).select("*", *lines._sample_bits()).drop("sample")
        df = marks.withColumnsRenamed({c: f"{side}_{c}" for c in ("m0", "m1", "n_sample")})
    got = {r["id"]: r["most"] for r in df.select("id", lines._most_common(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")).alias("most")).collect()}
    common = {i: len(set(x or []) & set(y)) for i, x, y in rows}
    assert all(got[i] >= common[i] for i in range(300)) and sum(got[i] == common[i] for i in range(300)) > 60


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower().translate(str.maketrans("123456789", "0" * 9))).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_bits(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << i for i in range(63) if 2 * sum(h >> i & 1 for h in hashes) > len(words))


def test_line_dedup_is_that_of_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 24) for _ in range(12)]
    docs = []
    for i in range(40):
        own = [prose(rng, rng.randint(5, 30)) for _ in range(2)]
        shared = [rng.choice([b, b.upper() + "!!", *variants(rng, b, 2)]) for b in rng.sample(base, 3)]
        docs.append((i, "\n".join(own[:1] + shared + ["ok", "see also"] + own[1:])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[0][1]), (104, "Call 555 1234 for the best offer\nCall 555 9876 for the best offer")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id bigint, text string, n_lines string, k1 int")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(df).collect()}
    seen = [(i, n, normal(line)) for i, t in docs if t is not None for n, line in enumerate(t.split("\n"))]
    seen = [s for s in seen if len(s[2].split()) >= 5]
    distinct = sorted({s[2] for s in seen})
    prints = {d: line_bits(d.split()) for d in distinct}
    linked = [
        (a, b) for a, b in combinations(distinct, 2)
        if (prints[a] ^ prints[b]).bit_count() <= 3 and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    groups, first = components(distinct, linked), {}
    for i, n, line in seen:
        first[groups[line]] = min(first.get(groups[line], (i, n)), (i, n))
    lost = {(i, n) for i, n, line in seen if first[groups[line]] != (i, n)}
    assert linked and lost
    for i, t in docs:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in lost)
        assert got[i] == (kept, sum(a == i for a, _ in lost))


def changed(rng, line, share):
    """`line` with so many of its words replaced by others of their length."""
    words = line.split()
    for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[at] = "".join(rng.choice("vwxyzkjh") for _ in words[at])
    return " ".join(words)


def test_lines_of_the_edit_similarity_meet(spark):
    rng, rows, alike = random.Random(4), [], {}
    wanted = {(5, 0): 1, (8, 0): 1, (12, 0): 1, (24, 0): 0.97, (50, 0): 0.97, (100, 0): 0.97, (50, 0.1): 0.9}
    for case in wanted:
        for _ in range(100):
            line = prose(rng, case[0])
            other = changed(rng, line, case[1])
            if edits(line, other) <= int(0.2 * max(len(line), len(other)) + 1e-9):
                alike.setdefault(case, []).append(len(rows))
            rows.append((len(rows), f"{line}\n{other}"))
    dropped = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), wide=True).collect()}
    assert not any(n for i, n in dropped.items() if not any(i in ids for ids in alike.values()))
    for case, least in wanted.items():
        assert len(alike[case]) >= 50 and sum(dropped[i] for i in alike[case]) >= least * len(alike[case]), case


def test_short_and_unspaced_copies_go(spark):
    rows = [(1, "Sign in\n12\n---\nこれは空白のない文です\nPage one"), (2, "SIGN IN!\n57\n---\nこれは空白のない文です\nPage two")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), wide=True).collect()}
    assert got == {1: rows[0][1], 2: "57\n---\nPage two"}


def test_line_dedup_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = lines.dedup_lines(spark.createDataFrame([(None, "a b c d e f\na b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in one} == {(1, "a b c d e f"), (None, "")}


def test_line_plan_runs_no_python(spark):
    plan = lines.occurrences(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "PythonUDF" not in plan


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    words, hit, found = fold(text), set(), set()
    for item, passage in items:
        known = fold(passage)
        n = min(10, len(known))
        runs = {tuple(known[i:i + n]) for i in range(len(known) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in runs:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), hit, sorted(found)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(6, 30))) for i in range(25)] + [(90, None), (91, "..."), (92, "Été à Zürich"), (93, "bena bena"), (7, prose(rng, 12))]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 30))]
        if i % 3 == 0:
            words = rng.choice(items[:25])[1].split()
            at = rng.randrange(max(1, len(words) - 9))
            parts += [", ".join(words[at:at + rng.randint(9, 20)]).upper(), prose(rng, 5)]
        if i % 10 == 0:
            parts += ["(été) À  ZÜRICH.", "été-à-zürich", "bena bena bena", "benabena"]
        docs.append((i, " ".join(parts)))
    return docs + [(60, None), (61, ""), (62, "!?"), (3, docs[3][1])], items


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_contamination_is_that_of_brute_force(spark, passages, part_bytes):
    docs, items = passages
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate.contamination(df, bench, part_bytes=part_bytes).collect())
    want = [(i, *hits(t, items)) for i, t in docs]
    assert got == sorted((i, n, len(h), tuple(f)) for i, n, h, f in want)
    assert any(h for _, _, h, _ in want)


def test_spans_lie_in_the_original_text(spark, passages):
    docs, items = passages
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    by_id = dict(docs)
    for r in found:
        marked = sum(len(fold(by_id[r["doc_id"]][s["start"]:s["end"]])) for s in r["spans"])
        assert marked == r["n_hit"]


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0)]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert decontaminate.digest_of([]) == hashlib.sha256(b"").hexdigest()
    assert np.array_equal(decontaminate.merge([(3, 5), (1, 3), (8, 9)]), [(1, 5), (8, 9)])
