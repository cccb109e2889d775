import numpy as np
import pytest

from tableloom.operators import boxes, pairwise, recommend
from tableloom.operators.recommend import Settings

from test_similarity import sims_of


def directions(n=400, d=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * rng.uniform(0.2, 3, size=(n, 1))
    # Copies, vectors that differ by what rounding leaves, the same direction at twice the length, and vectors of length zero.
    x[50:110], x[110:140], x[140:160] = x[1], x[2] * (1 + 1e-16 * np.arange(30))[:, None], 2 * x[3]
    x[-3:] = 0
    return x


def framed(spark, x, name=int):
    kind = "long" if name is int else "string"
    return spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"id {kind}, vec array<double>").repartition(3)


@pytest.mark.parametrize("limit", [0.3, None])
@pytest.mark.parametrize("name", [int, lambda i: f"k{i:04d}"])
def test_top_n_by_boxes(spark, name, limit):
    x = directions()
    sims, found = sims_of(x), {}
    for r in boxes.cosine_topn(framed(spark, x, name), 4, limit, 20).collect():
        found.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["similarity"])
    for i in range(len(x)):
        want = sorted([(-sims[i, j], j) for j in range(len(x)) if j != i and (limit is None or sims[i, j] >= limit)])[:4]
        assert [found.get(name(i), {}).get(k + 1) for k in range(4)][:len(want)] == [(name(j), -s) for s, j in want]
        assert len(found.get(name(i), {})) == len(want)


@pytest.mark.parametrize("limit", [0.9, -0.4])
def test_counts_by_boxes(spark, limit):
    x = directions()
    want = (sims_of(x) >= limit).sum(axis=1)
    counts = {r["id"]: r["n"] for r in boxes.cosine_counts(framed(spark, x), limit, None, 20).collect()}
    assert counts == dict(enumerate(want.tolist()))
    capped = {r["id"]: min(r["n"], 5) for r in boxes.cosine_counts(framed(spark, x), limit, 5, 20).collect()}
    assert capped == dict(enumerate(np.minimum(want, 5).tolist()))


@pytest.mark.parametrize("around", [0.01, 0.0])
def test_facts_of_the_matrix_by_boxes(spark, monkeypatch, around):
    """Also where the guesses are wrong."""
    monkeypatch.setattr(boxes, "AROUND", around)
    monkeypatch.setattr(boxes, "GUESSED", 40)
    x = directions()
    full = sims_of(x)
    steps = np.rint((full + 1e-9) * 1e6) / 1e6
    facts = boxes.matrix_facts(framed(spark, x), {"min_positive": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75}, (0.3, 0.5), 20)
    assert (facts["size"], facts["max"], facts["positive"]) == (len(x), 1.0, (full > 0).sum())
    assert facts["mean"] == pytest.approx(full.mean()) and facts["above"] == [(full > 0.3).sum(), (full > 0.5).sum()]
    assert facts["quantiles"]["min_positive"] == steps[full > 0].min()
    assert [facts["quantiles"][q] for q in ("q25", "q50", "q75")] == pytest.approx(np.percentile(steps[full > 0], [25, 50, 75]).tolist(), abs=1e-9)
    assert boxes.matrix_facts(framed(spark, np.zeros((50, 3))), {"q50": 0.5}, (0.3,), 20)["quantiles"] == {"q50": None}


def test_many_vectors_of_few_dimensions_go_by_boxes(spark, monkeypatch):
    """And see a small part of the others only."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    monkeypatch.setattr(boxes, "MANY", 1000)
    monkeypatch.setattr(boxes, "BOX", 50)
    asked, plain = [], boxes._asked

    def noted(*args):
        asked.append(plain(*args))
        return asked[-1]

    monkeypatch.setattr(boxes, "_asked", noted)
    vectors, sims = framed(spark, x), sims_of(x)
    found = {(r["id"], r["rank"]): r["other"] for r in pairwise.cosine_topn(vectors, 3, 0.3).collect()}
    for i in range(len(x)):
        assert [found[i, k] for k in (1, 2, 3)] == [j for _, j in sorted((-sims[i, j], j) for j in np.argsort(-sims[i])[:8] if j != i)[:3]]
    got = recommend.param_impact(vectors, Settings(10, 0.9)).first()
    kept = np.minimum((sims >= 0.9).sum(axis=1), 10)
    assert (got["avg_similar"], got["with_enough"], got["n_entities"]) == (pytest.approx(kept.mean()), (kept == 10).sum(), 3000)
    stats = recommend.similarity_stats(vectors).first()
    assert stats["mean_above_03"] == pytest.approx((sims > 0.3).sum() / 3000) and stats["q50"] == pytest.approx(np.median(np.rint((sims + 1e-9) * 1e6)[sims > 0]) / 1e6)
    assert len(asked) == 2 and all(a.count() < 10 * len(x) for a in asked)


def test_items_of_one_user_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(recommend, "LIST", 2)
    neighbours = spark.createDataFrame([(1, 2, 0.8, 1), (1, 3, 0.4, 2), (4, 2, 0.5, 1)], "id long, other long, similarity double, rank int")
    owned = spark.createDataFrame([(1, 10), (1, 11), (1, 15), *[(2, i) for i in range(10, 15)], (3, 13), (3, 15), (3, 16)], "user long, item int")
    recs = recommend.recommend_user(neighbours, owned, 3)
    assert {(r["user"], r["rank"]): (r["item"], r["confidence"]) for r in recs.collect()} == {
        (1, 1): (12, 0.8), (1, 2): (14, 0.8), (1, 3): (13, 0.6), (4, 1): (10, 0.5), (4, 2): (11, 0.5), (4, 3): (12, 0.5)}
    why = {(r["user"], r["item"]): (r["n_neighbours"], r["evidence"]) for r in recommend.reco_evidence(neighbours, owned, recs).collect()}
    assert why[1, 13] == (2, "2:0.8000, 3:0.4000") and why[1, 12] == (1, "2:0.8000") and len(why) == 6
