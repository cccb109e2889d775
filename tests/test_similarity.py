import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.operators import pairwise, recommend
from tableloom.operators.recommend import Settings


def matrix(n=90, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(1)
    x[: n // 3] = x[0]  # a third of all vectors are copies
    x[-1] = 0
    return x


def sims_of(x):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return np.round((unit @ unit.T + 1e-15) * 1e12) / 1e12


@pytest.fixture(scope="module")
def data(spark):
    x = matrix()
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize("block", [7, 30, 1000])
def test_top_n_with_ties(data, block):
    x, vectors = data
    sims = sims_of(x)
    got = {}
    for r in pairwise.cosine_topn(vectors, 4, 0.3, block).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["similarity"])
    for i in range(len(x)):
        want = sorted([(-sims[i, j], j) for j in range(len(x)) if j != i and sims[i, j] >= 0.3])[:4]
        assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == [(j, -s) for s, j in want]
        assert len(got.get(i, {})) == len(want)


def test_top_n_without_threshold_and_text_ids(spark):
    x = matrix(12, 3, 5)
    vectors = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    sims = sims_of(x)
    got = {(r["id"], r["rank"]): r["other"] for r in pairwise.cosine_topn(vectors, 3, None, 5).collect()}
    for i in range(12):
        want = [j for _, j in sorted((-sims[i, j], j) for j in range(12) if j != i)[:3]]
        assert [got[f"k{i:02d}", k] for k in (1, 2, 3)] == [f"k{j:02d}" for j in want]


@pytest.mark.parametrize("block", [11, 1000])
def test_pairs_buckets_counts(data, block):
    x, vectors = data
    sims = sims_of(x)
    n = len(x)
    pairs = {(r["id_a"], r["id_b"]): r["similarity"] for r in pairwise.cosine_pairs(vectors, 0.5, block).collect()}
    assert pairs == {(i, j): sims[i, j] for i in range(n) for j in range(i + 1, n) if sims[i, j] >= 0.5}
    packed = pairwise.pack_blocks(vectors, block)
    steps = np.rint((sims + 1e-9) * 1e6).astype(int)
    buckets = np.ceil(np.rint(sims * 1e12) / 1e9).astype(int)
    got = {r["bucket"]: (r["n"], r["total"]) for r in pairwise.cosine_buckets(vectors, packed).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: (buckets == k).sum() for k in np.unique(buckets).tolist()}
    assert all(np.isclose(total, sims[buckets == k].sum(), atol=1e-9) for k, (_, total) in got.items())
    some = [1000, int(buckets.min())]
    values, counts = np.unique(steps[np.isin(buckets, some)], return_counts=True)
    assert {r["step"]: r["n"] for r in pairwise.cosine_values(vectors, some, packed).collect()} == dict(zip(values.tolist(), counts.tolist()))
    counts = {r["id"]: r["n"] for r in pairwise.cosine_counts(vectors, 0.5, block).collect()}
    assert counts == {i: int((sims[i] >= 0.5).sum()) for i in range(n)}


def test_blocks_that_cannot_matter_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(4)
    # Forty narrow directions, one of them with a third of the vectors, opposite ones and vectors of length zero among them.
    centres = rng.normal(size=(40, 4))
    centres[1] = -centres[0]
    x = np.concatenate([centres[rng.integers(0, 40, 500)] + 0.02 * rng.normal(size=(500, 4)), np.repeat(centres[:1], 250, axis=0), np.zeros((6, 4))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    sims, n = sims_of(x), len(x)
    seen, plain = [], pairwise.tiles_of

    def counted(*args, **options):
        tiles = plain(*args, **options)
        seen.append((args[0].blocks, tiles.count()))
        return tiles

    monkeypatch.setattr(pairwise, "tiles_of", counted)
    monkeypatch.setattr(pairwise, "FEW_BLOCKS", 3)
    monkeypatch.setattr(pairwise, "DIRECTED", 100)
    monkeypatch.setattr(pairwise, "NARROW_BLOCK", 20)
    for limit in (0.95, -0.95):
        counts = {r["id"]: r["n"] for r in pairwise.cosine_counts(vectors, limit, 20).collect()}
        assert counts == {i: int((sims[i] >= limit).sum()) for i in range(n)}
    pairs = {(r["id_a"], r["id_b"]) for r in pairwise.cosine_pairs(vectors, 0.95, 20).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(sims >= 0.95)) if i < j}
    found = {}
    for r in pairwise.cosine_topn(vectors, 3, None, 20).collect():
        found.setdefault(r["id"], {})[r["rank"]] = r["other"]
    for i in range(n):
        assert [found[i][k] for k in (1, 2, 3)] == [j for _, j in sorted((-sims[i, j], j) for j in range(n) if j != i)[:3]]
    buckets = np.ceil(np.rint(sims * 1e12) / 1e9).astype(int)
    assert sum(r["n"] for r in pairwise.cosine_values(vectors, [1000, 3]).collect()) == np.isin(buckets, [1000, 3]).sum()
    # Blocks of 20 rows: most pairs of blocks are left out.
    assert len(seen) == 5 and all(tiles < blocks * (blocks + 1) / 2 * 0.6 for blocks, tiles in seen[:4])


@pytest.mark.parametrize("d", [2, 20])
def test_distances(spark, d):
    x = np.random.default_rng(1).normal(size=(60, d))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    for k in (1, 3):
        got = {r["id"]: r["distance"] for r in pairwise.nearest_distances(vectors, k, 13).collect()}
        assert np.allclose([got[i] for i in range(60)], np.sort(dist, axis=1)[:, k - 1], atol=1e-6)


def test_statistics_equal_the_matrix(data):
    x, vectors = data
    full = sims_of(x)
    # Single values are given to the sixth digit; thresholds are compared in full.
    sims = np.rint((full + 1e-9) * 1e6) / 1e6
    got = recommend.similarity_stats(vectors, 17).first()
    n = len(x)
    assert got["n_entities"] == n and got["max_similarity"] == 1.0 and got["min_positive"] == sims[full > 0].min()
    assert got["mean_similarity"] == pytest.approx(sims.mean())
    assert [got["q25"], got["q50"], got["q75"]] == pytest.approx(np.percentile(sims[full > 0], [25, 50, 75]).tolist())
    assert got["mean_above_03"] == pytest.approx((full > 0.3).sum() / n)
    assert got["strong_pair_pct"] == pytest.approx((full > 0.5).sum() / 2 / (n * (n - 1) / 2) * 100)


def test_parameter_impact_golden(spark):
    # Three directions with similarities .5 (0-1), .2 (0-2) and .1 (1-2).
    gram = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    x = np.linalg.cholesky(gram)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    counts = {r["id"]: r["n"] for r in pairwise.cosine_counts(vectors, 0.3).collect()}
    assert counts == {0: 2, 1: 2, 2: 1}
    got = recommend.param_impact(vectors, Settings(3, 0.3)).first()
    assert (got["with_enough"], got["n_entities"], got["avg_similar"]) == (0, 3, pytest.approx(5 / 3)) and got["warning"]
    shown = {r["id"]: (r["n_similar"], r["note"]) for r in recommend.preview(vectors, Settings(3, 0.3), enough=1).collect()}
    assert shown == {0: (1, "enough"), 1: (1, "enough"), 2: (0, "none")}


def test_user_recommendation_golden(spark):
    neighbours = spark.createDataFrame([("u1", "u2", 0.8, 1), ("u1", "u3", 0.4, 2)], "id string, other string, similarity double, rank int")
    owned = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u2", "b"), ("u3", "b"), ("u3", "c")], "user string, item string")
    recs = recommend.recommend_user(neighbours, owned)
    assert [(r["item"], r["confidence"]) for r in recs.orderBy("rank").collect()] == [("b", 0.6), ("c", 0.4)]
    text = recommend.reco_table(recs, "user", "item").first()
    assert text["recommended"] == "b (0.60), c (0.40)" and text["mean_confidence"] == 0.5 and text["n_recommendations"] == 2
    why = {r["item"]: (r["n_neighbours"], r["evidence"]) for r in recommend.reco_evidence(neighbours, owned, recs).collect()}
    assert why == {"b": (2, "u2:0.8000, u3:0.4000"), "c": (1, "u3:0.4000")}
    metrics = recommend.reco_metrics(recs, "user", "item", owned.select("user").distinct()).first()
    assert (metrics["n_served"], metrics["n_products"], metrics["coverage_pct"]) == (1, 2, pytest.approx(100 / 3))


def test_settings_and_approach(spark):
    assert recommend.PRESETS["High Precision"] == Settings(3, 0.6)
    with pytest.raises(ValueError):
        Settings(2, 0.3)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b")], "u int, i string")
    assert recommend.choose_approach(df, "i", "u").first()["approach"] == "user_based"
    assert recommend.choose_approach(df, "i").first()["approach"] == "item_based"
    assert recommend.min_interactions(df, "u", "i", 2).select("i").distinct().collect()[0][0] == "a"
    assert recommend.recommend_item(spark.createDataFrame([(1, 2, 0.7, 1)], "id int, other int, similarity double, rank int")).first()["confidence"] == 0.7
