import numpy as np
import pytest

from kestrel.llm import vectors
from kestrel.llm.queries import op9_cap_filters


def brute(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    return hit


def test_recall_on_planted_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    # partners at a cosine just over the threshold, the hardest ones
    side = rng.standard_normal((300, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate((base, 0.905 * base + np.sqrt(1 - 0.905 ** 2) * side)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    want = brute(x.astype(float)).sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) / want.sum() >= 0.97


def test_whole_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    got = {r.vec_id: r for r in op9_cap_filters(spark, sf_small).collect()}
    want = brute(np.array([r.embedding for r in rows], float)).sum(1)
    assert len(got) == len(rows)
    assert all(got[r.vec_id].n_links <= w for r, w in zip(rows, want))
    assert sum(r.n_links for r in got.values()) >= 0.95 * want.sum()


@pytest.mark.parametrize("block", [vectors.BLOCK, 3])
def test_copies_blocks_and_edges(spark, block):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16)
    near = [(v + 0.02 * rng.standard_normal(16)).tolist() for _ in range(20)]
    rows = [(i, x) for i, x in enumerate(near)] + [(50, near[0]), (51, near[0]), (51, near[0])]
    other = rng.standard_normal(16)
    other -= (other @ v) / (v @ v) * v
    rows += [(60, other.tolist()), (61, None), (62, [0.0] * 16), (63, [float("nan")] * 16), (64, [None] * 16), (65, []),
             (66, [float("inf")] + [0.0] * 15), (67, v[:8].tolist()), (None, None), (68, (2 * other).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "vec_id", "embedding", "1 as id", "2 as v", "3 as cid")
    got = vectors.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    for i in [*range(20), 50, 51]:
        assert by[i] == [(22, 0)] * (2 if i == 51 else 1)
    assert by[60] == [(1, 60)] and by[68] == [(1, 60)]
    assert all(by[i] == [(0, i)] for i in (61, 62, 63, 64, 65, 66, 67)) and by[None] == [(0, None)]


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    how = vectors.Plan(300, 2.0, 32)
    a, b = vectors.codes(24, 300)
    for row, got in zip(x, vectors.list_decode(x, how)):
        score = (row @ a)[:, None] + (row @ b)[None, :]
        assert got.tolist() == np.nonzero(score.ravel() >= min(2.0, np.sort(score.ravel())[-how.least]))[0].tolist()


def planted(n, m, seed=1, dim=64, centres=0):
    """n vectors (around ``centres``, if any), the last m partners of the first at a
    cosine of 0.905, just over the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n - m, dim))
    if centres:
        base += 1.5 * rng.standard_normal((centres, dim))[rng.integers(0, centres, n - m)]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((m, dim))
    side -= (side * base[:m]).sum(1, keepdims=True) * base[:m]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.concatenate((base, 0.905 * base[:m] + np.sqrt(1 - 0.905 ** 2) * side))


def test_pairs_compared_grow_with_the_vectors():
    each = []
    for n in (2000, 8000, 32000):
        x = planted(n, 500)
        how = vectors.plan(n, 0.9)
        fs = [f for i in range(0, n, 1000) for f in vectors.list_decode(x[i:i + 1000], how)]
        m = np.unique(np.concatenate(fs), return_counts=True)[1]
        each.append((m * (m - 1) // 2).sum() / n)
        found = [len(np.intersect1d(fs[i], fs[n - 500 + i])) > 0 for i in range(500)]
        assert np.mean(found) >= 0.98
    assert each[2] <= 1.5 * each[0]


@pytest.mark.parametrize("few", [0, vectors.FEW])
def test_groups_hold_each_pair_once(few, monkeypatch):
    monkeypatch.setattr(vectors, "FEW", few)
    x = planted(400, 200, centres=3)
    x[:40] = x[0] + 0.02 * x[:40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    how = vectors.plan(len(x), 0.9)
    fs = vectors.list_decode(x, how)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1))) if len(np.intersect1d(fs[i], fs[j]))}
    got = []
    for low in range(0, how.size ** 2, how.span):
        for r, c in vectors.group_links(low, low + how.span, x, x, fs, fs, 0.9, True, chunk=100):
            got += zip(r.tolist(), c.tolist())
    assert len(got) == len(set(got)) and set(got) == want
    got = []
    for low in range(0, how.size ** 2, how.span):
        for r, c in vectors.group_links(low, low + how.span, x[:150], x[150:], fs[:150], fs[150:], 0.9, False):
            got += zip(r.tolist(), (c + 150).tolist())
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if i < 150 <= j}


def test_recall_on_clustered_vectors(spark):
    x = planted(3000, 1000, centres=5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    want = brute(x.astype(float)).sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(df).collect() == []
