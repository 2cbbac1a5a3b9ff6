import numpy as np
import pytest

from lexibrook.llm import embeddings


def made(seed, groups, alone, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for n, spread in groups:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out += [centre + spread * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(n)]
    out += list(rng.standard_normal((alone, dim)))
    return np.array(out)[rng.permutation(len(out))]


def brute(x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    label, old = np.arange(len(x)), None
    while old is None or (label != old).any():
        old = label
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    return near.sum(axis=1), label


@pytest.mark.parametrize(("groups", "alone", "tile"), [([(40, 0.3), (9, 0.05), (5, 0.45)], 400, 1024), ([(300, 0.2)], 100, 64), ([], 50, 1024)])
def test_links_and_components_match_brute_force(spark, monkeypatch, groups, alone, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    x = made(len(groups), groups, alone).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links, label = brute(x.astype(np.float64))
    assert len(got) == len(x)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_copies_count_as_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    x = made(7, [(60, 0.2), (30, 0.45)], 100).astype(np.float32)
    x = x[np.random.default_rng(8).integers(0, len(x), 700) // 2]  # two to many copies of half of them
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links, label = brute(x.astype(np.float64))
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_edge_cases(spark):
    a = [1.0] + [0.0] * 7
    nan, inf = float("nan"), float("inf")
    rows = [(1, a), (1, a), (2, a), (None, a), (3, None), (4, [0.0] * 8), (5, [nan] + a[1:]), (6, [inf] + a[1:]), (7, [None] + a[1:]), (8, []), (9, [1.0]), (10, [2.0]), (11, [1e300] + [0.0] * 7), (12, [-1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id in (None, 1, 2, 11):
            assert (r.n_links, r.component_id, r.kept) == (4, 1, r.vec_id == 1)
        elif r.vec_id in (9, 10):
            assert (r.n_links, r.component_id) == (1, 9)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng, n = np.random.default_rng(5), 2000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for size in (500, 50_000, 3_000_000):
        met = sum(bool(set(a) & set(b)) for a, b in zip(embeddings.decoded(x[:400], size), embeddings.decoded(y[:400], size)))
        assert met >= 398
