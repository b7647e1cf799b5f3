import numpy as np
import pytest

from tidemark.llm import covertree as ct

SCHEMA = "vec_id long, embedding array<float>, label int, uid int, x int, score int, rank int"


def rows_of(ids, vectors):
    return [(i, v, 0, 1, 2, 3, 4) for i, v in zip(ids, vectors, strict=True)]


def brute(rows, k=5, every=50):
    ok = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(ok) if b != a)[:k]
            out += [(q, r + 1, i, int(-x)) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("data_block, query_block", [(8192, 2048), (100, 3)])
def test_equals_all_products(spark, data_block, query_block):
    r = np.random.default_rng(0)
    centres = r.standard_normal((6, 8))
    v = (centres[r.integers(0, 6, 700)] + 0.2 * r.standard_normal((700, 8))).astype(np.float32)
    v[100:160] = v[100]  # ties and repeats
    rows = rows_of(range(700), v.tolist())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ct.top_inner_products(df, lambda k: k % 50 == 0, data_block=data_block, query_block=query_block)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_odd_rows(spark):
    rows = rows_of([0, 50, 1, 2, 3, None, 4, 4, 100, 5], [[1.0, 2.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [1.0, None], [9.0, 9.0], [0.5, 0.5], [0.5, 0.5], [], [2.0]])
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(x) for x in ct.top_inner_products(df, lambda k: k % 50 == 0).collect())
    assert got == [(0, 1, 5, 131072), (0, 2, 4, 98304), (0, 3, 4, 98304), (0, 4, 100, 0), (100, 1, 0, 0), (100, 2, 4, 0), (100, 3, 4, 0), (100, 4, 5, 0)]
    assert ct.top_inner_products(df.where("false"), lambda k: k % 50 == 0).count() == 0
    assert ct.top_inner_products(df, lambda k: k < 0).count() == 0


def test_products_beyond_doubles(spark):
    rows = rows_of([0, 1, 2], [[1e12, 1.0], [1e12, 0.5], [1e12, 0.25]])
    x = [[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v, *_ in rows]
    got = [tuple(r) for r in ct.top_inner_products(spark.createDataFrame(rows, SCHEMA), lambda k: k == 0).collect()]
    top = np.iinfo(np.int64).max
    assert got == [(0, i + 1, v, min(top, sum(a * b for a, b in zip(x[0], x[v], strict=True)))) for i, v in enumerate((1, 2))]


def test_tree_covers_its_rows():
    x = np.floor(256 * np.random.default_rng(1).standard_normal((900, 5)))
    t = ct.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(900))
    for centre, norm, radius, a, b, children in t.nodes:
        assert np.sqrt(((x[t.order[a:b]] - centre) ** 2).sum(1)).max() <= radius + 1e-9
        assert abs(norm - np.sqrt(centre @ centre)) < 1e-9
        if children:
            assert sorted((t.nodes[c][3], t.nodes[c][4]) for c in children)[0][0] == a and sum(t.nodes[c][4] - t.nodes[c][3] for c in children) == b - a


def scattered(n, clusters, width, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.floor(256 * (centres[r.integers(0, clusters, n)] + spread * r.standard_normal((n, width))))


@pytest.mark.parametrize("clusters, spread, most", [(60, 0.005, 0.25), (60, 0.02, 0.5), (1, 1.0, 1.0)])
def test_pruned_share(clusters, spread, most):
    x = scattered(4000, clusters, 32, spread, 4)
    x[50:90] = x[50]
    ids, q = np.arange(4000), np.arange(0, 4000, 10)
    s, i, computed = ct.dual_search(x[q], x, ids, q, ids, 5)
    every = x[q] @ x.T
    every[np.arange(len(q)), q] = -np.inf
    pick = np.lexsort((np.broadcast_to(ids, every.shape), -every), axis=1)[:, :5]
    assert (i == pick).all() and (s == np.take_along_axis(every, pick, 1)).all()
    assert computed <= most * len(q) * 4000


def test_children_are_separated_and_halve_the_radius():
    x = scattered(2000, 20, 6, 0.05, 1)
    t = ct.CoverTree(x)
    split = 0
    for centre, _, radius, a, b, children in t.nodes:
        if children:
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            own = [t.nodes[c] for c in children if t.nodes[c][2] <= half and t.nodes[c][4] - t.nodes[c][3] >= ct.FEW]
            gaps = [np.linalg.norm(m[0] - n[0]) for j, m in enumerate(own) for n in own[:j] if not (m[0] == n[0]).all()]
            assert all(g > half for g in gaps) and len(children) - len(own) <= 1
            split += len(own) > 1
    assert split
