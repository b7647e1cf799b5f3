import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, _x int, i int, n int, white int, component int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)], SCHEMA)


def plain(vectors, k=8):
    """Exact sums in Python, covariance and eigenvectors by the library routine."""
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    return n, deviation, centred @ (v / np.sqrt(np.maximum(e, 1e-300)))[:, ::-1][:, :k], e[::-1][:k] / e.sum()


@pytest.mark.parametrize("d, k", [(12, 8), (5, 8)])
def test_equals_the_plain_way(spark, d, k):
    r = np.random.default_rng(3)
    v = (r.standard_normal((300, d)) * np.linspace(3, 0.2, d) + 5).astype(np.float32)
    v[40:60] = v[40]  # repeats
    got = wh.whiten(frame(spark, v.tolist()).repartition(5)).collect()
    n, deviation, white, share = plain(v)
    assert len(got) == 300 * min(k, d) and len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-10
    sign = {}
    for g in got:
        want = white[g.vec_id, g.component - 1]
        sign.setdefault(g.component, np.sign(want * g.whitened))
        assert (g.n, g.deviation) == (n, deviation[g.vec_id])
        assert abs(g.whitened - sign[g.component] * want) < 1e-9 and abs(g.explained / share[g.component - 1] - 1) < 1e-9


def test_registered_query_over_its_table(spark, tmp_path):
    r = np.random.default_rng(4)
    v = r.standard_normal((120, 16)).astype(np.float32)
    frame(spark, v.tolist()).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_qdwh_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.orderBy("vec_id", "component").collect()
    n, deviation, white, share = plain(v)
    assert [(g.vec_id, g.component) for g in rows] == [(i, c) for i in range(120) for c in range(1, 9)]
    assert np.allclose(np.abs([g.whitened for g in rows]), np.abs(white).ravel(), atol=1e-9)
    assert {g.deviation for g in rows if g.vec_id == 7} == {deviation[7]}


def test_odd_rows(spark):
    vectors = [[1.0, 2.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [1.0, None], [3.0, 1.0], [3.0, 1.0], [2.0, 7.0], [], [5.0], [3e38, 1.0]]
    ids = [1, 2, 3, 4, 5, None, 6, 6, 8, 9, 10]
    got = wh.whiten(frame(spark, vectors, ids)).collect()
    n, deviation, white, _ = plain([vectors[i] for i in (0, 5, 6, 7)])
    assert sorted((g.vec_id or 0, g.component, g.n, g.deviation) for g in got) == sorted((i, c, n, d) for i, d in zip((1, 0, 6, 6), deviation, strict=True) for c in (1, 2))
    none = frame(spark, vectors, ids).where("false")
    assert wh.whiten(none).count() == 0 and wh.whiten(none).columns == wh.whiten(frame(spark, vectors, ids)).columns
    assert wh.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0 and wh.whiten(frame(spark, [[], None])).count() == 0
    flat = wh.whiten(frame(spark, [[float(i), 2.0 * i, 1.0] for i in range(9)])).collect()  # one direction only
    assert {g.component for g in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_deviations_beyond_longs(spark):
    vectors = [[1e13, 1.0], [-1e13, 0.5], [0.0, 0.25]]
    got = {g.vec_id: g.deviation for g in wh.whiten(frame(spark, vectors)).collect() if g.component == 1}
    _, deviation, _, _ = plain(vectors)
    assert got == {i: min(v, wh.LARGEST) for i, v in enumerate(deviation)}


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [np.linspace(1, 9, 40), np.logspace(0, -14, 30), np.repeat([5.0, 3.0, 1.0], 10), [7.0, 7.0 - 1e-9, 2.0, 0.0, 0.0], [4.0], np.concatenate([[1e6], np.full(20, 1.0)])])
def test_eigenpairs(values):
    cov = spectrum(np.asarray(values, float))
    cov = (cov + cov.T) / 2
    e, v = wh.principal(cov, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 8 * len(values) * wh.EPS * sum(values)]
    assert np.allclose(e, want, atol=1e-13 * max(values), rtol=0) and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    assert np.abs(cov @ v - v * e).max() < 1e-13 * max(values)


def test_polar_factor():
    a = spectrum([3.0, 1e-9, -1e-12, -2.0, 5.0], 1)
    u = wh.polar_factor((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-9 and abs(np.trace(u) - 1) < 1e-9
    assert wh.principal(np.zeros((3, 3)), 8)[0].size == 0 and wh.principal(np.zeros((0, 0)), 8)[0].size == 0
