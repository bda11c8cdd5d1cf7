from fractions import Fraction

import numpy as np
import pytest

from slotweave.llm import queries
from slotweave.llm import whitening as K

SCHEMA = "vec_id long, embedding array<float>, x string, i string, whitened string"


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """(n, sums, deviations, values, vectors) by exact sums and a plain solver."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    once = sorted({tuple(x) for _, x in kept})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    v = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in once), n ** 3)) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(v)
    return kept, n, sums, deviation, values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(v)


def check(got, rows):
    kept, n, sums, deviation, values, vectors, trace = brute(rows)
    k = min(4, len(sums))
    assert len(got) == len(kept) * k and {r["n"] for r in got} <= {n}
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    for c in range(1, k + 1):
        mine = [r for r in got if r["component"] == c]
        assert sorted([(r["vec_id"], int(r["deviation"])) for r in mine], key=key) == sorted(deviation, key=key)
        assert mine[0]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
    return kept, n, sums, values, vectors


def test_whole_table(spark, sf_dir, tables):
    got = queries.op12_whitening(spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in tables("embeddings").collect()]
    kept, n, sums, values, vectors = check(got, rows)
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    x = np.array([v for _, v in kept]) - np.array(sums) / n
    for c in range(4):
        want = x @ vectors[:, c] / np.sqrt(values[c])
        mine = np.array([by[i, c + 1] for i, _ in kept])
        want = want if want @ mine > 0 else -want
        assert np.abs(want - mine).max() < 1e-9
    assert {r["identity_error"] for r in got}.pop() < 1e-10


def test_odd_rows(embeddings):
    base = np.random.default_rng(1).normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [
        (100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (5, base[5]), (5, base[6]),
        (None, base[7]), (None, [0.25, 0.5, 0.75]), (104, [0.5])]
    got = K.whiten(embeddings(rows)).collect()
    check(got, rows)
    assert got[0]["identity_error"] < 1e-10
    for none in ([], [(1, None)], [(1, [])]):
        assert K.whiten(embeddings(none)).collect() == []
    same = K.whiten(embeddings([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["whitened"], r["explained"], r["n"], int(r["deviation"])) for r in same} == {(0.0, 0.0, 1, 0)} and len(same) == 4


def test_large_entries_stay_exact(embeddings):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [1e10, 2.5]), (4, [5.0, -1.0])]
    check(K.whiten(embeddings(rows)).collect(), rows)


@pytest.mark.parametrize("values", [
    np.linspace(5, 1, 24), np.append(np.linspace(5, 3, 6), np.ones(18)), 2 + 1e-9 * np.arange(24), np.append([4, 4 - 1e-10, 4 - 3e-10], np.linspace(3, 1, 21)),
    np.append([1e6, 1e6 - 1e-5], np.linspace(1, 0, 22)), np.ones(24),
])
def test_refinement(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = K.refined(a)
    wide, xl = a.astype(np.longdouble), x.astype(np.longdouble)
    assert np.abs(xl.T @ xl - np.eye(24)).max() < 4e-15
    assert np.abs(wide @ xl - xl * got).max() < 1e-14 * np.abs(values).max()
    assert (np.diff(got) <= 1e-15 * abs(got[0])).all() and np.allclose(got, np.sort(values)[::-1], rtol=1e-12, atol=1e-14 * abs(values).max())


def test_float32_alone_would_not_do():
    """The refinement is what gives the digits: the start is float32's."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(32, 32))
    a = a @ a.T
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    off = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert off(K.refined(a)[1]) < 1e-6 * off(start)


def test_covariance_is_exact_for_hot_and_shifted_vectors(embeddings):
    rows = [(k, [1000.0 + (k % 7) / 256, 2000.0 - (k % 5) / 256, 1.0]) for k in range(200)]
    got = K.whiten(embeddings(rows)).collect()
    once = sorted({(256000 + k % 7, 512000 - k % 5, 256) for k in range(200)})
    v = np.cov(np.array(once).T, bias=True)
    values = np.linalg.eigvalsh(v)[::-1]
    assert {r["n"] for r in got} == {len(once)}
    assert [next(r["explained"] for r in got if r["component"] == c) for c in (1, 2)] == pytest.approx(values[:2] / values.sum(), rel=1e-12)
