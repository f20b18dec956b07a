"""Whitening against an eigenvalue routine and exact integers."""

import numpy as np
import pytest

from turnwise.llm import whitening
from turnwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def spectrum(kind, d, rng):
    return {
        "random": rng.random(d) * 300,
        "rank": np.where(np.arange(d) < 10, 100 * rng.random(d), 0),
        "repeated": np.repeat([5.0, 3, 2, 1], d // 4 + 1)[:d],
        "equal": np.ones(d),
        "decaying": 10.0 ** -np.linspace(0, 14, d),
        "nil": np.zeros(d),
    }[kind]


@pytest.mark.parametrize("kind", ["random", "rank", "repeated", "equal", "decaying", "nil"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_components_are_eigenvectors(kind, d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = q @ np.diag(spectrum(kind, d, rng)) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.components(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * size
    assert np.abs(u.T @ u - np.eye(d)).max() < 1e-13
    assert np.abs(v @ u - u * e).max() <= 1e-13 * size


def test_polar_factor():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    e, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-12


def expected(rows, top=16):
    """Per id the deviation and whitened values, from integers and an eigenvalue routine."""
    usable = [(i, c) for i, c in rows if c is not None and len(c) and all(x is not None and np.isfinite(x) for x in c)]
    x = [(i, tuple(int(np.floor(64 * float(v))) + 1_000_000 for v in c)) for i, c in usable]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(v[k] for v in fit) for k in range(len(fit[0]))]
    y = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    out = []
    for i, v in x:
        gaps = [n * a - s for a, s in zip(v, sums)]
        white = (np.array(gaps) / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        out += [(i, c + 1, n, sum(g * g for g in gaps), abs(white[c]), e[c] / np.trace(cov)) for c in range(len(e))]
    return sorted(out)


def check(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], abs=1e-7)
        assert g[5] == pytest.approx(w[5], rel=1e-8)


def result(df):
    rows = [(r[0], r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()]
    return sorted(rows)


def test_query_against_integers(spark):
    df = QUERIES["op12_qdwh_whitening"](spark, FOLDER)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(result(df), expected(rows))
    errors = {r.identity_error for r in df.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    hot = rows[0][1]
    rows += [(100 + i, hot) for i in range(500)] + [(7, rows[1][1]), (7, rows[1][1])]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [])]
    short = [(905, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + bad + short, schema).selectExpr("*", "'x' AS n", "'y' AS component", "1 AS x")
    check(result(whitening.whiten(df)), expected(rows))
    none = whitening.whiten(spark.createDataFrame(bad, schema))
    assert none.count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_vectors_without_variance_and_huge_ones(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in same] == [(1, 0, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], schema)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True}
    assert line[0].identity_error < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (None, [5.0, 6.0])], schema))
    rows = huge.collect()
    assert len(rows) == 6 and {r.n for r in rows} == {3} and any(r.deviation is None for r in rows)
