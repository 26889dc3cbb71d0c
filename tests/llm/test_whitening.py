import math

import numpy as np
import pytest

from trafficlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA).repartition(parts)


def by_force(vectors, components=8):
    """n, exact deviations, eigenvalues, eigenvectors and trace, densely."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, values[::-1][:components], turned[:, ::-1][:, :components], values.sum(), centred


def check(got, vectors, components=8, ids=None, tolerance=1e-8):
    n, deviations, values, turned, trace, centred = by_force(vectors, components)
    ids = list(range(len(vectors))) if ids is None else ids
    found = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert set(found) == {(i, k + 1) for i in ids for k in range(len(values))}
    for k in range(len(values)):
        mine = np.array([found[i, k + 1]["whitened"] for i in ids])
        want = centred @ turned[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < tolerance
    for place, i in enumerate(ids):
        row = found[i, 1]
        assert row["n"] == n and row["deviation"] == deviations[place]
        assert row["identity_error"] < 1e-9
    assert all(abs(r["explained"] - values[c - 1] / trace) < 1e-10 * values[c - 1] / trace for (_, c), r in found.items())


def cloud(n, dims, spectrum, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    return (rng.standard_normal((n, dims)) * np.sqrt(spectrum) @ turn).astype(np.float32).tolist()


@pytest.mark.parametrize("name, spectrum", [
    ("falling", 2.0 ** -np.arange(48)[None, :] * 50), ("steps", np.where(np.arange(48) < 5, 30.0, 0.5)[None, :]),
    ("nearly flat", 1 - np.arange(48)[None, :] * 0.004)])
def test_whitening_equals_dense_algebra(spark, name, spectrum):
    vectors = cloud(700, 48, spectrum)
    check(W.whiten(table(spark, vectors)), vectors)


def test_filter_and_widening_in_memory():
    """The iteration alone, on spectra without a gap and with a far one."""
    class Dense:
        def __init__(self, v):
            self.v, self.count = v, 0

        def times(self, q):
            self.count += 1
            return self.v @ q

    rng = np.random.default_rng(1)
    for dims, spectrum in ((300, 1 - 1e-4 * np.arange(300)), (200, np.ones(200)), (150, 10.0 ** -np.arange(150).clip(max=12)),
                           (120, np.r_[np.full(40, 5.0), np.full(80, 4.999)]), (400, 1 / (1.0 + np.arange(400)))):
        turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        v = (turn * spectrum) @ turn.T
        values, vectors, residuals = W._leading(Dense((v + v.T) / 2), dims, 8, spectrum.sum(), rng)
        assert np.allclose(values, spectrum[:8], rtol=1e-10, atol=1e-13 * spectrum[0])
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
        assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-11 * spectrum[0]


def test_odd_rows_are_left_out(spark):
    good = cloud(60, 5, np.arange(5, 0, -1.0)[None, :], 3)
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0],
           [1e30, 0.0, 0.0, 0.0, 0.0], [0.0] * 6]
    rows = good[:30] + odd + good[30:] + [good[0], good[0]]
    ids = [i for i, v in enumerate(rows) if v in good]
    check(W.whiten(table(spark, rows)), [rows[i] for i in ids], components=5, ids=ids)


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(2)
    flat = [[float(a), float(b), 1.0, float(a), 0.5] for a, b in rng.standard_normal((40, 2))]
    got = W.whiten(table(spark, flat))
    assert {r["component"] for r in got.collect()} == {1, 2}
    assert W.whiten(table(spark, [[1.0, 2.0]] * 7)).count() == 0
    assert W.whiten(table(spark, [[1.0, 2.0]])).count() == 0


def test_empty_tables(spark):
    for rows in ([], [None, []], [[math.nan]]):
        got = W.whiten(table(spark, rows))
        assert got.count() == 0 and {"component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(got.columns)


def test_partial_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)
    vectors = cloud(200, 6, np.arange(6, 0, -1.0)[None, :], 5)
    check(W.whiten(table(spark, vectors, 40)), vectors, components=6)


def test_clashing_columns_and_reruns(spark):
    vectors = cloud(50, 4, np.arange(4, 0, -1.0)[None, :], 7)
    df = table(spark, vectors).selectExpr("*", "'x' AS n", "'y' AS whitened", "'z' AS rows", "'d' AS data")
    once, again = W.whiten(df), W.whiten(df)
    assert once.columns.count("n") == 1 and once.first()["rows"] == "z"
    assert sorted(once.collect()) == sorted(again.collect())


def test_deviation_beyond_64_bits():
    model = W.Whitening(3, [10**18])
    assert model.deviation(np.array([[10**15]])) == [None]
    model = W.Whitening(2, [7, 3])
    assert model.deviation(np.array([[1, 2], [6, 1]])) == [25 + 1, 25 + 1]
    big = W.Whitening(1 << 40, [0])
    assert big.deviation(np.array([[1 << 30]])) == [None] and big.spread(np.array([[1 << 30]]))[0][0] == 1 << 70
