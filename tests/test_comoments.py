"""Pairwise moments in one mergeable matrix, against pandas and direct formulas."""

import numpy as np
import pandas as pd
import pytest

from trafficlens.operators import comoments as C, profile


def sample(n, k, seed, nulls=0.2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, k)) * rng.uniform(0.1, 1e3, k) + rng.uniform(-1e6, 1e6, k)
    x[:, 1] = 5.0
    x[rng.random((n, k)) < nulls] = np.nan
    return x


@pytest.mark.parametrize("nulls", [0.0, 0.3])
def test_blocks_merge_to_the_whole(nulls):
    x = sample(900, 6, 1, nulls)
    whole = C.of_block(x)
    for sizes in ([900], [1] * 900, [13, 400, 0, 487], [899, 1]):
        merged, at = None, 0
        for size in sizes:
            if size:
                one = C.Moments.of_bytes(C.of_block(x[at:at + size]).bytes())
                merged, at = one if merged is None else merged.merged(one), at + size
        for name in ("n", "mean", "squares", "products", "least", "most"):
            np.testing.assert_allclose(getattr(merged, name), getattr(whole, name), rtol=1e-9, atol=1e-6)
    want = pd.DataFrame(x).corr().to_numpy()
    want[1, :] = want[:, 1] = np.nan
    got = whole.correlation()
    off = ~np.eye(6, dtype=bool)
    np.testing.assert_allclose(got[off], want[off], rtol=1e-9)


def test_far_from_zero_and_hardly_varied():
    """Values whose squares differ in their last digits only."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 4000).astype(float)
    x = np.column_stack([1e9 + base, 1e9 - 2 * base + rng.integers(0, 2, 4000), np.full(4000, 0.1)])
    parts = [C.of_block(x[i:i + 100]) for i in range(0, 4000, 100)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.merged(part)
    assert merged.correlation()[0, 1] == pytest.approx(np.corrcoef(base, x[:, 1] - 1e9)[0, 1], rel=1e-9)
    assert np.isnan(merged.correlation()[0, 2])


def test_many_tasks_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN_IN", 3)
    x = sample(400, 5, 7)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x] + [(float("nan"), 1.0, float("inf"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(30)
    got = {(r.col_a, r.col_b): r["corr"] for r in profile.correlations(df, list("abcde")).collect()}
    want = pd.DataFrame(x, columns=list("abcde")).corr()
    assert len(got) == 10
    for (a, b), value in got.items():
        assert value is None if "b" in (a, b) else value == pytest.approx(want.loc[a, b])


def test_no_rows_and_unknown_columns(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [tuple(r) for r in profile.correlations(df, ["a", "b"]).collect()] == [("a", "b", None)]
    df = spark.createDataFrame([(None, 1), (2.0, None)], "a double, b int")
    assert [tuple(r) for r in profile.correlations(df, ["a", "b"]).collect()] == [("a", "b", None)]
