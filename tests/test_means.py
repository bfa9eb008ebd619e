"""Recursive means against pandas, with gaps and across batches."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glasstide.functions.ewm import Mean, _Summary, blocked_means, continue_mean, recursive_means

values = st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), max_size=40)


@settings(max_examples=150, deadline=None)
@given(values, st.lists(st.integers(0, 40), max_size=4), st.floats(0.01, 0.9))
def test_any_split_gives_the_whole(series, cuts, alpha):
    x = np.array([np.nan if v is None else v for v in series], float)
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()
    last, gap, out = float("nan"), 0, []
    edges = [0, *sorted(min(c, len(x)) for c in cuts), len(x)]
    for a, b in zip(edges, edges[1:]):
        means, last, gap = continue_mean(x[a:b], alpha, last, gap)
        out.append(means)
    np.testing.assert_allclose(np.concatenate(out) if out else x, want, rtol=1e-9, atol=1e-9)


def test_known_gap():
    means, _, _ = continue_mean(np.array([np.nan, 1, 2, np.nan, 4]), 0.5, float("nan"), 0)
    np.testing.assert_allclose(means, [np.nan, 1, 1.5, 1.5, 3.1666666667])


@pytest.mark.parametrize("batch", [3, 10_000])
def test_panel_in_small_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [(s, t, float((t * 7 + len(s)) % 11) if t % 5 else None) for s in ("a", "bb", "ccc") for t in range(23)]
        df = spark.createDataFrame(rows, "symbol string, ts long, x double")
        got = recursive_means(df, [Mean("x", 0.3, "m"), Mean("x", 0.05, "n")]).toPandas().sort_values(["symbol", "ts"])
        for _, g in got.groupby("symbol"):
            for name, alpha in (("m", 0.3), ("n", 0.05)):
                np.testing.assert_allclose(g[name].astype(float), g["x"].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=False).mean(), rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    df = spark.createDataFrame([], "symbol string, ts long, x double")
    assert recursive_means(df, [Mean("x", 0.3, "m")]).count() == 0


@settings(max_examples=150, deadline=None)
@given(values, st.lists(st.integers(0, 40), max_size=4), st.floats(0.01, 0.9))
def test_chained_summaries_give_the_whole(series, cuts, alpha):
    x = np.array([np.nan if v is None else v for v in series], float)
    state = (float("nan"), 0)
    edges = [0, *sorted(min(c, len(x)) for c in cuts), len(x)]
    for a, b in zip(edges, edges[1:]):
        part = _Summary(alpha)
        for piece in (x[a : (a + b) // 2], x[(a + b) // 2 : b]):
            part.add(piece)
        state = _Summary.carried(alpha, part.told(), *state)
    want = continue_mean(x, alpha, float("nan"), 0)[1:]
    np.testing.assert_allclose(state[0], want[0], rtol=1e-9, atol=1e-9)
    assert state[1] == want[1]


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_blocks_give_the_whole(spark, blocks):
    """One symbol with nearly all rows, some small ones, gaps longer than a block, a null symbol."""
    rows = [("big", t, float((t * 7) % 11) if t % 5 and not 60 < t < 140 else None) for t in range(400)]
    rows += [(s, t, float(t % 3) if t > 2 else None) for s in ("a", "zz", None) for t in range(7)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double")
    means = [Mean("x", 0.3, "m"), Mean("x", 0.05, "n")]
    got, want = (f(df).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for f in (lambda d: blocked_means(d, means, blocks=blocks), lambda d: recursive_means(d, means)))
    pd.testing.assert_frame_equal(got, want)
    assert blocked_means(df.limit(0), means).count() == 0
