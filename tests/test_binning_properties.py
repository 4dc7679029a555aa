"""Binning and quantiles equal pandas' qcut / cut / quantile semantics."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.operators import binning
from tillroll.operators.ranking import exact_quantiles

VALUES = st.one_of(
    st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=60),
    st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False).map(lambda x: round(x, 2)),
             min_size=1, max_size=60),
)


def frame(spark, vals):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, x double")


def bins_of(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


@settings(max_examples=20, deadline=None)
@given(VALUES)
def test_exact_quantiles_equal_pandas(spark, vals):
    probs = binning.quantile_probs(5) + [0.25, 0.75, 0.9]
    want = pd.Series(vals, dtype=float).quantile(probs).tolist()
    got = exact_quantiles(frame(spark, vals), "x", probs).first()[0]
    assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got, want))


@settings(max_examples=20, deadline=None)
@given(VALUES)
def test_strict_quintiles_equal_pandas_qcut(spark, vals):
    s = pd.Series(vals, dtype=float)
    try:
        want = (pd.qcut(s, 5, labels=False) + 1).tolist()
    except ValueError:  # repeated edges: the reference raises too
        with pytest.raises(Exception, match="Bin edges must be unique"):
            binning.qcut_strict(frame(spark, vals), "x", 5, "b").collect()
        return
    assert bins_of(binning.qcut_strict(frame(spark, vals), "x", 5, "b"), "b") == want


@settings(max_examples=20, deadline=None)
@given(VALUES)
def test_dashboard_scores_equal_pandas(spark, vals):
    s = pd.Series(vals, dtype=float)
    k = s.nunique()
    if k < 5:
        want = (pd.cut(s, bins=k, labels=False, include_lowest=True) + 1).tolist()
    else:
        want = (pd.qcut(s, 5, labels=False, duplicates="drop") + 1).tolist()
    got = bins_of(binning.score_dashboard(frame(spark, vals), "x", 5, "s"), "s")
    assert got == want
