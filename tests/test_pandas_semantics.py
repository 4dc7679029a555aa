"""Per-customer scores on real data against pandas' binning semantics."""

import pandas as pd
import pytest

from tillroll.operators import clv, rfm
from tillroll.plans.catalog import cleaned


@pytest.fixture(scope="module")
def lines(spark, sf_small):
    return cleaned(spark, sf_small)


def _bins(s: pd.Series, q: int = 5) -> pd.Series:
    return pd.qcut(s, q, labels=False) + 1


def test_quintile_scores_match_pandas(lines):
    metrics = rfm.rfm_metrics(lines)
    ours = rfm.rfm_scores_quintile(metrics).toPandas().set_index("CustomerID").sort_index()
    m = metrics.toPandas().set_index("CustomerID").sort_index()
    assert (ours["R_Score"] == 6 - _bins(m["Recency"])).all()
    assert (ours["F_Score"] == _bins(m["Frequency"].rank(method="first"))).all()
    assert (ours["M_Score"] == _bins(m["Monetary"])).all()


def test_dashboard_scores_match_pandas(lines):
    metrics = rfm.rfm_metrics(lines, snapshot_scope="all")
    ours = rfm.rfm_scores_dedup(metrics).toPandas().set_index("CustomerID").sort_index()
    m = metrics.toPandas().set_index("CustomerID").sort_index()
    for col, score, invert in (("Recency", "R_Score", True), ("Frequency", "F_Score", False),
                               ("Monetary", "M_Score", False)):
        k = m[col].nunique()
        if k < 5:
            s = pd.cut(m[col], bins=k, labels=False, include_lowest=True) + 1
        else:
            s = pd.qcut(m[col], 5, labels=False, duplicates="drop") + 1
        want = 6 - s if invert else s
        assert (ours[score] == want).all(), col


def test_clv_value_segments_match_pandas(lines):
    ours = clv.clv(lines).toPandas().set_index("CustomerID").sort_index()
    labels = ["Low Value", "Medium-Low", "Medium", "Medium-High", "High Value"]
    want = pd.qcut(ours["CLV"], 5, labels=False).map(lambda i: labels[int(i)])
    assert (ours["ValueSegment"] == want).all()
