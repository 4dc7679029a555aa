"""Quantile and equal-width binning (W5-W7) as DataFrame operators.

Edges come from radix selection (scans that shuffle counts of digits only),
whose values are applied to the rows as literals.  Bins are right-closed with the lowest edge
included: ``bin = 1 + #(inner edges < v)``.  Spark's ``ntile`` splits ties
and ``Bucketizer`` is left-closed, so neither gives these bins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.radix import interpolated, quantiles, select_quantiles, select_ranks
from tillroll.operators.scalars import attach_one_row


def quantile_probs(q: int) -> list[float]:
    """Probabilities 0, 1/q, ..., 1 computed as an evenly spaced grid
    (start + i*step), so e.g. the 3rd of 5 is 0.6000000000000001."""
    step = 1.0 / q
    return [i * step for i in range(q)] + [1.0]


def bin_by_inner_edges(v: Column, inner: Column) -> Column:
    """1 + number of inner edges strictly below v (right-closed bins)."""
    return F.lit(1) + F.size(F.filter(inner, lambda e: v > e))


def qcut_strict(df: DataFrame, cols: Mapping[str, str] | str, q: int = 5, out: str | None = None) -> DataFrame:
    """Quantile bins 1..q of one column, or of several at once (column ->
    output); repeated edges raise an error, as in the reference.

    The q+1 edges are selected first, all columns in the same scans, and applied
    as literals, so the binning itself is a map-side projection."""
    cols = {cols: out or f"{cols}_bin"} if isinstance(cols, str) else cols
    probs = quantile_probs(q)
    for col, edges in quantiles(df, dict.fromkeys(cols, probs)).items():
        if edges[0] is None:  # no rows
            df = df.withColumn(cols[col], F.lit(None).cast("int"))
            continue
        if len(set(edges)) < len(edges):
            raise ValueError(f"Bin edges must be unique for column {col}: {edges}")
        inner = F.array(*[F.lit(float(e)) for e in edges[1:q]])
        df = df.withColumn(cols[col], bin_by_inner_edges(F.col(col), inner).cast("int"))
    return df


def qcut_by_rank(df: DataFrame, col: str, key: str, q: int = 5, out: str | None = None) -> DataFrame:
    """Quantile bins of the ranks by (``col``, ``key``), so without ties
    (``key`` is unique and integral).  A bin depends on the rows at the edges
    alone: their values are selected, then, inside a value, their keys.  No row
    is numbered, sorted or moved.  Rows with a null ``col`` get no bin."""
    out = out or f"{col}_bin"
    # rank r (from 0) is in bin 1 + #{k : q * r > k * (n - 1)}: above the row at rank k * (n - 1) // q
    found = select_ranks(df, {col: lambda n: [k * (n - 1) // q for k in range(1, q)]})[col]
    edges = [found.at[k * (found.n - 1) // q] + (k * (found.n - 1) // q,) for k in range(1, q)] if found.n else []
    inside = {}
    for value in dict.fromkeys(v for v, _, _ in edges):
        ranks = [r - below for v, below, r in edges if v == value]
        inside[value] = select_ranks(df.where(F.col(col) == F.lit(value)), {key: lambda n, ranks=tuple(ranks): ranks})[key].at
    above = F.lit(1)
    for value, below, r in edges:
        k = inside[value][r - below].value
        above = above + F.when((F.col(col) > F.lit(value)) | ((F.col(col) == F.lit(value)) & (F.col(key) > F.lit(k).cast("bigint"))), 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(col).isNotNull(), above).cast("int"))


def qcut_rank(df: DataFrame, rank_col: str, n_col: str, q: int = 5, out: str | None = None) -> DataFrame:
    """Quantile bins of ranks 1..n (no ties) without computing percentiles:
    the k-th inner edge of 1..n is 1 + (n-1)*k/q, so in exact integers
    bin = 1 + #{k : q*(r-1) > k*(n-1)}."""
    out = out or f"{rank_col}_bin"
    r, n = F.col(rank_col), F.col(n_col)
    ks = F.sequence(F.lit(1), F.lit(q - 1))
    cnt = F.size(F.filter(ks, lambda k: (r - 1) * q > k * (n - 1)))
    return df.withColumn(out, (F.lit(1) + cnt).cast("int"))


def score_dashboard(df: DataFrame, cols: Mapping[str, str] | str, q: int = 5, out: str | None = None) -> DataFrame:
    """W6/W7 of one column, or of several at once (column -> output): with at
    least q distinct values, quantile bins with repeated edges dropped (possibly
    fewer than q bins); otherwise k equal-width bins over [min, max] where k is
    the number of distinct values.  Scores 1..k.

    The edges are selected first, all columns in the same scans, and applied as
    literals.  Distinct values are counted only where the selection saw fewer
    than q digits."""
    cols = {cols: out or f"{cols}_Score"} if isinstance(cols, str) else cols
    probs = quantile_probs(q)
    found = select_quantiles(df, dict.fromkeys(cols, probs))
    few = [c for c in cols if 0 < found[c].digits < q]
    distinct = dict(zip(few, df.agg(*[F.count_distinct(F.col(c)) for c in few]).first(), strict=True)) if few else {}
    for col, name in cols.items():
        s, k = found[col], distinct.get(col, q)
        if not s.n:
            df = df.withColumn(name, F.lit(None).cast("int"))
            continue
        if k < q:
            step = (s.greatest - s.least) / k
            inner = [i * step + s.least for i in range(1, k)]
        else:
            inner = sorted(set(interpolated(s, probs)))[1:-1]
        inner_col = F.array(*[F.lit(float(e)) for e in inner]) if inner else F.array().cast("array<double>")
        df = df.withColumn(name, bin_by_inner_edges(F.col(col), inner_col).cast("int"))
    return df


def equal_width_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins over [min, max] (the maximum
    falls into the last bin).  Returns bin, bin_start, bin_end, count."""
    stats = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    v, mn, mx = F.col(col).cast("double"), F.col("_mn").cast("double"), F.col("_mx").cast("double")
    raw_bin = F.floor((v - mn) / (mx - mn) * bins).cast("int") + 1
    b = F.when(mx == mn, F.lit(1)).otherwise(F.least(raw_bin, F.lit(bins)))
    counted = (attach_one_row(df.where(F.col(col).isNotNull()), stats)
                 .groupBy(b.alias("bin"), mn.alias("_mn"), mx.alias("_mx"))
                 .agg(F.count(F.lit(1)).alias("count")))
    width = (F.col("_mx") - F.col("_mn")) / bins
    return counted.select(
        F.col("bin").cast("int").alias("bin"),
        (F.col("_mn") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_mn") + F.col("bin") * width).alias("bin_end"),
        F.col("count").cast("bigint").alias("count"))
