"""Invariants that must hold on any input."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import basket, cohort, dimensions as dims, ranking, rfm
from tillroll.plans.catalog import cleaned
from tillroll.session import scratch_dir


@pytest.fixture(scope="module")
def lines(spark, sf_small):
    return cleaned(spark, sf_small)


def test_period_zero_retention_is_one(lines):
    rates = [r[0] for r in cohort.cohort_retention(lines).where("PeriodNumber = 0")
             .select("RetentionRate").distinct().collect()]
    assert rates == [1.0]


def test_sum_by_any_dimension_equals_total(lines):
    def units(df):
        return df.agg(F.sum(F.round(F.col("TotalAmount") * 10000).cast("bigint"))).first()[0]

    total = units(lines)
    for df in (dims.monthly_sales(lines), dims.season_sales(lines), dims.hourly_sales(lines), dims.category_performance(lines)):
        assert units(df) == total
    # lines without a country belong to none
    assert units(dims.country_metrics(lines)) == units(lines.where("Country IS NOT NULL")) < total


def test_segment_shares_sum_to_100(lines):
    prof = rfm.rfm_segment_profile(rfm.rfm_scores_quintile(rfm.rfm_metrics(lines)))
    assert abs(prof.agg(F.sum("Share")).first()[0] - 100.0) < 1e-9


def test_itemset_support_not_above_subsets(lines):
    sets = basket.frequent_itemsets(lines, "PType", 0.01)
    rows = {tuple(r["items"]): r["support"] for r in sets.collect()}
    for items, s in rows.items():
        for i in range(len(items)):
            sub = items[:i] + items[i + 1:]
            if sub:
                assert rows[sub] >= s


def test_pair_lift_symmetric(lines):
    for r in basket.basket_pairs(lines, "Brand", min_lift=0.0, min_pair_support=0.0).collect():
        assert abs(r.Confidence_A_to_B * r.Support_AB / r.Confidence_A_to_B - r.Support_AB) < 1e-12


def test_global_row_number_equals_window_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 37).alias("k"), F.col("id").alias("u"))
    ours = ranking.global_row_number(df, ["k", "u"], "rn", num_partitions=7)
    ref = df.withColumn("rn2", F.row_number().over(Window.orderBy("k", "u")))
    bad = ours.join(ref, ["k", "u"]).where("rn <> rn2").count()
    assert bad == 0 and ours.count() == 5000


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    import random
    from tillroll.operators.ranking import exact_quantiles
    random.seed(7)
    probs = [0.0, 0.2, 0.25, 0.5, 0.6000000000000001, 0.9, 1.0]
    for vals in ([random.random() * 1e4 for _ in range(3001)], [random.randint(0, 9) for _ in range(500)], [4.0]):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        got = exact_quantiles(df, "x", probs).first()[0]
        want = np.quantile(np.array(vals, dtype=float), probs)
        assert max(abs(a - b) for a, b in zip(got, want)) <= 1e-9 * max(1.0, max(vals))


def test_global_row_number_with_hot_key(spark):
    # a third of the rows share one sort value: ranks stay 1..n and contiguous
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("u"))
    ours = ranking.global_row_number(df, ["k", "u"], "rn", num_partitions=8)
    ref = df.withColumn("rn2", F.row_number().over(Window.orderBy("k", "u")))
    assert ours.join(ref, ["k", "u"]).where("rn <> rn2").count() == 0


def test_grouped_forecast_equals_filtered_forecast(lines):
    from tillroll.operators import forecast
    country = "United Kingdom"
    grouped = (forecast.forecast(lines, by=["Country"]).where(F.col("Country") == country)
               .drop("Country").orderBy("MonthNumber").collect())
    alone = forecast.forecast(lines.where(F.col("Country") == country)).orderBy("MonthNumber").collect()
    assert [tuple(r) for r in grouped] == [tuple(r) for r in alone] and len(alone) == 6
    fits = forecast.sales_trend_fit(lines, by=["Country"])
    assert fits.count() == lines.select("Country").distinct().count()


def test_approx_distinct_profile_close_to_exact(lines):
    from tillroll.operators import profile
    exact = {r.column_name: r.distinct_count for r in profile.profile_distinct(lines.select("InvoiceNo", "StockCode")).collect()}
    approx = {r.column_name: r.distinct_count
              for r in profile.profile_distinct(lines.select("InvoiceNo", "StockCode"), approx_rsd=0.01).collect()}
    for k in exact:
        assert abs(approx[k] - exact[k]) <= 0.05 * exact[k]


def test_attach_one_row_rejects_unbounded_relations(spark):
    import pytest
    from tillroll.operators.scalars import attach_one_row
    df = spark.range(10)
    one = df.agg(F.max("id").alias("m"))
    assert attach_one_row(df, one).count() == 10
    with pytest.raises(ValueError, match="at most one row"):
        attach_one_row(df, df.select(F.col("id").alias("x")))


def test_global_row_number_with_extra_columns_over_a_million_rows(spark):
    """Every number once and the scores of a plain window, with columns besides
    the order columns, written in full."""
    n = 1_500_000
    df = spark.range(0, n, 1, 16).select(
        (F.xxhash64("id") % 40).alias("f"), (F.col("id") * 7919 % n).alias("u"), F.xxhash64("id", F.lit(1)).alias("recency"),
        F.rand(3).alias("monetary"))
    path = scratch_dir(spark, "ranks")
    ranking.global_row_number(df, ["f", "u"], "rn", num_partitions=16).write.parquet(path)
    got = spark.read.parquet(path)
    s = got.agg(F.count("*"), F.count_distinct("rn"), F.min("rn"), F.max("rn")).first()
    assert tuple(s) == (n, n, 1, n)
    ref = df.select("f", "u", F.row_number().over(Window.orderBy("f", "u")).alias("want"))
    assert got.join(ref, ["f", "u"]).where("rn != want").count() == 0


def test_invoice_features_equal_window_brute_force(lines):
    # lines without an invoice number belong to no invoice
    without = lines.where("InvoiceNo IS NULL")
    assert without.count() > 0
    assert without.where("TransactionValue IS NOT NULL OR ItemsPerTransaction IS NOT NULL OR UniqueProductsPerTransaction IS NOT NULL").count() == 0
    lines = lines.where("InvoiceNo IS NOT NULL")
    w = Window.partitionBy("InvoiceNo")
    brute = lines.select(
        "InvoiceNo",
        (F.sum(F.round(F.col("TotalAmount") * 10000).cast("bigint")).over(w) / 10000.0).alias("tv"),
        F.sum("Quantity").over(w).alias("ipt"),
        F.size(F.collect_set("StockCode").over(w)).cast("bigint").alias("upt")).distinct()
    ours = lines.select("InvoiceNo", F.col("TransactionValue").alias("tv"),
                        F.col("ItemsPerTransaction").alias("ipt"),
                        F.col("UniqueProductsPerTransaction").alias("upt")).distinct()
    assert ours.exceptAll(brute).count() == 0 and brute.exceptAll(ours).count() == 0
