"""Customer lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators import binning
from tillroll.operators.cleaning import identified_customers
from tillroll.operators.ranking import exact_quantiles
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import cut


def clv(df: DataFrame) -> DataFrame:
    """Per identified customer: TotalRevenue and AvgOrderValue (mean line
    value) rounded half-even to 2, Frequency, first/last purchase,
    LifespanDays, PurchaseFrequency, PredictedLifespan (mean positive
    lifespan for one-day customers), CLV and its quintile ValueSegment."""
    per = (identified_customers(df).groupBy("CustomerID")
           .agg(F.sum(tf.money_units("TotalAmount")).alias("_units"),
                F.count(F.lit(1)).alias("_lines"),
                F.count_distinct("InvoiceNo").alias("Frequency"),
                F.min("InvoiceDate").alias("FirstPurchase"),
                F.max("InvoiceDate").alias("LastPurchase")))
    base = per.select(
        "CustomerID",
        tf.money_round2("_units").alias("TotalRevenue"),
        tf.money_round2("_units", "_lines").alias("AvgOrderValue"),
        "Frequency", "FirstPurchase", "LastPurchase",
        F.coalesce(tf.elapsed_days("FirstPurchase", "LastPurchase"), F.lit(0)).alias("LifespanDays"))
    base = cut(base.withColumn("PurchaseFrequency", F.col("Frequency") / (F.col("LifespanDays") + 1)), "clv-base")
    # One-row mean of the positive lifespans, broadcast to the customers.
    avg_life = (base.agg(
        (F.sum(F.when(F.col("LifespanDays") > 0, F.col("LifespanDays")))
         / F.count_if(F.col("LifespanDays") > 0)).alias("_avg_life")))
    out = (attach_one_row(base, avg_life)
               .withColumn("PredictedLifespan",
                           F.when(F.col("LifespanDays") == 0, F.col("_avg_life"))
                            .otherwise(F.col("LifespanDays").cast("double")))
               .withColumn("CLV", F.col("AvgOrderValue") * F.col("PurchaseFrequency")
                           * F.col("PredictedLifespan"))
               .drop("_avg_life"))
    out = binning.qcut_strict(out, "CLV", 5, "_vbin")
    labels = F.array(*[F.lit(x) for x in tf.CLV_SEGMENT_LABELS])
    return out.withColumn("ValueSegment", F.element_at(labels, F.col("_vbin"))).drop("_vbin")


def clv_insights(clv_df: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of CLV, count of High Value."""
    q = exact_quantiles(clv_df, "CLV", [0.5, 0.9], "_q")
    base = clv_df.agg(
        tf.round_sig(F.avg("CLV"), 12).alias("avg_clv"),
        F.count_if(F.col("ValueSegment") == tf.CLV_SEGMENT_LABELS[-1]).alias("high_value_customers"),
        F.count(F.lit(1)).alias("customers"))
    return attach_one_row(base, q).select(
        "avg_clv", tf.round_sig(F.col("_q")[0], 12).alias("median_clv"),
        tf.round_sig(F.col("_q")[1], 12).alias("p90_clv"), "high_value_customers", "customers")


def clv_segment_counts(clv_df: DataFrame) -> DataFrame:
    """A25."""
    return clv_df.groupBy("ValueSegment").agg(F.count(F.lit(1)).alias("Customers"))


def sample_customers(clv_df: DataFrame, n: int = 1000, seed: str = "0") -> DataFrame:
    """min(n, customers) customers in a seeded pseudo-random order (hash
    of the id), reproducible; each task keeps only n rows."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("CustomerID").cast("string")))
    return clv_df.orderBy(h, "CustomerID").limit(n)
