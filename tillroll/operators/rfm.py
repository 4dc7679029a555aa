"""RFM metrics, scores and segments.

Two scorings exist, as in the reference:
* ``rfm_scores_quintile`` (analysis report): strict quintiles of Recency
  (labels reversed) and Monetary, quintiles of the Frequency rank; segments
  from the score-code lists.
* ``rfm_scores_dedup`` (dashboard): quintiles with repeated edges dropped,
  equal-width bins when a metric has fewer than 5 distinct values, Recency
  score inverted (6 - s); segments from threshold rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators import binning
from tillroll.operators.cleaning import identified_customers
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.layout import KeyedTable, write_keyed
from tillroll.plans.materialize import cut


def snapshot(df: DataFrame, scope: str = "identified") -> DataFrame:
    """P20: one row (snapshot) = latest InvoiceDate + 1 day, over identified
    lines ('identified', analysis report) or all lines ('all', dashboard)."""
    base = identified_customers(df) if scope == "identified" else df
    return base.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("_snapshot"))


def rfm_metrics(df: DataFrame, snapshot_scope: str = "identified") -> DataFrame:
    """A3: per identified customer Recency (whole days from the last purchase
    to the snapshot), Frequency (distinct invoices), Monetary (revenue).

    Pre-aggregated per customer before the snapshot is attached: the one-row
    snapshot is broadcast to the (much smaller) customer table.
    """
    lines = identified_customers(df)
    per_customer = (lines.groupBy("CustomerID")
                         .agg(F.max("InvoiceDate").alias("_last"),
                              F.count_distinct("InvoiceNo").alias("Frequency"),
                              tf.money_sum("TotalAmount").alias("Monetary")))
    return (attach_one_row(per_customer, snapshot(df, snapshot_scope))
            .select("CustomerID", tf.elapsed_days("_last", "_snapshot").alias("Recency"),
                    "Frequency", "Monetary"))


def rfm_scores_quintile(rfm: DataFrame) -> DataFrame:
    """W4/W5 + P27/P29/P30: R (5 = most recent), F (quintile of the
    frequency rank, ties in CustomerID order), M; score code; segment."""
    s = (rfm.transform(lambda d: binning.qcut_by_rank(d, "Frequency", "CustomerID", 5, "F_Score"))
            .transform(lambda d: binning.qcut_strict(d, {"Recency": "_rbin", "Monetary": "M_Score"}, 5))
            .withColumn("R_Score", (F.lit(6) - F.col("_rbin")).cast("int")))
    return s.select("CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score", "M_Score",
                    tf.score_code("R_Score", "F_Score", "M_Score").alias("RFM_Score"),
                    tf.segment_by_score_code(tf.score_code("R_Score", "F_Score", "M_Score")).alias("Segment"))


def rfm_scores_dedup(rfm: DataFrame) -> DataFrame:
    """W6/W7 + P28/P31: dashboard scores and rule segments."""
    s = binning.score_dashboard(rfm, {c: f"{c}_Score" for c in ("Recency", "Frequency", "Monetary")}, 5)
    r = (F.lit(6) - F.col("Recency_Score")).cast("int")
    f = F.col("Frequency_Score").cast("int")
    m = F.col("Monetary_Score").cast("int")
    return s.select("CustomerID", "Recency", "Frequency", "Monetary",
                    r.alias("R_Score"), f.alias("F_Score"), m.alias("M_Score"),
                    tf.score_code(r, f, m).alias("RFM_Segment"),
                    tf.segment_by_rules(r, f, m).alias("Customer_Segment"))


def rfm_segment_profile(scored: DataFrame, segment_col: str = "Segment") -> DataFrame:
    """A4/A5: customers per segment, share %, mean R/F/M."""
    g = scored.groupBy(segment_col).agg(
        F.count(F.lit(1)).alias("Count"),
        F.avg("Recency").alias("AvgRecency"),
        F.avg("Frequency").alias("AvgFrequency"),
        (F.sum(tf.money_units("Monetary")) / F.count(F.lit(1)) / tf.MONEY_SCALE).alias("AvgMonetary"))
    total = F.sum("Count").over(Window.partitionBy(F.lit(1)))  # segments: at most 7 rows
    return g.withColumn("Share", F.col("Count") * 100 / total)


def attach_segments(df: DataFrame | KeyedTable, metrics: DataFrame | None = None) -> DataFrame:
    """C5 + J2: dashboard segmentation put back on every line by CustomerID
    (guests get null segments).  Snapshot over all lines.

    Lines that are stored by customer (``layout.write_keyed``) are read as they
    lie, only the per-customer rows move; other lines are stored so first.  A
    customer with a large share of all lines is spread over the buckets, and so
    are guests.  ``metrics`` may pass an already written ``rfm_metrics(df,
    "all")`` table.
    """
    lines = df if isinstance(df, KeyedTable) else write_keyed(df, "CustomerID", "lines-by-customer")
    if metrics is None:
        metrics = cut(rfm_metrics(lines.lines, snapshot_scope="all"), "rfm")  # read by every score
    seg = rfm_scores_dedup(metrics).select("CustomerID", "RFM_Segment", "Customer_Segment")
    return lines.attach(seg).select(*lines.lines.columns, "RFM_Segment", "Customer_Segment")


def segment_distribution(segmented: DataFrame) -> DataFrame:
    """Identified customers per Customer_Segment and % of them."""
    lines = identified_customers(segmented).where(F.col("Customer_Segment").isNotNull())
    g = lines.groupBy("Customer_Segment").agg(F.count_distinct("CustomerID").alias("Count"))
    return segment_shares(g)


def segment_shares(g: DataFrame) -> DataFrame:
    """A34 from customers by segment."""
    total = F.sum("Count").over(Window.partitionBy(F.lit(1)))  # at most 7 segments
    return (g.withColumn("Percentage", F.col("Count") * 100 / total)
             .orderBy(F.desc("Percentage"), "Customer_Segment"))


def score_histogram(scored: DataFrame) -> DataFrame:
    """A42 (discrete form): customers per R, F and M score value, long form
    (score_type, score, customers)."""
    long = scored.select(F.explode(F.array(
        F.struct(F.lit("R").alias("score_type"), F.col("R_Score").alias("score")),
        F.struct(F.lit("F").alias("score_type"), F.col("F_Score").alias("score")),
        F.struct(F.lit("M").alias("score_type"), F.col("M_Score").alias("score")))).alias("s")).select("s.*")
    return long.groupBy("score_type", "score").agg(F.count(F.lit(1)).alias("customers"))
