"""One invoice / one customer holding a third of all lines."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import cleaning, rfm
from tillroll.operators.skew import join_back


def hot_lines(spark, n=9000):
    base = dt.datetime(2020, 1, 1, 10, 0)
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 2000).cast("string")).alias("InvoiceNo"),
        (F.col("id") % 97).cast("string").alias("StockCode"),
        F.lit(1).cast("bigint").alias("Quantity"),
        (F.lit(base) + F.make_dt_interval(F.lit(0), (F.col("id") % 24).cast("int"))).cast("timestamp_ntz")
        .alias("InvoiceDate"),
        F.lit(2.5).alias("TotalAmount"), F.lit(True).alias("HasCustomerID"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50 + 100).cast("bigint").alias("CustomerID"))


def test_hot_invoice_features_exact_and_map_side(spark):
    df = hot_lines(spark)
    out = cleaning.invoice_features(df)
    hot = out.where("InvoiceNo = 'HOT'").select(
        "TransactionValue", "ItemsPerTransaction", "UniqueProductsPerTransaction").distinct().collect()
    assert [tuple(r) for r in hot] == [(7500.0, 3000, 97)]
    assert out.count() == df.count()
    # brute force on a cold invoice
    cold = df.where("InvoiceNo = '1'")
    n_lines = cold.count()
    r = out.where("InvoiceNo = '1'").select("ItemsPerTransaction").distinct().collect()
    assert [x[0] for x in r] == [n_lines]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_join_back_equals_plain_left_join(spark):
    df = hot_lines(spark).withColumn("k", F.when(F.col("CustomerID") == 7, F.lit(None)).otherwise(F.col("InvoiceNo")))
    per = df.where("k IS NOT NULL").groupBy("k").agg(F.sum("Quantity").alias("v"), F.count(F.lit(1)).alias("_n"))
    a = join_back(df, per, "k", "_n", fraction=0.01).select("k", "v")
    b = df.join(per.drop("_n"), "k", "left").select("k", "v")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_customer_segments(spark):
    df = hot_lines(spark)
    seg = rfm.attach_segments(df)
    assert seg.count() == df.count()
    assert seg.where("CustomerID = 7").select("Customer_Segment").distinct().count() == 1


def test_hot_customer_joined_map_side(spark):
    df = hot_lines(spark)
    seg = rfm.attach_segments(df)
    seg.collect()
    plan = seg._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1]
    assert "BroadcastHashJoin" in plan
