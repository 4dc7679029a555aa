"""Lines stored by key, fingerprints, month bits, folder pruning, two-phase top-k."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import cohort, dimensions, profile, view
from tillroll.plans.layout import SALT, write_keyed
from tillroll.sources.retail import write_cleaned


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def above_the_lines(plan: str, join: str = "SortMergeJoin") -> list[str]:
    """Nodes between the join and the scan of its first child."""
    lines = plan[plan.index(join):].splitlines()[1:]
    return [x for x in lines[:next(i for i, x in enumerate(lines) if "FileScan" in x or "Scan parquet" in x)]]


def keyed(spark, n=6000):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 900 + 100).cast("long").alias("k"),
        (F.col("id") % 13).alias("v"), F.col("id").alias("row"))
    return df, write_keyed(df, "k", "test-lines", fraction=0.01)


def test_aggregate_and_join_move_no_line(spark):
    df, t = keyed(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per = t.aggregate([F.sum("v").alias("s"), F.count_distinct("v").alias("d")])
        out = t.attach(per)
        want = df.join(df.where("k is not null").groupBy("k").agg(F.sum("v").alias("s"), F.count_distinct("v").alias("d")), "k", "left").select(*out.columns)
        assert out.count() == df.count() and out.exceptAll(want).count() == 0
        assert not [x for x in above_the_lines(plan_of(t.attach(per))) if "Exchange" in x]
        plan = per.where("k is not null")._jdf.queryExecution().executedPlan().toString()
        cold = plan[plan.index("Union"):].split("Union")[1]
        assert "SelectedBucketsCount" in plan and cold.split("FileScan")[0].count("Exchange hashpartitioning") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_and_null_keys_are_spread(spark):
    df, t = keyed(spark)
    assert [r.k for r in t.hot.collect()] == [7]
    salts = {r.k: r.n for r in t.table.groupBy("k").agg(F.count_distinct(SALT).alias("n")).collect()}
    assert salts[7] == t.salts and salts[None] == t.salts and set(v for k, v in salts.items() if k not in (7, None)) == {1}
    assert t.lines.exceptAll(df).count() == 0 and t.lines.count() == df.count()


def test_empty_keyed_table(spark):
    df = spark.createDataFrame([], "k long, v long")
    t = write_keyed(df, "k", "none")
    assert t.attach(t.aggregate([F.sum("v").alias("s")])).collect() == []


def rows_with_copies(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", ""]), rng.choice([0.0, -0.0, float("nan"), 1.5, None])) for _ in range(300)]
    return rows + [(9, "only", 2.5), (8, None, None), (None, "8", None)]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_duplicates_equal_whole_rows(spark, limit):
    df = spark.createDataFrame(rows_with_copies(1), "a int, b string, c double")
    want = df.count() - df.distinct().count()
    assert profile.duplicate_count(df, limit).first()[0] == want
    assert profile.duplicate_count(df.where("a = 9")).first()[0] == 0
    assert profile.duplicate_count(df.where("false")).first()[0] == 0


def test_equal_fingerprints_of_different_rows_count_nothing(spark, monkeypatch):
    monkeypatch.setattr(profile, "_fingerprint", lambda cols: [F.lit(1).cast("long"), F.lit(2).cast("long")])
    df = spark.createDataFrame(rows_with_copies(2), "a int, b string, c double")
    assert profile.duplicate_count(df).first()[0] == df.count() - df.distinct().count()


def test_fingerprint_tells_nulls_and_places_apart(spark):
    rows = [(None, 1), (1, None), (0, 1), (1, 0), (None, None)]
    df = spark.createDataFrame(rows, "a int, b int").select(*[c.alias(n) for c, n in zip(profile._fingerprint(["a", "b"]), "xy", strict=True)])
    assert df.distinct().count() == len(rows)


def test_cohorts_over_many_months_equal_brute_force(spark):
    """150 months need three words of bits."""
    rng = random.Random(3)
    start, rows = 2000 * 12, []
    for c in range(60):
        for _ in range(rng.randint(1, 12)):
            m = start + rng.choice([0, 61, 62, 123, 124, rng.randint(0, 149), rng.randint(0, 149)])
            rows.append((c, dt.datetime(m // 12, m % 12 + 1, rng.randint(1, 28), 5)))
    rows += [(None, dt.datetime(1999, 1, 1)), (5, None)]
    df = spark.createDataFrame(rows, "CustomerID long, InvoiceDate timestamp_ntz")
    months = {}
    for c, t in rows:
        if c is not None and t is not None:
            months.setdefault(c, set()).add(t.year * 12 + t.month - 1)
    want = {}
    for ms in months.values():
        for m in ms:
            key = (dt.date(min(ms) // 12, min(ms) % 12 + 1, 1), m - min(ms))
            want[key] = want.get(key, 0) + 1
    got = cohort.cohort_retention(df).collect()
    assert {(r.CohortGroup, r.PeriodNumber): r.Customers for r in got} == want
    assert all(r.CohortSize == want[(r.CohortGroup, 0)] for r in got)
    assert cohort.cohort_retention(df.where("false")).collect() == []


def test_date_filter_skips_folders(spark, tmp_path):
    df = spark.range(2000).select(F.expr("timestamp_ntz'2010-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("InvoiceDate"),
                                  F.col("id").cast("string").alias("InvoiceNo"), F.lit("s").alias("StockCode"))
    df = df.withColumn("Year", F.year("InvoiceDate")).withColumn("Month", F.month("InvoiceDate"))
    write_cleaned(df, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for span in (("2011-11-20", "2012-02-03"), ("2013-05-01", None), (None, "2010-01-31"), ("2012-02-02", "2012-02-02")):
        got = view.filter_sales(table, *span)
        plain = table.where(view.sales_predicate(*span))
        assert got.count() == plain.count() > 0
        assert got.exceptAll(plain).count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "Year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_top_products_count_distincts_of_winners_only(spark):
    rng = random.Random(5)
    rows = [(str(rng.randint(1, 40)), f"p{i % 7}", str(rng.randint(1, 300)), rng.randint(1, 9), rng.randint(1, 500) / 100, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "StockCode string, Description string, InvoiceNo string, Quantity long, TotalAmount double, CustomerID long")
    for by in ("TotalAmount", "Quantity"):
        want = dimensions.product_metrics(df).orderBy(F.desc(by), "StockCode", "Description").limit(20).collect()
        assert dimensions.top_products(df, by, 20).collect() == want
