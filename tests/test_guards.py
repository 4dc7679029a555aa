"""Guards and fall-backs: shared folder, cached tables, baskets of any size, KPIs
without flags, exports, time zones, null keys."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tillroll import session
from tillroll.operators import basket, cleaning, dimensions as dims, view
from tillroll.plans.materialize import written_table
from tillroll.sources.retail import write_cleaned


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_dir(_Session(**{"spark.master": master}))
    assert session.scratch_dir(_Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y"}), "t").startswith("hdfs://x/y/t-")


def test_changed_inputs_are_read_again(spark):
    path = session.scratch_dir(spark, "changing")
    spark.range(3).write.parquet(path)
    build = lambda: spark.read.parquet(path)
    first = written_table(spark, "changing", build, sources=[path])
    assert first.count() == 3
    assert written_table(spark, "changing", build, sources=[path]).inputFiles() == first.inputFiles()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert written_table(spark, "changing", build, sources=[path]).count() == 5


def baskets(spark, n_items: int, n: int, seed: int):
    rng = random.Random(seed)
    rows = [(str(i), f"X{j:03d}", 1, 7) for i in range(n) for j in rng.sample(range(n_items), 12)]
    rows += [(None, f"X{j:03d}", 1, 7) for j in range(n_items)]
    return rows, spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity long, CustomerID long")


def test_pairs_of_more_than_64_items(spark):
    rows, df = baskets(spark, 80, 150, 1)
    got = {(r.Item_A, r.Item_B): r.Support_AB for r in basket.basket_pairs(df, top_n=70, min_lift=0.0, min_pair_support=0.0).collect()}
    held: dict = {}
    for inv, item, _, _ in rows:
        if inv is not None:
            held.setdefault(inv, set()).add(item)
    counts: dict = {}
    for items in held.values():
        for i in items:
            counts[i] = counts.get(i, 0) + 1
    top = sorted(counts, key=lambda i: (-counts[i], i))[:70]
    want = {}
    for a, b in itertools.combinations(top, 2):
        n = sum(a in s and b in s for s in held.values())
        if n:
            want[a, b] = n / len(held)
    assert got == want


def test_itemsets_leave_out_null_invoices_and_rare_items(spark):
    _, df = baskets(spark, 20, 60, 2)
    tx = basket.transactions(df, min_support=0.6)
    assert tx.count() == 60  # every invoice, none for the null number
    every = basket.frequent_itemsets(df, min_support=0.3)
    assert every.where("length = 1").count() > 0
    plain = {r.item for r in basket.item_support(df, min_support=0.3).collect()}
    assert {r.itemset for r in every.where("length = 1").collect()} == plain


def test_itemsets_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """Sets of every length; an item that most invoices hold, blocks of a few
    invoices and of more than one word."""
    rng = random.Random(8)
    held = {f"n{i}": {x for x in "abcdefg" if rng.random() < 0.45} | ({"hot"} if rng.random() < 0.8 else set()) for i in range(700)}
    rows = [(k, x, 1, 5) for k, items in held.items() for x in items]
    df = spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity int, CustomerID long").withColumn("HasCustomerID", F.lit(True))
    filled = [items for items in held.values() if items]
    want = {}
    for k in range(1, 9):
        for c in itertools.combinations(sorted("abcdefg") + ["hot"], k):
            n = sum(items.issuperset(c) for items in filled)
            if n / len(filled) >= 0.05:
                want[c] = (n, n / len(filled))
    assert max(map(len, want)) >= 4
    for size in (100, 8192):
        monkeypatch.setattr(basket, "BLOCK_INVOICES", size)
        got = basket.frequent_itemsets(df, min_support=0.05).collect()
        assert {tuple(r["items"]): (r.freq, r.support) for r in got} == want and len(got) == len(want)
    assert basket.frequent_itemsets(df.where("false")).count() == 0


def test_rules_of_a_long_itemset(spark):
    items = [f"i{k}" for k in range(9)]
    sets = [(list(c), ", ".join(c), k, 1, 0.5) for k in range(1, 10) for c in itertools.combinations(items, k)]
    df = spark.createDataFrame(sets, "items array<string>, itemset string, length int, freq long, support double")
    rules = basket.association_rules(df.where("length = 9").unionByName(df.where("length < 9")), min_threshold=0.0)
    assert rules.count() == sum(2 ** len(s[0]) - 2 for s in sets if len(s[0]) > 1)


def test_kpis_without_customer_flag(spark):
    rows = [("1", "A", 10.0, 5), ("1", "B", 2.0, 5), ("2", "A", 1.0, None), (None, "C", 3.0, 6)]
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, TotalAmount double, CustomerID long")
    k = view.kpis(df).first()
    assert (k.total_revenue, k.total_transactions, k.total_customers, k.total_products, k.customer_transactions) == (16.0, 2, 2, 3, 3)
    flagged = df.withColumn("HasCustomerID", F.col("CustomerID") == 5)
    assert view.kpis(flagged).first().total_customers == 1
    d = view.kpi_deltas(df, F.col("InvoiceNo") == "1").first()
    assert (d.total_revenue_f, d.total_transactions_f, d.total_customers_f, d.total_products_f) == (12.0, 1, 1, 2)
    assert view.kpis(df.limit(0)).first().total_revenue == 0.0


def test_summary_csv(spark):
    rows = [("1", "A", 1234.5, 5)]
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, TotalAmount double, CustomerID long")
    path = session.scratch_dir(spark, "summary")
    view.write_summary_csv(view.kpi_summary_report(df), path)
    (part,) = [f for f in os.listdir(path) if f.endswith(".csv")]
    lines = open(os.path.join(path, part), encoding="utf-8").read().splitlines()
    assert lines[0] == "Metric,Value" and lines[1] == 'Total Revenue,"£1,234.50"' and len(lines) == 6


def test_lenient_parse_keeps_wall_clock_times(spark):
    df = spark.createDataFrame([("3/31/2024 2:30",), ("13/45/2024 1:00",), (None,)], "InvoiceDate string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # that hour does not exist there
    try:
        got = [None if r[0] is None else str(r[0]) for r in cleaning.parse_invoice_ts(df, lenient=True).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2024-03-31 02:30:00", None, None]


def test_null_keys_are_left_out(spark):
    rows = [("1", None, "d", None, 1.0), ("2", "A", None, "X", 2.0), ("3", "A", "d", "X", 4.0)]
    df = spark.createDataFrame([(*r, 1, 9, 0, None) for r in rows],
                               "InvoiceNo string, StockCode string, Description string, Country string, TotalAmount double, "
                               "Quantity long, CustomerID long, Hour int, ProductCategory string")
    assert [r.Country for r in dims.top_countries(df).collect()] == ["X"]
    assert [r.Country for r in dims.country_summary(df).collect()] == ["X"]
    assert dims.home_market_share(df).first().countries == 1
    assert [(r.StockCode, r.Description) for r in dims.product_metrics(df).collect()] == [("A", "d")]
    assert [r.Description for r in dims.top_products_by_description(df).orderBy("Description").collect()] == ["d"]
    assert dims.pareto_share(df).first().total_products == 1


def test_a_month_has_few_files(spark):
    df = (spark.range(0, 4000, 1, 16).select(F.col("id").cast("string").alias("InvoiceNo"), F.lit("A").alias("StockCode"),
                                             F.lit(2011).alias("Year"), (F.col("id") % 3).cast("int").alias("Month")))
    path = session.scratch_dir(spark, "files")
    write_cleaned(df, path, files=4)
    for m in range(3):
        names = [f for f in os.listdir(f"{path}/Year=2011/Month={m}") if f.endswith(".parquet")]
        assert 1 <= len(names) <= 4
    assert spark.read.parquet(path).count() == 4000
