"""Cleaned lines move once; shuffles have as many pieces as the lines need."""

import datetime as dt
import random

import pytest

from tillroll.operators import basket, cleaning, dimensions
from tillroll.plans import materialize

SCHEMA = "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double, Country string, Brand string"


def raw_lines(spark, n=400):
    """Invoices of one customer, of guests, of several customers, of customers
    and guests; lines without invoice, customer or product; copies."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        invoice = rng.choice([None, *map(str, range(60))])
        mixed = invoice is None or int(invoice) % 4 == 0
        customer = rng.choice([None, 1.0, 2.0, 3.0]) if mixed else None if int(invoice) % 4 == 1 else float(int(invoice) % 7)
        rows.append((invoice, rng.choice([None, "P1", "P2", "P3", "P4"]), rng.choice([" tea  set ", "bag!", "xmas"]), rng.randint(1, 9),
                     dt.datetime(2010, 1, 1 + i % 28, i % 24), rng.choice([1.25, 2.5, 3.1]), customer, rng.choice([" eire ", None]), "b"))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


@pytest.mark.parametrize("most", [4096, 5])
def test_lines_stored_by_customer_equal_cleaned_lines(spark, monkeypatch, most):
    raw = raw_lines(spark)
    whole = cleaning.clean_sales(raw)
    want = sorted(map(str, whole.collect()))

    def second_move(df):
        raise AssertionError("lines are moved by invoice, then by customer")

    monkeypatch.setattr(cleaning, "invoice_features", second_move)
    monkeypatch.setattr(cleaning, "TOGETHER_LINES", most)
    stored = cleaning.write_clean_sales(raw, "CustomerID", "single-move")
    assert stored.lines.dtypes == whole.dtypes and sorted(map(str, stored.lines.collect())) == want


def test_partitions_follow_the_rows(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(materialize, "PARTITION_ROWS", 10)
    with pytest.raises(ValueError), materialize.partitions_for(spark, 1000) as n:
        assert n == 100 and spark.conf.get(name) == "100"
        raise ValueError
    with materialize.partitions_for(spark, 0) as n:
        assert n == int(before)
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("module, run", [(dimensions, lambda df: dimensions.category_performance(df)),
                                         (basket, lambda df: basket.frequent_itemsets(df, "Description", 0.01))])
def test_counts_are_cut_by_the_lines(spark, monkeypatch, module, run):
    lines = materialize.cut(cleaning.clean_sales(raw_lines(spark)), "lines")
    want = sorted(map(str, run(lines).collect()))
    seen, cut = [], materialize.cut
    monkeypatch.setattr(materialize, "PARTITION_ROWS", 10)
    monkeypatch.setattr(module, "cut", lambda df, name: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), cut(df, name))[1])
    assert sorted(map(str, run(lines).collect())) == want and want
    assert seen and set(seen) == {-(-lines.count() // 10)}


def test_fences_are_measured_on_their_columns_alone(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, 500, None]), rng.choice([0.5, 1.0, 1.5, 99.0, float("nan"), None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "Description string, Quantity long, UnitPrice double")
    want = cleaning.iqr_filter(cleaning.iqr_filter(df, "Quantity"), "UnitPrice")
    want = sorted(map(str, want.collect()))
    seen, fences = [], cleaning.iqr_fences
    monkeypatch.setattr(cleaning, "iqr_fences", lambda d, c, k=1.5: (seen.append((c, d.columns)), fences(d, c, k))[1])
    assert sorted(map(str, cleaning.sequential_iqr(df).collect())) == want and 0 < len(want) < 300
    assert seen == [(c, ["Quantity", "UnitPrice"]) for c in ("Quantity", "UnitPrice")]
    assert cleaning.sequential_iqr(df.where("false")).collect() == []


def scans_of_lines(spark, raw):
    """How often ``write_clean_sales`` reads ``raw``, and the lines it stores."""
    reads = spark.sparkContext.accumulator(0)

    def noted(parts):
        for p in parts:
            reads.add(p.num_rows)
            yield p

    lines = raw.count()
    stored = cleaning.write_clean_sales(raw.mapInArrow(noted, raw.schema), "CustomerID", "scans")
    got = sorted(map(str, stored.lines.collect()))
    return reads.value / lines, got


def test_lines_are_read_for_few_counts(spark):
    raw = raw_lines(spark).where("InvoiceNo is null or InvoiceNo % 4 != 0")  # invoices of one customer, or of guests
    want = sorted(map(str, cleaning.clean_sales(raw).collect()))
    reads, got = scans_of_lines(spark, raw)
    assert got == want and reads <= 4  # their number, the fences' columns, counts by invoice and customer, the move
