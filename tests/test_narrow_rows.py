"""Wide or numerous rows are reduced before anything sorts or moves them."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.test_cube import lines
from tillroll.llm import ngram_join
from tillroll.operators import cleaning, cube as cb, view
from tillroll.plans import layout


def test_filter_domains_reduces_lines_before_taking_them_apart(spark):
    rows = [("Eire", "Other", "A", dt.datetime(2010, 1, 2, 23, 59)), (None, "Other", None, dt.datetime(2009, 12, 31)),
            ("Eire", None, "B", None), ("Eire", "Other", "A", dt.datetime(2011, 5, 6))]
    df = spark.createDataFrame(rows, "Country string, ProductCategory string, Customer_Segment string, InvoiceDate timestamp_ntz")
    out = view.filter_domains(df)
    assert [tuple(r) for r in out.collect()] == [
        ("Country", "Eire"), ("Customer_Segment", "A"), ("Customer_Segment", "B"), ("ProductCategory", "Other"),
        ("max_date", "2011-05-06"), ("min_date", "2009-12-31")]
    below = out._jdf.queryExecution().sparkPlan().toString().split("Generate ", 1)[1]
    assert "HashAggregate(keys=[Country" in below and "SortAggregate" not in below
    assert view.filter_domains(df.where("false")).collect() == []


def test_filter_domains_without_optional_columns(spark):
    df = spark.createDataFrame([("Eire", dt.datetime(2010, 1, 2))], "Country string, InvoiceDate timestamp_ntz")
    assert [tuple(r) for r in view.filter_domains(df).collect()] == [("Country", "Eire"), ("max_date", "2010-01-02"), ("min_date", "2010-01-02")]


def test_cells_go_as_two_numbers_and_come_back(spark):
    df, cell = cb._cell_lines(lines(spark, 500))
    codes = cb._Codes.of(df, cell)
    coded = codes.put(df)
    assert not set(cell) & set(coded.columns) and {"_calendar", "_profile"} <= set(coded.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, codes.back(coded).select(*cell, "InvoiceNo", "Quantity").collect())) == sorted(map(key, df.select(*cell, "InvoiceNo", "Quantity").collect()))
    assert set(cb._pairs(coded).columns) == {"kind", "InvoiceNo", "CustomerID", "StockCode", "_calendar", "_profile"}


def test_buckets_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_LINES", 100)
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), "id")
    t = layout.write_keyed(df, "k", "many", finish=lambda d: d.withColumn("twice", F.col("id") * 2))
    assert t.salts == 50 and t.lines.columns == ["k", "id", "twice"]
    got = t.attach(t.aggregate([F.sum("twice").alias("s")])).agg(F.count("id"), F.sum("twice"), F.countDistinct("k", "s")).first()
    assert tuple(got) == (5000, 4999 * 5000, 700)


def test_described_lines_leave_the_key_alone(spark):
    row = [("1", "P1", " tea  set ", 2, dt.datetime(2010, 1, 2, 3), 1.5, 7.0, " eire "), ("2", "P2", "bag", 1, dt.datetime(2010, 1, 2, 4), 2.5, None, None)]
    raw = spark.createDataFrame(row, "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double, Country string")
    stored = cleaning.write_clean_sales(raw, "CustomerID", "clean-test")
    whole = cleaning.clean_sales(raw)
    assert stored.lines.schema.names == whole.schema.names
    assert sorted(map(str, stored.lines.collect())) == sorted(map(str, whole.collect()))


def test_shingles_of_all_bytes_are_those_of_the_words():
    texts = ["", "a", "A b\tC\x0bd \x0c e\r\nF", "\u00c9t\u00e9 \x85 \u2003 " + "".join(map(chr, range(1, 256))), "same same same same same same same", "X " * 300_000]
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert ngram_join.shingles(text).tolist() == ngram_join.shingles(low).tolist()
        s = ngram_join.shingles(text)
        assert (np.diff(s.astype(object)) > 0).all() if len(s) > 1 else True
    assert len(ngram_join.shingles("a b c d e f a b c d e")) == 6 and len(ngram_join.shingles("a b")) == 1
