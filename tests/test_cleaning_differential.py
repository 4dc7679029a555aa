"""Spark's cleaning job and the SQL oracle's cleaning agree on generated raw
lines (nulls, cancelled numbers, NaN / zero / negative amounts, messy text)."""

import datetime as dt

import duckdb
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle_harness import rows_of
from tillroll.operators.cleaning import clean_sales
from tillroll.plans.oracle import CLEANED_CTE, CLEANED_COLS, FILTERED_CTE

SCHEMA = ("InvoiceNo string, StockCode string, Description string, Quantity bigint, InvoiceDate timestamp_ntz, "
          "UnitPrice double, CustomerID double, Country string, Brand string, PType string")
TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ bag candle xmas garden mug,.!-_'\t")), max_size=20)

ROW = st.tuples(
    st.sampled_from([None, "1", "2", "3", "C4", "c5", "6", "7", "8", "9"]),
    st.sampled_from(["P1", "P2", "P3", "P4"]),
    st.one_of(TEXT, TEXT, TEXT, st.none()),
    st.integers(min_value=-2, max_value=60),
    st.datetimes(min_value=dt.datetime(2010, 1, 1), max_value=dt.datetime(2012, 12, 31)).map(
        lambda t: t.replace(second=0, microsecond=0)),
    st.sampled_from([float("nan"), 0.0, -1.5, 0.85, 1.25, 1.25, 2.55, 2.55, 4.95, 12.75, 99.0]),
    st.one_of(st.none(), st.sampled_from([12345.0, 17850.0, 13047.0])),
    st.sampled_from([" united kingdom ", "FRANCE", "eire", "guinea-bissau", "Channel  Islands"]),
)


@settings(max_examples=15, deadline=None)
@given(st.lists(ROW, min_size=0, max_size=40))
def test_cleaning_matches_sql_oracle(spark, rows):
    rows = [r + (None, None) for r in rows]
    sdf = clean_sales(spark.createDataFrame(rows, SCHEMA)).select(*[c.strip() for c in CLEANED_COLS.split(",")])
    s_rows = [tuple(r) for r in sdf.collect()]

    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    raw = pd.DataFrame(rows, columns=cols).astype({"Quantity": "int64", "UnitPrice": "float64",
                                                     "CustomerID": "float64"})
    con = duckdb.connect()
    con.register("raw_input", raw)
    sql = (f"WITH raw AS (SELECT InvoiceNo, StockCode, Description, Quantity, CAST(InvoiceDate AS TIMESTAMP) AS InvoiceDate, "
           f"UnitPrice, CustomerID, Country, CAST(Brand AS VARCHAR) AS Brand, CAST(PType AS VARCHAR) AS PType FROM raw_input),"
           f"{FILTERED_CTE},{CLEANED_CTE} SELECT {CLEANED_COLS} FROM cleaned")
    rel = con.sql(sql)
    d_rows = rel.fetchall()
    assert rows_of(sdf.columns, s_rows) == rows_of(list(rel.columns), d_rows)
