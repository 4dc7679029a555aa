"""The dashboard cube equals the scan of the lines."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators import cube as cb, dimensions as dims, rfm, view
from tillroll.plans import materialize, reports

SCHEMA = ("InvoiceNo string, StockCode string, Quantity long, TotalAmount double, InvoiceDate timestamp_ntz, CustomerID long, "
          "HasCustomerID boolean, Country string, ProductCategory string, Customer_Segment string")


def lines(spark, n=4000, seed=3):
    """Invoices of several days, countries and customers, a customer with a
    third of all lines, guests, unflagged customers and nulls everywhere."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        cust = 7 if i % 3 == 0 else r.choice([None, *range(100, 400)])
        day = None if r.random() < 0.01 else dt.datetime(2010, 11, 1) + dt.timedelta(days=r.randrange(120), hours=r.randrange(24), minutes=r.randrange(60))
        rows.append((r.choice([None, *[f"i{k}" for k in range(700)]]), r.choice([None, *[f"p{k}" for k in range(150)]]), r.randrange(1, 9),
                     r.randrange(1, 10 ** 6) / 100, day, cust, r.choice([True, True, None, False]) if cust else False,
                     r.choice([None, "United Kingdom", "United Kingdom", "France", "Eire"]), r.choice([None, "Other", "Home Decor", "Lighting"]),
                     None if cust is None else ["A", "B", "C"][cust % 3]))
    return with_calendar(spark.createDataFrame(rows, SCHEMA))


def with_calendar(df):
    ts = "InvoiceDate"
    df = df.withColumns({"Year": F.year(ts), "Month": F.month(ts), "DayOfWeek": tf.weekday_monday0(ts), "DayName": tf.day_name(ts), "Hour": F.hour(ts)})
    return df.withColumns({"Season": tf.season_of("Month"), "BusinessPeriod": tf.business_period_of("Hour")})


def files_under(path: str) -> set[str]:
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs}


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


FILTERS = [{}, dict(date_from="2010-12-05", date_to="2011-01-20"), dict(countries=["France", "Eire"], segment="B"),
           dict(date_from="2011-01-01", categories=["Other", "Lighting"]), dict(countries=["Nowhere"])]


@pytest.fixture(scope="module")
def both(spark):
    df = lines(spark)
    df.cache().count()
    return df, cb.write_cube(df)


@pytest.mark.parametrize("chosen", FILTERS)
def test_panels_equal_the_line_scan(both, chosen):
    df, cube = both
    pred = view.sales_predicate(**chosen, columns=df.columns)
    f, c = df.where(pred), cb.panels(cube, pred)
    want = {
        "filter_domains": view.filter_domains(df), "kpis": view.kpis(f), "kpi_deltas": view.kpi_deltas(df, pred), "daily_revenue": dims.daily_revenue(f),
        "top_countries": dims.top_countries(f), "segment_distribution": rfm.segment_distribution(f), "category_revenue": dims.category_revenue(f),
        "season_summary": dims.season_summary(f), "hourly_sales": dims.hourly_sales(f), "country_summary": dims.country_summary(f),
        "home_market_share": dims.home_market_share(f), "temporal_peaks": dims.temporal_peaks(f), "kpi_summary_report": view.kpi_summary_report(f)}
    assert set(c) == set(want)
    for name, table in want.items():
        same(c[name], table)


def test_words_hold_each_key_once(both):
    df, cube = both
    m = {r.kind: r.n for r in cube.marks.groupBy("kind", "word").agg(F.bit_or("mask").alias("m")).groupBy("kind").agg(F.sum(F.bit_count("m")).alias("n")).collect()}
    d = df.agg(*[F.count_distinct(k) for _, k, _ in cb.KINDS]).first()
    assert [m["invoice"], m["customer"], m["product"]] == list(d)
    words = {r.kind: r.n for r in cube.marks.groupBy("kind").agg(F.count_distinct("word").alias("n")).collect()}
    assert words == {k: -(-v // cb.WORD_BITS) for k, v in m.items()}


def test_dates_prune_the_folders(both):
    df, cube = both
    f = cube.where(view.sales_predicate("2010-12-05", "2011-01-20", columns=df.columns))
    for table in (f.cells, f.marks):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(((" in plan or "PartitionFilters: [((" in plan
        assert "Year" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_empty_and_without_segments(spark):
    none = cb.write_cube(lines(spark, 30).where("false"))
    row = cb.kpis(none).first()
    assert row.total_revenue == 0 and row.total_customers == 0 and cb.country_summary(none).collect() == []
    plain = lines(spark, 300).drop("Customer_Segment", "HasCustomerID")
    same(cb.kpis(cb.write_cube(plain)), view.kpis(plain))


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(materialize, "scratch_dir", lambda _, name: made.append(name) or str(tmp_path / f"{name}-{len(made)}"))
    cube = cb.write_cube(lines(spark, 200))
    kept = {f.replace("file://", "").replace("file:", "") for t in (cube.cells, cube.marks) for f in t.inputFiles()}
    assert len(made) == 8 and {f for f in files_under(str(tmp_path)) if f.endswith(".parquet")} == {f.replace("%3A", ":") for f in kept}


def test_dashboard_view_reads_the_cube(spark, sf_small):
    from tillroll.plans.catalog import cube_table, segmented
    seg, cube = segmented(spark, sf_small), cube_table(spark, sf_small)
    chosen = dict(date_from="1996-01-01", date_to="1997-06-30", countries=["United Kingdom"], basket_item="Description")
    scan, merged = reports.dashboard_view(seg, **chosen), reports.dashboard_view(seg, **chosen, cube=cube)
    assert set(scan) == set(merged)
    for name in cb.panels(cube, F.lit(True)):
        same(merged[name], scan[name])
