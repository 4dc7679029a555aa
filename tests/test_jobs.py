"""Composite jobs, sinks and the streaming ingest."""

import json
import os

from pyspark.sql import functions as F

from tillroll.plans import catalog, reports
from tillroll.session import scratch_dir
from tillroll.sources.retail import retail_raw, write_raw_csv
from tillroll.sources.schemas import CLEANED_COLUMNS
from tillroll.streaming import land_raw, raw_csv_stream


def test_cleaning_job_writes_table_and_report(spark, sf_small):
    out, rep = scratch_dir(spark, "job-cleaned"), scratch_dir(spark, "job-report")
    raw = retail_raw(spark, sf_small)
    cleaned = reports.cleaning_job(raw, out, rep)
    assert cleaned.count() == 5625  # FIXTURES §5, sf 0.001
    assert set(CLEANED_COLUMNS) <= set(cleaned.columns)
    # month partitions are pruned by a date filter
    plan = cleaned.where("Year = 1999 AND Month = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan
    files = [f for f in os.listdir(rep) if f.endswith(".json")]
    report = json.loads(open(os.path.join(rep, files[0])).readline())
    assert report["initial_rows"] == 6017 and report["final_rows"] == 5625
    assert report["unique_customers"] == 112 and report["countries"] == 25
    assert report["missing_data"]["Description"] == 32 and report["missing_data"]["CustomerID"] == 1481
    assert report["data_types"]["InvoiceDate"] == "timestamp_ntz" and report["data_types"]["Quantity"] == "bigint"


def test_reports_build_and_run(spark, sf_small):
    cl = catalog.cleaned(spark, sf_small)
    a = reports.analysis_report(cl)
    b = reports.business_report(cl, basket_item="Brand")
    seg = reports.segmented_lines(cl)
    d = reports.dashboard_view(seg, "1996-01-01", "2000-12-31", countries=["United Kingdom"],
                               basket_item="PType")
    for name, df in {**a, **b, **d}.items():
        df.write.format("noop").mode("overwrite").save()
    assert a["monthly_trends"].count() == 80
    assert d["kpis"].first()["total_revenue"] > 0


def test_streaming_ingest_lands_each_file_once(spark, sf_small):
    src, table, ckpt = (scratch_dir(spark, n) for n in ("stream-src", "stream-table", "stream-ckpt"))
    raw = retail_raw(spark, sf_small, with_items=False)
    part1 = raw.where(F.col("InvoiceNo").substr(-1, 1).isin("0", "1", "2", "3", "4"))
    part2 = raw.subtract(part1)
    write_raw_csv(part1, os.path.join(src, "batch1"))
    q = land_raw(raw_csv_stream(spark, os.path.join(src, "*")), table, ckpt, available_now=True)
    q.awaitTermination()
    n1 = spark.read.parquet(table).count()
    write_raw_csv(part2, os.path.join(src, "batch2"))
    q = land_raw(raw_csv_stream(spark, os.path.join(src, "*")), table, ckpt, available_now=True)
    q.awaitTermination()
    landed = spark.read.parquet(table)
    assert n1 == part1.count()
    assert landed.count() == raw.count()


def test_missing_cleaned_input_raises(spark):
    import pytest
    from pyspark.errors import AnalysisException
    from tillroll.sources.retail import scan_cleaned
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan_cleaned(spark, os.path.join(scratch_dir(spark, "missing"), "nothing-here"))


def test_command_line_end_to_end(spark, sf_small):
    from tillroll.__main__ import main
    raw_csv, cleaned_dir, rep = (scratch_dir(spark, n) for n in ("cli-raw", "cli-cleaned", "cli-report"))
    write_raw_csv(retail_raw(spark, sf_small, with_items=False), raw_csv)
    main(["clean", raw_csv, cleaned_dir, "--report", rep], spark)
    assert spark.read.parquet(cleaned_dir).count() == 5625
    out = scratch_dir(spark, "cli-analysis")
    paths = main(["analysis", cleaned_dir, out], spark)
    assert spark.read.parquet(os.path.join(out, "monthly_trends")).count() == 80 and len(paths) >= 10
    out_b = scratch_dir(spark, "cli-business")
    main(["business", cleaned_dir, out_b], spark)
    assert spark.read.parquet(os.path.join(out_b, "sales_forecast")).count() == 6
    out_d = scratch_dir(spark, "cli-dashboard")
    main(["dashboard", cleaned_dir, out_d, "--from", "1996-01-01", "--to", "1999-12-31",
          "--country", "United Kingdom"], spark)
    assert spark.read.parquet(os.path.join(out_d, "kpis")).first()["total_revenue"] > 0


def test_raw_csv_latin1_quotes_and_blanks_round_trip(spark):
    import datetime as dt
    import glob
    from tillroll.sources.retail import scan_raw_csv
    rows = [("536365", "85123A", ' CAFÉ "NO.1" MUG, £5 ', 6, dt.datetime(2010, 12, 1, 8, 26), 2.55, 17850.0, "United Kingdom"),
            ("C536379", "D", None, -1, dt.datetime(2011, 1, 9, 17, 5), 27.5, None, " eire ")]
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity bigint, "
                                     "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double, Country string")
    path = scratch_dir(spark, "latin1-csv")
    write_raw_csv(df, path)
    data = b"".join(open(f, "rb").read() for f in glob.glob(os.path.join(path, "*.csv")))
    assert "CAFÉ".encode("latin-1") in data and "£5".encode("latin-1") in data  # bytes are ISO-8859-1
    assert b"12/1/2010 8:26" in data                                               # M/d/yyyy H:mm
    back = scan_raw_csv(spark, path).orderBy("InvoiceNo").collect()
    assert [tuple(r) for r in back] == sorted(rows, key=lambda r: r[0])
