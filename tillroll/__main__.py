"""Command line for the composite jobs.

    python -m tillroll clean RAW_CSV OUT_DIR [--report REPORT_DIR]
    python -m tillroll analysis CLEANED_DIR OUT_DIR
    python -m tillroll business CLEANED_DIR OUT_DIR [--basket-item Description]
    python -m tillroll dashboard CLEANED_DIR OUT_DIR [--from D] [--to D]
                      [--country C ...] [--category C ...] [--segment S]

Every result table is written as Parquet under OUT_DIR/<table name>; the
dashboard's five-line summary also as CSV under OUT_DIR/summary_csv.  The
session comes from the environment (spark-submit / cluster defaults); only
settings that are unset get the library's defaults.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession


def _write_all(tables: dict, out_dir: str) -> list[str]:
    written = []
    for name, df in tables.items():
        path = os.path.join(out_dir, name)
        df.write.mode("overwrite").parquet(path)
        written.append(path)
    return written


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    from tillroll.operators.view import write_summary_csv
    from tillroll.plans import reports
    from tillroll.session import get_session
    from tillroll.sources.retail import scan_cleaned, scan_raw_csv

    p = argparse.ArgumentParser(prog="tillroll")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("clean", help="raw export CSV -> cleaned table (+ JSON quality report)")
    c.add_argument("raw")
    c.add_argument("out")
    c.add_argument("--report")
    for name in ("analysis", "business", "dashboard"):
        s = sub.add_parser(name)
        s.add_argument("cleaned")
        s.add_argument("out")
        if name == "business":
            s.add_argument("--basket-item", default="Description")
        if name == "dashboard":
            s.add_argument("--from", dest="date_from")
            s.add_argument("--to", dest="date_to")
            s.add_argument("--country", action="append", default=[])
            s.add_argument("--category", action="append", default=[])
            s.add_argument("--segment", default="All")
            s.add_argument("--basket-item", default="Description")
    a = p.parse_args(argv)

    spark = spark or get_session()
    if a.cmd == "clean":
        reports.cleaning_job(scan_raw_csv(spark, a.raw), a.out, a.report)
        return [a.out] + ([a.report] if a.report else [])
    cleaned = scan_cleaned(spark, a.cleaned)
    if a.cmd == "analysis":
        return _write_all(reports.analysis_report(cleaned), a.out)
    if a.cmd == "business":
        return _write_all(reports.business_report(cleaned, a.basket_item), a.out)
    seg = reports.segmented_lines(cleaned, os.path.join(a.out, "_segmented_lines"))
    tables = reports.dashboard_view(seg, a.date_from, a.date_to, a.country, a.category, a.segment, a.basket_item)
    summary = os.path.join(a.out, "summary_csv")
    write_summary_csv(tables["kpi_summary_report"], summary)
    return _write_all(tables, a.out) + [summary]


if __name__ == "__main__":
    main(sys.argv[1:])
