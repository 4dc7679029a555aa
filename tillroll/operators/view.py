"""Dashboard view: filters, KPIs, filter domains and exports (F7-F10, A30,
A31, A40, A41, S6-S8).

Filters are plain predicates on the lines, so Catalyst pushes the date and
country terms into the Parquet scan of the cleaned table and skips the folders
of other months; the KPI deltas compute the filtered and the total figures in
the same conditional aggregates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators.scalars import attach_one_row


def sales_predicate(date_from: dt.date | str | None = None, date_to: dt.date | str | None = None,
                    countries: Sequence[str] = (), categories: Sequence[str] = (),
                    segment: str = "All", columns: Sequence[str] = ()) -> Column:
    """F7-F10 as one predicate.  The date range is inclusive of both days and
    compares the raw timestamp column (no cast, so it can be pushed down).  If
    ``columns`` have the Year and Month derived from it, the same range is said
    of them, too, so that a table partitioned by month skips folders."""
    cond = F.lit(True)
    first = None if date_from is None else dt.date.fromisoformat(str(date_from))
    last = None if date_to is None else dt.date.fromisoformat(str(date_to))
    if first is not None:
        cond = cond & (F.col("InvoiceDate") >= F.lit(str(first)).cast("timestamp_ntz"))
    if last is not None:
        cond = cond & (F.col("InvoiceDate") < F.lit(str(last + dt.timedelta(days=1))).cast("timestamp_ntz"))
    if {"Year", "Month"} <= set(columns):
        # what the dates say about the sink's folders, so that others aren't read
        for day, beyond in ((first, lambda c, x: c > x), (last, lambda c, x: c < x)):
            if day is not None:
                year, month = F.col("Year"), F.col("Month")
                cond = cond & (beyond(year, day.year) | ((year == day.year) & (beyond(month, day.month) | (month == day.month))))
    if countries:
        cond = cond & F.col("Country").isin(list(countries))
    if categories and (not columns or "ProductCategory" in columns):
        cond = cond & F.col("ProductCategory").isin(list(categories))
    if segment != "All" and (not columns or "Customer_Segment" in columns):
        cond = cond & (F.col("Customer_Segment") == F.lit(segment))
    return cond


def filter_sales(df: DataFrame, date_from=None, date_to=None, countries: Sequence[str] = (),
                 categories: Sequence[str] = (), segment: str = "All") -> DataFrame:
    """C4 filter step."""
    return df.where(sales_predicate(date_from, date_to, countries, categories, segment, df.columns))


def _kpi_row(df: DataFrame, pred: Column | None = None) -> DataFrame:
    """One row of KPI figures over all lines and, with ``_f``, over those where
    ``pred`` holds.  Invoices (with the sums), customers and products are each
    one narrow aggregate: a line is one row in it, combined map-side by a key of
    its own type, so what is shuffled are keys and not lines."""
    ident = F.col("CustomerID").isNotNull()
    if "HasCustomerID" in df.columns:
        ident = ident & F.coalesce(F.col("HasCustomerID"), F.lit(False))
    hit = F.lit(False) if pred is None else F.coalesce(pred, F.lit(False))
    both = [("", F.lit(True)), ("_f", hit)] if pred is not None else [("", F.lit(True))]
    u = tf.money_units("TotalAmount")
    invoices = df.groupBy("InvoiceNo").agg(*[x for sfx, on in both for x in (
        F.sum(F.when(on, u)).alias(f"u{sfx}"), F.count_if(on & ident).alias(f"c{sfx}"), F.max(on).alias(f"hit{sfx}"))])
    out = invoices.agg(*[x for sfx, _ in both for x in (
        F.coalesce(F.sum(f"u{sfx}"), F.lit(0)).alias(f"_units{sfx}"), F.count_if(F.col("InvoiceNo").isNotNull() & F.col(f"hit{sfx}")).alias(f"total_transactions{sfx}"),
        F.coalesce(F.sum(f"c{sfx}"), F.lit(0)).alias(f"customer_transactions{sfx}"))])
    for name, key, lines in (("total_customers", "CustomerID", df.where(ident)), ("total_products", "StockCode", df.where(F.col("StockCode").isNotNull()))):
        keys = lines.groupBy(key).agg(*[F.max(on).alias(f"hit{sfx}") for sfx, on in both])
        out = attach_one_row(out, keys.agg(*[F.count_if(F.col(f"hit{sfx}")).alias(f"{name}{sfx}") for sfx, _ in both]))
    return out


def _kpi_cols(suffix: str = "") -> list[Column]:
    units = F.col(f"_units{suffix}")
    rev = tf.units_to_money(units)
    return [
        rev.alias(f"total_revenue{suffix}"),
        F.col(f"total_transactions{suffix}"), F.col(f"total_customers{suffix}"),
        F.col(f"total_products{suffix}"),
        tf.ratio_or_zero(rev, F.col(f"total_transactions{suffix}")).alias(f"avg_order_value{suffix}"),
        tf.ratio_or_zero(rev, F.col(f"total_customers{suffix}")).alias(f"revenue_per_customer{suffix}"),
        F.col(f"customer_transactions{suffix}"),
        tf.ratio_or_zero(F.col(f"customer_transactions{suffix}"), F.col(f"total_customers{suffix}"))
          .alias(f"avg_orders_per_customer{suffix}"),
    ]


def kpis(df: DataFrame) -> DataFrame:
    """A16 + A30 + A40: one KPI row."""
    return _kpi_row(df).select(*_kpi_cols())


def kpi_deltas(df: DataFrame, pred: Column) -> DataFrame:
    """Filtered KPIs next to the totals and their differences, both from the
    same aggregates (see ``_kpi_row``)."""
    return deltas_of(_kpi_row(df, pred).select(*_kpi_cols(), *_kpi_cols("_f")))


def deltas_of(one: DataFrame) -> DataFrame:
    """A31 from one row of KPIs, in total and (``_f``) filtered."""
    return one.select(
        "total_revenue_f", "total_transactions_f", "total_customers_f", "avg_order_value_f",
        "total_products_f",
        F.when(F.col("total_revenue") > 0, (F.col("total_revenue_f") / F.col("total_revenue") - 1) * 100)
         .otherwise(F.lit(0.0)).alias("revenue_change_pct"),
        (F.col("total_transactions_f") - F.col("total_transactions")).alias("transactions_change"),
        (F.col("total_customers_f") - F.col("total_customers")).alias("customers_change"),
        F.when(F.col("avg_order_value") > 0,
               (F.col("avg_order_value_f") / F.col("avg_order_value") - 1) * 100)
         .otherwise(F.lit(0.0)).alias("aov_change_pct"),
        (F.col("total_products_f") - F.col("total_products")).alias("products_change"))


def filter_domains(df: DataFrame) -> DataFrame:
    """Selectable filter values in long form (domain, value): distinct
    countries, categories and segments, and the first and last date.

    One pass: lines are reduced to the combinations of values that occur, with
    their first and last date, and only those are taken apart into (domain,
    value).  Dates are compared as dates: minima of texts would sort all lines."""
    listed = [c for c in ("Country", "ProductCategory", "Customer_Segment") if c == "Country" or c in df.columns]
    date = F.to_date("InvoiceDate")
    seen = df.groupBy(*listed).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))
    bounds = ["min_date", "max_date"]
    pairs = [F.struct(F.lit(c).alias("domain"), F.col(c).alias("value")) for c in listed]
    pairs += [F.struct(F.lit(c).alias("domain"), F.date_format(c, "yyyy-MM-dd").alias("value")) for c in bounds]
    ex = seen.select(F.explode(F.array(*pairs)).alias("p")).select("p.domain", "p.value")
    ex = ex.where(F.col("value").isNotNull())
    # Date bounds: reduce to one value per domain; other domains: distinct.
    key = F.when(F.col("domain").isin(bounds), F.lit(None).cast("string")).otherwise(F.col("value"))
    g = ex.groupBy("domain", key.alias("_k")).agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    value = F.when(F.col("domain") == "max_date", F.col("_mx")).otherwise(F.col("_mn"))
    return g.select("domain", value.alias("value")).orderBy("domain", "value")


def kpi_summary_report(filtered: DataFrame) -> DataFrame:
    """S7 + P35: five (Metric, Value) rows with the values formatted as text:
    revenue '£1,234.50', counts '1,234', AOV '£12.34'."""
    return summary_of(kpis(filtered))


def summary_of(k: DataFrame) -> DataFrame:
    """S7 from one row of KPIs."""
    def row(pos: int, metric: str, value: Column) -> Column:
        return F.struct(F.lit(pos).alias("Position"), F.lit(metric).alias("Metric"), value.alias("Value"))

    rows = F.array(
        row(1, "Total Revenue", F.concat(F.lit("£"), F.format_number("total_revenue", 2))),
        row(2, "Total Transactions", F.format_number("total_transactions", 0)),
        row(3, "Unique Customers", F.format_number("total_customers", 0)),
        row(4, "Avg Order Value", F.concat(F.lit("£"), F.format_string("%.2f", F.col("avg_order_value")))),
        row(5, "Products Sold", F.format_number("total_products", 0)),
    )
    return k.select(F.explode(rows).alias("r")).select("r.*")


def write_summary_csv(report: DataFrame, path: str) -> None:
    """S7 sink: the five (Metric, Value) rows as one header CSV file."""
    (report.orderBy("Position").select("Metric", "Value").coalesce(1)
           .write.mode("overwrite").option("header", True).csv(path))


def sample_rows(df: DataFrame, n: int = 100) -> DataFrame:
    """First n rows in a fixed order (Spark has no file order)."""
    return df.orderBy("InvoiceNo", "StockCode", "Quantity", "UnitPrice", "InvoiceDate").limit(n)


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV export of the filtered lines (text kept verbatim)."""
    (df.write.mode("overwrite").option("header", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def read_export_csv(spark, path: str, schema) -> DataFrame:
    """Read an S6 export back with the schema it was written with."""
    return (spark.read.schema(schema).option("header", True)
                 .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                 .option("mode", "FAILFAST").csv(path))
