"""Trend + seasonal-index forecast.

The monthly table has one row per month, so the windows below run on a
table bounded by the calendar, never on lines.  ``by`` groups let the fit run
per country or category in one distributed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf


def monthly_series(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A26 + W8: revenue (exact units), invoices, month-start Date and the
    MonthNumber 0..n-1 in date order (gaps are not counted)."""
    by = list(by)
    m = (df.groupBy(*by, "Year", "Month")
           .agg(F.sum(tf.money_units("TotalAmount")).alias("_units"),
                F.count_distinct("InvoiceNo").alias("Transactions")))
    w = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(1))
    return (m.withColumn("Date", F.make_date("Year", "Month", F.lit(1)))
             .withColumn("MonthNumber", F.row_number().over(w.orderBy("Year", "Month")) - 1)
             .withColumn("Revenue", tf.units_to_money("_units")))


def sales_trend_fit(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line Revenue ~ MonthNumber: slope, intercept, R^2."""
    s = monthly_series(df, by)
    return (s.groupBy(*by).agg(
        tf.round_sig(F.regr_slope("Revenue", "MonthNumber"), 10).alias("slope"),
        tf.round_sig(F.regr_intercept("Revenue", "MonthNumber"), 10).alias("intercept"),
        tf.round_sig(F.regr_r2("Revenue", "MonthNumber"), 10).alias("r2"),
        F.count(F.lit(1)).alias("months")))


def seasonal_index(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue per calendar month / mean of those monthly sums (a month
    present in two years counts double, as in the reference)."""
    by = list(by)
    g = df.groupBy(*by, "Month").agg(F.sum(tf.money_units("TotalAmount")).alias("_units"))
    w = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(1))
    # index = units / (total / k) computed as units * k / total in integers.
    return g.select(*by, "Month", tf.units_to_money("_units").alias("Revenue"),
                    ((F.col("_units") * F.count(F.lit(1)).over(w))
                     / F.sum("_units").over(w)).alias("SeasonalIndex"))


def forecast(df: DataFrame, horizon: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """For i = 1..horizon after the last month: trend at MonthNumber,
    times the seasonal index of the calendar month (null when that month has
    no history); ForecastDate is the i-th month end after the last month."""
    by = list(by)
    s = monthly_series(df, by)
    fit = s.groupBy(*by).agg(F.regr_slope("Revenue", "MonthNumber").alias("_slope"),
                             F.regr_intercept("Revenue", "MonthNumber").alias("_icpt"),
                             F.max("MonthNumber").alias("_last_n"),
                             F.max_by("Month", "MonthNumber").alias("_last_m"),
                             F.max("Date").alias("_last_d"))
    steps = fit.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fut = steps.select(
        *by,
        (F.col("_last_n") + F.col("i")).alias("MonthNumber"),
        (F.pmod(F.col("_last_m") + F.col("i") - 1, F.lit(12)) + 1).alias("Month"),
        (F.col("_slope") * (F.col("_last_n") + F.col("i")) + F.col("_icpt")).alias("_trend"),
        F.last_day(F.add_months("_last_d", F.col("i"))).alias("ForecastDate"))
    idx = seasonal_index(df, by).select(*by, "Month", "SeasonalIndex")
    return (fut.join(idx, [*by, "Month"], "left")
               .select(*by, "MonthNumber", "Month", "ForecastDate",
                       tf.round_sig(F.col("_trend") * F.col("SeasonalIndex"), 10).alias("ForecastRevenue")))


def forecast_total(df: DataFrame, horizon: int = 6) -> DataFrame:
    """Total of the forecast horizon."""
    return forecast(df, horizon).agg(tf.round_sig(F.sum("ForecastRevenue"), 10).alias("ForecastTotal"))
