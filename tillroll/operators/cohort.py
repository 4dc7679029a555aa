"""Cohort retention.

A customer's months are bits: one per month of the data, ``bit_or``-ed over the
lines, map-side first, so one row of (customer, bits) per task and customer is
all that is shuffled, however many lines a customer has.  The first month is the
lowest bit, and the later ones are read off the bits: no window, no join.
Customers with the same months count together before the bits are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators.cleaning import identified_customers

_WORD = 62  # months per BIGINT


def _month_number(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def _has(words: list[str], month: Column) -> Column:
    """Whether the bit of a month (from 0) is set."""
    word = F.array(*words)[F.floor(month / _WORD).cast("int")]
    return F.call_function("shiftright", word, month % _WORD).bitwiseAND(F.lit(1)) == 1


def customer_months(df: DataFrame) -> tuple[DataFrame, list[str], int, int]:
    """(customers, words, months, first): ``CustomerID`` and the columns ``words``
    with the bits of ``months`` months from month number ``first`` on.  One small
    scan finds the range of months, one aggregate sets the bits."""
    lines = identified_customers(df).where(F.col("InvoiceDate").isNotNull())
    m = _month_number(F.col("InvoiceDate"))
    lo, hi = lines.agg(F.min(m), F.max(m)).first()
    months = 0 if lo is None else hi - lo + 1
    words = [f"_w{i}" for i in range(max(1, -(-months // _WORD)))]
    at = m - F.lit(lo or 0)
    bit = lambda i: F.when(F.floor(at / _WORD) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), at % _WORD)).otherwise(F.lit(0).cast("bigint"))
    return lines.groupBy("CustomerID").agg(*[F.bit_or(bit(i)).alias(w) for i, w in enumerate(words)]), words, months, lo or 0


def cohort_retention(df: DataFrame) -> DataFrame:
    """Long form: CohortGroup, PeriodNumber, Customers, CohortSize,
    RetentionRate (period 0 = 1)."""
    customers, words, months, first = customer_months(df)
    alike = customers.groupBy(*words).agg(F.count(F.lit(1)).alias("c"))
    seen = F.filter(F.sequence(F.lit(0), F.lit(max(0, months - 1))), lambda k: _has(words, k))
    spread = (alike.select("c", seen.alias("seen")).select("c", F.array_min("seen").alias("start"), F.explode("seen").alias("month")))
    number = F.lit(first - 1) + F.col("start")  # months are numbered from 1
    counts = (spread.groupBy(F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)).alias("CohortGroup"),
                             (F.col("month") - F.col("start")).alias("PeriodNumber"))
                    .agg(F.sum("c").alias("Customers")))
    # Cohort size is the period-0 count; cohorts x periods is bounded by
    # months^2, so this window is on a tiny table.
    size = F.max(F.when(F.col("PeriodNumber") == 0, F.col("Customers"))).over(
        Window.partitionBy("CohortGroup"))
    return (counts.withColumn("CohortSize", size)
                  .withColumn("RetentionRate", F.col("Customers") / F.col("CohortSize")))


def cohort_avg_retention(df: DataFrame) -> DataFrame:
    """Unweighted mean retention per period over the cohorts that have
    that period (absent cells are skipped)."""
    return (cohort_retention(df).groupBy("PeriodNumber")
            .agg(tf.round_sig(F.avg("RetentionRate"), 12).alias("AvgRetention"),
                 F.count(F.lit(1)).alias("Cohorts")))


def cohort_matrix(retention: DataFrame, periods: list[int]) -> DataFrame:
    """CohortGroup x PeriodNumber pivot of RetentionRate.  ``periods``
    is passed explicitly so the pivot needs no extra distinct job."""
    return (retention.groupBy("CohortGroup")
            .pivot("PeriodNumber", periods)
            .agg(F.first("RetentionRate")))
