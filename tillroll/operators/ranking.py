"""Distributed global row numbers and exact quantiles.

``row_number().over(Window.orderBy(...))`` without a partition key moves every
row into one task.  Instead rows are range-partitioned, and written once with
the partition they fell into.  Whatever reads that table sees the same
partitions; totals per partition (as many rows as there are partitions, so
broadcasting them is size-safe) turn places inside a partition into global ones.

The ``percentile`` aggregate merges a map of values in one task; exact quantiles
come from radix selection instead, which moves counts of digits only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.radix import quantiles
from tillroll.plans.materialize import cut

_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position


def _ranged(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with partition ``_pid``
    and place ``_pos`` inside it (from 0), written once."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), _POS_BITS)
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                 .withColumns({"_pid": F.spark_partition_id(), "_pos": place}), "ranged")


def _offsets(totals: DataFrame, col: str) -> DataFrame:
    """Sum of ``col`` over the partitions before each one (one row per
    partition: the window holds no more than that)."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_pid", F.coalesce(F.sum(col).over(before), F.lit(0)).alias("_off")))


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based row number over ``order``, which should be a total order
    (end with a unique key) when the numbers must be reproducible.  A hot sort
    value is split by the order columns after it."""
    ranged = _ranged(df, order, num_partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    numbered = (ranged.join(_offsets(counts, "_cnt"), "_pid")
                      .withColumn(out, F.col("_off") + F.col("_pos") + 1)
                      .drop("_pid", "_pos", "_off"))
    numbered._cut_at = ranged._cut_at  # for drop_cut
    return numbered


def top_k(df: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``k`` rows by ``order`` (TakeOrderedAndProject: a per-task top-k
    heap, then one merge of k rows per task)."""
    return df.orderBy(*order).limit(k)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """One row with an array of exact, linearly interpolated quantiles of
    ``col`` (nulls ignored; nulls in the array without any value), found by
    radix selection (``operators/radix``)."""
    values = quantiles(df, {col: probs})[col]
    return df.sparkSession.range(1).select(F.array(*[F.lit(v).cast("double") for v in values]).alias(name))
