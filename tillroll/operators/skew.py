"""Hot-key splitting for joins of per-key results back onto lines.

Per-invoice features and per-customer segments are computed by an aggregate
and joined back to every line.  When one key holds a large share of the lines
(an invoice or customer with a third of all rows), a shuffle join sends all
of them to one task — and AQE's skew-join split does not apply here, because
the per-key side is an aggregate already partitioned on the key (no exchange
of its own).  ``join_back`` therefore splits hot keys explicitly:

* hot keys are those with more than ``fraction`` of all lines, so there are
  at most ``1 / fraction`` of them — a proven bound, safe to broadcast;
* lines of hot keys join their per-key row through a broadcast hash join
  (map-side, spread over every task that holds them);
* the remaining lines take the ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scalars import attach_one_row

HOT_FRACTION = 1e-4  # at most 10,000 hot keys are broadcast


def join_back(lines: DataFrame, per_key: DataFrame, key: str, count_col: str,
              fraction: float = HOT_FRACTION) -> DataFrame:
    """``lines LEFT JOIN per_key USING (key)`` with hot keys joined map-side.

    ``per_key`` has one row per non-null key and a ``count_col`` with the
    number of lines of that key (it is dropped from the result).  Lines with
    a null key never match and keep null values, as in a left join.
    """
    total = per_key.agg(F.sum(count_col).alias("_total"))
    hot = (attach_one_row(per_key, total)
                  .where(F.col(count_col) > F.col("_total") * F.lit(fraction))
                  .drop("_total", count_col))
    hot_keys = hot.select(key)
    hot_part = lines.join(F.broadcast(hot), key, "inner")
    cold_part = (lines.join(F.broadcast(hot_keys), key, "left_anti")
                      .join(per_key.drop(count_col), key, "left"))
    return hot_part.unionByName(cold_part)
