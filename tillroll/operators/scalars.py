"""Attaching one-row statistics to a table.

Several operators need a scalar computed by a global aggregate (a snapshot
date, a mean lifespan, a row count, quantile fences) next to every row.
``attach_one_row`` is the only place where the library joins without keys,
and it accepts only relations that Catalyst itself bounds to one row
(``maxRows == 1``: global aggregates and products of them).  The join is then
a broadcast of a single row and a map-side projection, never a cartesian
product of data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _max_rows(df: DataFrame) -> int | None:
    """Catalyst's static row bound of ``df``; None when it knows of none."""
    bound = df._jdf.queryExecution().analyzed().maxRows()
    return int(bound.get()) if bound.isDefined() else None


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of the one-row relation ``one_row`` to every row of
    ``df``.  Raises if Catalyst cannot prove ``one_row`` has at most one row."""
    bound = _max_rows(one_row)
    if bound is None or bound > 1:
        raise ValueError(f"attach_one_row needs a relation of at most one row, got bound {bound}")
    return df.crossJoin(F.broadcast(one_row))
