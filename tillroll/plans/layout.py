"""Lines stored by key, so that per-key results come back without moving them.

Per-invoice features and per-customer segments are computed per key and put
back on every line.  ``write_keyed`` shuffles the lines once, as it writes them:
the table is bucketed by (key, salt).  Afterwards an aggregate per key and the
join that brings per-key rows back read it as it lies; only per-key rows move.

The salt is 0 but for *hot* keys (more than ``fraction`` of all lines, so at most
``1 / fraction`` of them, which bounds what is broadcast) and for null keys:
their lines are dealt over as many salts as there are buckets.  A per-key row of
a hot key is copied to each salt; null keys match nothing, as in a left join.

There are as many buckets as shuffle partitions, or more: a bucket is written and
sorted by one task, so it holds about ``BUCKET_LINES`` lines however many there
are in all (some 100 MB in memory, of the 0.9 GB or more that a task has).  Lines that
may be read repeatedly move in rounds, a part of the buckets after another: on the
way to their table many lines take several times its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import cut, drop_cut, partitions_for, shuffles_end
from tillroll.session import scratch_dir

HOT_FRACTION = 1e-4  # at most 10,000 hot keys are broadcast
BUCKET_LINES = 1 << 18
ROUNDS = 4
ROUND_LINES = 1 << 20  # fewer move at once
SALT = "_salt"


@dataclass(frozen=True)
class KeyedTable:
    """Lines bucketed by ``key`` and salt; ``hot`` has the hot keys."""

    table: DataFrame
    key: str
    salts: int
    hot: DataFrame

    @property
    def lines(self) -> DataFrame:
        return self.table.drop(SALT)

    def aggregate(self, aggs: Sequence[Column]) -> DataFrame:
        """One row per non-null key.  Lines of other keys lie together already;
        those of the (few) hot keys are combined map-side and then meet."""
        known = self.table.where(F.col(self.key).isNotNull())
        hot = F.broadcast(self.hot)
        cold = known.where(F.col(SALT) == 0).join(hot, self.key, "left_anti").groupBy(self.key, SALT).agg(*aggs).drop(SALT)
        return cold.unionByName(known.join(hot, self.key, "left_semi").groupBy(self.key).agg(*aggs))

    def attach(self, per_key: DataFrame) -> DataFrame:
        """``lines LEFT JOIN per_key USING (key)``; ``per_key`` has a row per key.
        The lines are read as they are stored: no exchange above their scan."""
        flagged = per_key.join(F.broadcast(self.hot.withColumn("_hot", F.lit(True))), self.key, "left")
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
        spread = flagged.withColumn(SALT, F.explode(salts)).drop("_hot")
        return self.table.join(spread, [self.key, SALT], "left").drop(SALT)


def write_keyed(df: DataFrame, key: str, name: str, fraction: float = HOT_FRACTION,
                finish: Callable[[DataFrame], DataFrame] | None = None, together: Column | None = None,
                counted: DataFrame | None = None, rounds: int = 1) -> KeyedTable:
    """Write ``df`` by ``key`` into the shared folder.  One narrow scan finds the
    hot keys, one pass writes.  ``finish`` derives columns; it comes after the
    lines have moved, so that these don't move too.  Lines of a null or hot key
    with the same non-null ``together`` get the same salt, so that ``finish`` can
    read them by (key, salt, together) without another move.  ``counted`` has
    numbers of lines (``_c``) by ``key`` or finer, if they are known already.

    With ``rounds`` many lines move in so many parts; ``df`` is read for each and
    must give the same rows every time (a line's part follows from its values, as
    its place may differ)."""
    spark = df.sparkSession
    lines = F.count(F.lit(1)) if counted is None else F.sum("_c")
    written = cut((df if counted is None else counted).groupBy(key).agg(lines.alias("_c")), f"{name}-counts")
    total = written.agg(F.sum("_c")).first()[0] or 0
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_LINES))
    rounds = max(1, min(rounds, -(-total // ROUND_LINES)))
    counts = written.where(F.col(key).isNotNull())
    hot = attach_one_row(counts, counts.agg(F.sum("_c").alias("_n"))).where(F.col("_c") > F.col("_n") * F.lit(fraction))
    hot = cut(hot.select(key), f"{name}-hot")
    drop_cut(written)
    deal = F.xxhash64(F.monotonically_increasing_id())
    if together is not None:
        deal = F.when(together.isNotNull(), F.xxhash64(together)).otherwise(deal)
    dealt = F.pmod(deal, F.lit(salts)).cast("int")
    salted = (df.withColumn("_deal", dealt).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
              .withColumn("_dealt", F.coalesce(F.col("_hot"), F.lit(False)) | F.col(key).isNull())
              .withColumn(SALT, F.when(F.col("_dealt"), F.col("_deal")).otherwise(F.lit(0))))
    # whole buckets, but for lines whose salt follows from their place
    alone = F.col("_dealt") if together is None else F.col("_dealt") & together.isNull()
    part = F.pmod(F.when(alone, F.xxhash64(*df.columns)).otherwise(F.pmod(F.hash(key, SALT), F.lit(salts))), F.lit(rounds))
    table, path = f"tillroll_{name.replace('-', '_')}_{uuid.uuid4().hex}", scratch_dir(spark, name)
    with partitions_for(spark, total), shuffles_end(spark):
        for i in range(rounds):
            lines = salted if rounds == 1 else salted.where(part == i)
            moved = lines.select(*df.columns, SALT).repartition(salts, key, SALT)
            if finish is not None:
                moved = finish(moved)
            (moved.select(*[c for c in moved.columns if c != SALT], SALT)
             .write.mode("append").format("parquet").option("path", path).bucketBy(salts, key, SALT).sortBy(key, SALT).saveAsTable(table))
    return KeyedTable(spark.table(table), key, salts, hot)

