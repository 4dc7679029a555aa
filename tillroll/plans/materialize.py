"""Lineage cuts at natural table boundaries.

A plan that attaches several one-row statistics (quantile fences, snapshot,
bin edges) to a table derived from a long lineage re-plans that lineage for
every statistic.  The jobs therefore write their boundary tables — the
cleaned lines, the per-customer RFM table, the segmented lines — once into
the shared checkpoint folder (``spark.checkpoint.dir``) and read them back.
That is also the reference's own contract between its stages (a written
cleaned file), and a written table survives executor loss without
recomputing its lineage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import scratch_dir

_WRITTEN: dict[tuple[str, str], str] = {}
_MADE: dict[tuple[str, str], object] = {}


def _app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no SparkContext
        return spark.conf.get("spark.app.id", "app")


def _state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the names, sizes and times of the files at ``paths``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for s in fs.listStatus(path):
            seen.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def written_table(spark: SparkSession, key: str, build: Callable[[], DataFrame],
                  partition_by: Sequence[str] = (), sources: Sequence[str] = ()) -> DataFrame:
    """Write ``build()`` once per session under ``key`` and return a scan.

    ``key`` must identify the content, since later calls with the same key
    reuse the written table; ``sources`` are input paths whose files' sizes and
    times become part of it, so that changed inputs are read again.
    """
    k = _written_key(spark, key, sources)
    path = _WRITTEN.get(k)
    if path is None:
        path = scratch_dir(spark, k[1].replace("/", "_").strip("_")[-60:])
        with shuffles_end(spark):
            writer = build().write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
        _WRITTEN[k] = path
    df = spark.read.parquet(path)
    return df


def _written_key(spark: SparkSession, key: str, sources: Sequence[str]) -> tuple[str, str]:
    return _app_id(spark), f"{key}:{_state(spark, sources)}" if sources else key


def is_written(spark: SparkSession, key: str, sources: Sequence[str] = ()) -> bool:
    """Whether ``written_table`` has this table already."""
    return _written_key(spark, key, sources) in _WRITTEN


def drop_written(spark: SparkSession, key: str, sources: Sequence[str] = ()) -> None:
    """Delete a table of ``written_table`` that nothing made so far will read any
    more; whoever asks for it later has it written again."""
    _delete(spark, _WRITTEN.pop(_written_key(spark, key, sources)))


def once(spark: SparkSession, key: str, build: Callable[[], object], sources: Sequence[str] = ()) -> object:
    """``build()``, made once per session under ``key`` (see ``written_table``)."""
    k = (_app_id(spark), f"{key}:{_state(spark, sources)}")
    if k not in _MADE:
        _MADE[k] = build()
    return _MADE[k]


def cut(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and scan it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with shuffles_end(spark):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return _scan_cut(spark, path, df)


def cut_more(table: DataFrame, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add ``df`` to a table made by ``cut`` and scan both."""
    with shuffles_end(df.sparkSession):
        df.write.mode("append").partitionBy(*partition_by).parquet(table._cut_at)
    return _scan_cut(df.sparkSession, table._cut_at, df)


def _scan_cut(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    out = spark.read.schema(df.schema).parquet(path)  # an empty table by folders has no file to tell it
    out._cut_at = path
    return out


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffles' files as they end.  Otherwise these stay
    until the driver collects its memory, and a job that goes on from table to
    table has the moves of all of them on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


PARTITION_ROWS = 1 << 18


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[int]:
    """Jobs run inside shuffle ``rows`` rows in pieces of about ``PARTITION_ROWS``:
    a task's sort or hash table does not grow with the input.  The session's
    number of partitions is used if it is larger, and is back afterwards."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    number = max(1, int(before), -(-rows // PARTITION_ROWS))
    spark.conf.set(name, str(number))
    try:
        yield number
    finally:
        spark.conf.set(name, before)


def drop_cut(table: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing will read any more."""
    _delete(table.sparkSession, table._cut_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
