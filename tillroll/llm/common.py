"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.session import scratch_dir

_SHIPPED: set[str] = set()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Ready a session for the operators, once per application.

    Sends this package's source files to the executors' Python (what
    ``--py-files`` does), so that a session that was not started beside the
    package can run them.  Lowers the size of an Arrow batch from Spark's 64 MB
    to 8 MB, as a worker and its JVM task each hold several of texts or sets;
    another setting of the user's is left."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        if spark.conf.get(BATCH_BYTES).rstrip("bB") == str(64 << 20):
            spark.conf.set(BATCH_BYTES, str(8 << 20))
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="tillroll-py-"), "tillroll_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "tillroll")):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and scan it: cuts the lineage, so a
    lost executor replays one table and not the whole operator."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._written_at = path
    if _STAGE is not None:
        _STAGE.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_at)


_STAGE: list[str] | None = None
_LEFT: dict[str, list[str]] = {}


@contextmanager
def stage(spark: SparkSession, docs: DataFrame):
    """A pipeline stage: what it writes through ``written`` is noted.  A stage's
    result is written before the next one starts, so the tables that earlier
    stages of this application left are deleted now, but for those that
    ``docs`` still reads (a caller who didn't write the result)."""
    global _STAGE
    ship(spark)
    app = spark.sparkContext.applicationId
    files = docs.inputFiles() if _LEFT.get(app) else []
    keep = {p for p in _LEFT.get(app, []) if any(f"/{os.path.basename(p)}/" in f for f in files)}
    for p in _LEFT.pop(app, []):
        if p not in keep:
            _delete(spark, p)
    _STAGE = []
    try:
        yield
    finally:
        _LEFT[app], _STAGE = [*keep, *_STAGE], None


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches one at a time, so that a batch of long texts is
    never held twice."""
    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


class Out:
    """Collects output rows and hands them out as Arrow batches of at most
    ``max_rows`` rows or ``max_bytes`` counted bytes."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 8 << 20):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self.clear()

    def clear(self) -> None:
        self.cols: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> None:
        for c, v in zip(self.cols, row, strict=True):
            c.append(v)
        self.size += size

    def full(self) -> bool:
        return len(self.cols[0]) >= self.max_rows or self.size >= self.max_bytes

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema, strict=True)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
