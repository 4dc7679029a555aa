"""Incremental ingest of raw export files (Structured Streaming form of S1/S4).

The reference has no streaming: every job reads a finished file.  What an
operator of this library may still want is to land raw export files as they
arrive, so the batch cleaning job always reads a complete, typed raw table.
``raw_csv_stream`` reads new CSV files with the same options and schema as
``scan_raw_csv``; ``land_raw`` appends them to a Parquet table with a
checkpoint, so each file is ingested exactly once even if the query or an
executor restarts.  No analysis is computed here: all analyses stay batch
jobs over the landed table (``plans.reports``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.sources.schemas import RAW_CSV_SCHEMA


def raw_csv_stream(spark: SparkSession, path: str, ts_format: str = "M/d/yyyy H:mm",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of raw export CSV files arriving under ``path``."""
    reader = (spark.readStream.schema(RAW_CSV_SCHEMA)
              .option("header", True).option("encoding", "ISO-8859-1")
              .option("quote", '"').option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.csv(path)
    return df.withColumn("InvoiceDate", F.to_timestamp_ntz("InvoiceDate", F.lit(ts_format)))


def land_raw(stream: DataFrame, table_path: str, checkpoint_path: str,
             available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Append the streamed raw lines to a Parquet table (file sink: exactly
    once with the checkpoint).  ``available_now`` processes what is there and
    stops; otherwise the query keeps running on ``processing_time``."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", table_path).option("checkpointLocation", checkpoint_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
