from tillroll.streaming.ingest import land_raw, raw_csv_stream

__all__ = ["land_raw", "raw_csv_stream"]
