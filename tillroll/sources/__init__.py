from tillroll.sources.retail import (read_table, retail_raw, scan_cleaned, scan_raw_csv,
                                    write_cleaned, write_raw_csv)
from tillroll.sources.schemas import CLEANED_COLUMNS, RAW_COLUMNS, RAW_CSV_SCHEMA

__all__ = ["read_table", "retail_raw", "scan_cleaned", "scan_raw_csv", "write_cleaned",
           "write_raw_csv", "CLEANED_COLUMNS", "RAW_COLUMNS", "RAW_CSV_SCHEMA"]
