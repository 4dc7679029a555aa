"""Explicit schemas of the raw and cleaned invoice-line tables."""

from pyspark.sql import types as T

# Raw invoice lines as they arrive in the retail export (8 columns).
RAW_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
               "UnitPrice", "CustomerID", "Country"]

# CSV form: the timestamp is text ("M/d/yyyy H:mm") and CustomerID is a float.
RAW_CSV_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

# Cleaned table: the 8 raw columns (typed) + 16 derived ones, in this order.
CLEANED_COLUMNS = RAW_COLUMNS + [
    "Year", "Month", "Day", "Hour", "DayOfWeek", "DayName", "MonthName",
    "ProductCategory", "TotalAmount", "HasCustomerID", "TransactionValue",
    "ItemsPerTransaction", "UniqueProductsPerTransaction", "IsWeekend",
    "Season", "BusinessPeriod",
]

# Columns added by the dashboard's segmentation join.
SEGMENT_COLUMNS = ["RFM_Segment", "Customer_Segment"]
