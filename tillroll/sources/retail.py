"""Scans and sinks for invoice-line tables.

* ``retail_raw``   – raw invoice lines derived from the driver's TPC-H-like
  tables (lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part).  The derivation is
  deterministic and plants the dirt a real retail export has: cancelled
  invoices, missing descriptions, non-positive amounts, outliers, guests,
  untrimmed country names and exact duplicate lines.
* ``scan_raw_csv`` – the real export: header CSV in ISO-8859-1.
* ``scan_cleaned`` / ``write_cleaned`` – the cleaned table at rest (Parquet,
  partitioned by Year/Month so date filters prune files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.schemas import RAW_CSV_SCHEMA

TPCH_TABLES = ("lineitem", "orders", "customer", "nation", "part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_raw(spark: SparkSession, sf_dir: str, with_items: bool = True) -> DataFrame:
    """Raw invoice lines (8 columns, plus Brand and PType item columns).

    Fixed derivation rules (must stay equal to the SQL oracle's adapter):
    cancelled when o_orderkey % 50 = 0 (InvoiceNo gets a 'C' prefix and the
    quantity is negated); quantity -1 when o_orderkey % 613 = 1; quantity x100
    when o_orderkey % 211 = 0; Description null when p_partkey % 400 = 3,
    otherwise ' ' + p_name + suffix(p_partkey % 8) + ' '; price 0 when
    (l_orderkey + l_linenumber) % 307 = 0, x10 when p_partkey % 40 = 7;
    guest (null CustomerID) when o_custkey % 4 = 0; nation 0 is
    ' united kingdom '; hour = o_orderkey % 24, minute = o_orderkey*7 % 60;
    lines of orders with o_orderkey % 500 = 1 appear twice.  Bought together:
    the first three lines of orders with o_orderkey % 12 = 5 are ' tea set ',
    ' tea tin ' and ' tea towel ' (where there is a description).  Nulls:
    InvoiceNo when o_orderkey % 701 = 3, StockCode when
    (l_orderkey + l_linenumber) % 401 = 7, Country when o_orderkey % 97 = 5.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is the fixed 25-row TPC-H dimension: broadcasting it is size-safe.
    na = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    pa = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")

    # Customers come to orders, of which there are fewer, before lines move.  Lines
    # move with numbers alone: the nation's name and the order's key come back last.
    od = od.join(cu, od.o_custkey == cu.c_custkey).select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey")
    j = (li.join(od, li.l_orderkey == od.o_orderkey).drop("o_orderkey").join(pa, li.l_partkey == pa.p_partkey)
         .join(na, F.col("c_nationkey") == na.n_nationkey))

    okey = F.col("l_orderkey")
    pkey = F.col("p_partkey")
    cancelled = okey % 50 == 0
    # Description suffix by p_partkey % 8.
    suffix = (F.when(pkey % 8 == 0, " bag").when(pkey % 8 == 1, " candle")
               .when(pkey % 8 == 2, " christmas light").when(pkey % 8 == 3, " xmas")
               .when(pkey % 8 == 4, " vintage").when(pkey % 8 == 5, ", no.5!")
               .when(pkey % 8 == 6, "  garden").otherwise(""))
    hours = (okey % 24).cast("int")
    minutes = ((okey * 7) % 60).cast("int")

    together = okey % 12 == 5
    tea = (F.when(F.col("l_linenumber") == 1, " tea set ").when(F.col("l_linenumber") == 2, " tea tin ")
            .when(F.col("l_linenumber") == 3, " tea towel "))
    null = F.lit(None).cast("string")

    cols = [
        F.when(okey % 701 == 3, null).when(cancelled, F.concat(F.lit("C"), okey.cast("string")))
         .otherwise(okey.cast("string")).alias("InvoiceNo"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 401 == 7, null)
         .otherwise(F.concat(F.lit("P"), pkey.cast("string"))).alias("StockCode"),
        F.when(pkey % 400 == 3, null).when(together & tea.isNotNull(), tea)
         .otherwise(F.concat(F.lit(" "), F.col("p_name"), suffix, F.lit(" "))).alias("Description"),
        F.when(cancelled, -F.col("l_quantity")).when(okey % 613 == 1, F.lit(-1.0))
         .when(okey % 211 == 0, F.col("l_quantity") * 100)
         .otherwise(F.col("l_quantity")).cast("bigint").alias("Quantity"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0)))
         .alias("InvoiceDate"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 307 == 0, F.lit(0.0))
         .when(pkey % 40 == 7, F.col("p_retailprice") * 10)
         .otherwise(F.col("p_retailprice")).alias("UnitPrice"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_custkey").cast("double")).alias("CustomerID"),
        F.when(okey % 97 == 5, null).when(F.col("n_nationkey") == 0, F.lit(" united kingdom "))
         .otherwise(F.col("n_name")).alias("Country"),
    ]
    if with_items:
        cols += [F.col("p_brand").alias("Brand"), F.col("p_type").alias("PType")]
    # Exact duplicate lines without a second pass over the join: repeat the
    # row via a generator instead of a UNION ALL of the same plan.
    copies = F.when(okey % 500 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (j.select(*cols, copies.alias("_copy"))
             .withColumn("_copy", F.explode("_copy"))
             .drop("_copy"))


def scan_raw_csv(spark: SparkSession, path: str, ts_format: str = "M/d/yyyy H:mm") -> DataFrame:
    """Raw export CSV: header, ISO-8859-1, doubled quotes, explicit schema.

    InvoiceDate is parsed with ``ts_format``; an unparsable value is an error
    under ANSI mode, as in the reference.
    """
    df = (spark.read.schema(RAW_CSV_SCHEMA)
          .option("header", True).option("encoding", "ISO-8859-1")
          .option("quote", '"').option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("mode", "FAILFAST")
          .csv(path))
    return df.withColumn("InvoiceDate", F.to_timestamp_ntz("InvoiceDate", F.lit(ts_format)))


def write_raw_csv(df: DataFrame, path: str, ts_format: str = "M/d/yyyy H:mm") -> None:
    """Write raw lines in the export's CSV layout (used for round-trip tests)."""
    (df.select("InvoiceNo", "StockCode", "Description", "Quantity",
               F.date_format("InvoiceDate", ts_format).alias("InvoiceDate"),
               "UnitPrice", "CustomerID", "Country")
       .write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1")
       .option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_cleaned(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("Year", "Month"),
                  files: int = 8) -> None:
    """Cleaned-table sink: Parquet, overwrite, partitioned for date pruning.
    Lines meet by partition and salt first, so a month has at most ``files``
    files (a large month is still written by as many tasks)."""
    if partition_by:
        salt = F.pmod(F.xxhash64("InvoiceNo", "StockCode"), F.lit(files))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def scan_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned-table scan.  A missing path raises PATH_NOT_FOUND at once."""
    from tillroll.sources.schemas import CLEANED_COLUMNS
    df = spark.read.parquet(path)
    extra = [c for c in df.columns if c not in CLEANED_COLUMNS]
    return df.select(*CLEANED_COLUMNS, *extra)
