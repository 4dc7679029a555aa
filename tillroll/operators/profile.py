"""Data profiling and the cleaning quality report.

Every profile is a single aggregate pass producing a small table; nothing is
counted with a separate action per column or per cleaning step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators.cleaning import iqr_fences, step_flags
from tillroll.operators.radix import quantiles
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import cut


def _unpivot(one_row: DataFrame, names: Sequence[str], value_cols: dict[str, str]) -> DataFrame:
    """One wide row -> one row per column name (stack, no shuffle)."""
    parts = []
    for name in names:
        parts.append(F.struct(F.lit(name).alias("column_name"),
                              *[F.col(tmpl.format(name)).alias(out) for out, tmpl in value_cols.items()]))
    return one_row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def profile_nulls(df: DataFrame) -> DataFrame:
    """D3: per column null count and % of rows (long form)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in cols])
    long = _unpivot(wide, cols, {"null_count": "_null_{}"})
    rows = wide.select("_rows")
    return (attach_one_row(long, rows)
                .select("column_name", "null_count",
                        (F.col("null_count") * 100 / F.col("_rows")).alias("null_pct")))


def profile_types(df: DataFrame) -> list[tuple[str, str]]:
    """(column, data type) pairs — schema metadata, no job runs."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def profile_distinct(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Per column count of distinct non-null values.

    Exact by default: one distinct count per column, each scanning that column
    alone (a columnar file is read once in all, and no row is repeated for
    every column).  ``approx_rsd`` switches to HyperLogLog++ sketches with that
    relative standard deviation: fixed memory per column and no expansion,
    for raw tables too large for an exact profile."""
    cols = df.columns
    if approx_rsd is not None:
        wide = df.agg(*[F.approx_count_distinct(F.col(c), approx_rsd).alias(f"_d_{c}") for c in cols])
        return _unpivot(wide, cols, {"distinct_count": "_d_{}"})
    wide = None
    for c in cols:
        one = df.select(c).agg(F.count_distinct(F.col(c)).alias(f"_d_{c}"))
        wide = one if wide is None else attach_one_row(wide, one)
    return _unpivot(wide, cols, {"distinct_count": "_d_{}"})


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (exact, interpolated),
    max per numeric column.  Moments come from one aggregate pass; the
    quartiles of all columns from the same radix-selection scans."""
    if cols is None:
        cols = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint")]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"_n_{c}"), F.avg(x).alias(f"_mean_{c}"),
                 F.stddev_samp(x).alias(f"_std_{c}"), F.min(x).alias(f"_min_{c}"),
                 F.max(x).alias(f"_max_{c}")]
    found = quantiles(df, dict.fromkeys(cols, [0.25, 0.5, 0.75]))
    wide = df.agg(*aggs).withColumns({f"_q_{c}": F.array(*[F.lit(v).cast("double") for v in q]) for c, q in found.items()})
    long = _unpivot(wide, cols, {"count": "_n_{}", "mean": "_mean_{}", "std": "_std_{}",
                                 "min": "_min_{}", "q": "_q_{}", "max": "_max_{}"})
    return long.select("column_name", F.col("count").cast("bigint").alias("count"),
                       tf.round_sig("mean", 12).alias("mean"), tf.round_sig("std", 12).alias("std"),
                       "min", tf.round_sig(F.col("q")[0], 12).alias("q25"),
                       tf.round_sig(F.col("q")[1], 12).alias("q50"),
                       tf.round_sig(F.col("q")[2], 12).alias("q75"), "max")


def _fingerprint(cols: Sequence[str]) -> list[Column]:
    """128 bits of a row, null like any other value: two hashes of its columns
    and of which of them are null (a null leaves a hash as it is)."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in order]) for seed, order in ((1, cols), (2, cols[::-1]))]


def duplicate_count(df: DataFrame, broadcast_rows: int = 4_000_000) -> DataFrame:
    """Rows identical to an earlier row (null equals null).

    Rows are counted by a 128-bit fingerprint first, so 16 bytes a row are
    shuffled, not its columns.  Only rows whose fingerprint occurs again are
    then compared as wholes, which keeps the count exact if two rows share a
    fingerprint.  The repeated fingerprints are broadcast to the rows up to
    ``broadcast_rows`` of them (16 bytes each); beyond that they are joined."""
    marks = [c.alias(n) for c, n in zip(_fingerprint(df.columns), ("_fa", "_fb"), strict=True)]
    again = cut(df.select(*marks).groupBy("_fa", "_fb").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "repeated-rows")
    n = again.count()
    one = F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates")
    if not n:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicates"))
    found = df.select("*", *marks).join(F.broadcast(again) if n <= broadcast_rows else again, ["_fa", "_fb"], "left_semi").drop("_fa", "_fb")
    return found.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).agg(one)


def profile_shape(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """D1 + D10: rows and columns before and after cleaning, rows removed,
    retention %."""
    a = raw.agg(F.count(F.lit(1)).alias("initial_rows"))
    b = cleaned.agg(F.count(F.lit(1)).alias("final_rows"))
    return attach_one_row(a, b).select(
        "initial_rows", F.lit(len(raw.columns)).alias("initial_columns"),
        "final_rows", F.lit(len(cleaned.columns)).alias("final_columns"),
        (F.col("initial_rows") - F.col("final_rows")).alias("rows_removed"),
        (F.col("final_rows") * 100 / F.col("initial_rows")).alias("retention_pct"))


def profile_date_range(df: DataFrame, col: str = "InvoiceDate") -> DataFrame:
    """D2 (on parsed timestamps)."""
    return df.agg(F.min(col).alias("date_min"), F.max(col).alias("date_max"))


def cleaning_step_counts(raw: DataFrame) -> DataFrame:
    """Counters of every cleaning step from one pass over the raw rows,
    after two narrow ones for the outlier fences (one-row relations).

    cancelled (and % of raw), missing descriptions, quantity <= 0, price <= 0
    (after the quantity filter), outliers removed, missing customer ids and
    customers left (after cleaning)."""
    flags = step_flags(raw)
    survive = ~(flags["cancelled"] | flags["no_desc"] | flags["bad_qty"] | flags["bad_price"])
    base = raw.withColumn("_ok", survive)
    # The fences are scalars found by selection; applied as literals, they leave
    # one plain aggregate over the raw rows.
    inside = lambda c, fence: F.lit(False) if fence[0] is None else F.col(c).between(*fence)
    in_q = inside("Quantity", iqr_fences(base.where("_ok"), "Quantity"))
    in_p = inside("UnitPrice", iqr_fences(base.where(F.col("_ok") & in_q), "UnitPrice"))
    kept = F.col("_ok") & in_q & in_p
    out = (base
               .agg(F.count(F.lit(1)).alias("raw_rows"),
                    F.count_if(flags["cancelled"]).alias("cancelled"),
                    F.count_if(flags["no_desc"]).alias("missing_description"),
                    F.count_if(flags["bad_qty"]).alias("nonpositive_quantity"),
                    F.count_if(flags["bad_price"]).alias("nonpositive_price"),
                    F.count_if(F.col("_ok") & ~(in_q & in_p)).alias("outliers_removed"),
                    F.count_if(kept & F.col("CustomerID").isNull()).alias("missing_customer_id"),
                    F.count_distinct(F.when(kept, F.col("CustomerID"))).alias("customers_left"),
                    F.count_if(kept).alias("final_rows")))
    return out.withColumn("cancelled_pct", F.col("cancelled") * 100 / F.col("raw_rows"))


def quality_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One-row cleaning report (shape, retention, missing
    cells, duplicates, unique customers/products/countries, date range)."""
    cols = cleaned.columns
    c = cleaned.agg(
        F.count(F.lit(1)).alias("final_rows"),
        sum((F.count_if(F.col(x).isNull()) for x in cols), F.lit(0)).cast("bigint").alias("missing_values"),
        F.count_distinct("CustomerID").alias("unique_customers"),
        F.count_distinct("StockCode").alias("unique_products"),
        F.count_distinct("Country").alias("countries"),
        F.min("InvoiceDate").alias("date_min"), F.max("InvoiceDate").alias("date_max"))
    r = raw.agg(F.count(F.lit(1)).alias("initial_rows"))
    d = duplicate_count(cleaned)
    return attach_one_row(attach_one_row(r, c), d).select(
        "initial_rows", F.lit(len(raw.columns)).alias("initial_columns"),
        "final_rows", F.lit(len(cols)).alias("final_columns"),
        (F.col("initial_rows") - F.col("final_rows")).alias("rows_removed"),
        (F.col("final_rows") * 100 / F.col("initial_rows")).alias("retention_pct"),
        "missing_values", "duplicates", "unique_customers", "unique_products", "countries",
        "date_min", "date_max")


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The quality report plus the raw profile the original stores with
    it: ``missing_data`` (column -> null count) and ``data_types`` (column ->
    type), as map columns of the one report row."""
    nulls = profile_nulls(raw).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "null_count"))).alias("missing_data"))
    types = F.create_map(*[x for name, t in profile_types(raw) for x in (F.lit(name), F.lit(t))])
    return attach_one_row(quality_report(raw, cleaned), nulls).withColumn("data_types", types)


def write_report_json(report: DataFrame, path: str) -> None:
    """S5 sink: the one-row report as JSON (one small file)."""
    report.coalesce(1).write.mode("overwrite").json(path)
