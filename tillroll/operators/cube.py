"""Dashboard cube (C4): sums and exact distinct counts that merge.

A dashboard asks for the same figures under ever other filters.  ``write_cube``
reduces the lines once to two narrow tables by *cell* (day, hour, country,
category, segment, identified or not):

* ``cells``: revenue units, lines and quantity;
* ``marks``: which invoices, customers and products occur in the cell, as bits.
  Keys get dense numbers (an invoice next to those of its day and country, a
  customer next to those of its segment and country), and 64 numbers are a word:
  a row is (cell, kind, word, mask).  Sparse cells have few rows, dense ones 64
  keys a row.

Cells merge by ``sum``, marks by ``bit_or`` per word and ``bit_count``, so a
panel with any filter and grouping over the cells' columns reads these tables
alone, in codegen, and its counts are exact.  Both are partitioned by Year and
Month, and the column ``InvoiceDate`` holds the day, so
``view.sales_predicate`` prunes their folders as it does those of the lines.

A key that a third of all lines hold is one bit in each of its cells: lines are
reduced to distinct (cell, key) map-side, and its number is joined from one
written table to another, which AQE splits where it is skewed.  On the way a cell
is two numbers (``_Codes``); its columns come back as the tables are written.

Disk: the lines' keys, numbers and figures are written once, by part of the
calendar.  Of many lines one kind of key moves at a time, and one part of the
calendar after another; the files of a move go as its table is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators import dimensions as dims, rfm, view
from tillroll.operators.ranking import global_row_number
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import PARTITION_ROWS, cut, cut_more, drop_cut, partitions_for

#: Columns of a cell, as far as the lines have them.
DIMENSIONS = ("InvoiceDate", "Year", "Month", *dims.PEAK_KEYS, "Country", "ProductCategory", "Customer_Segment")
IDENT = "Identified"
#: What is counted: kind, key and the columns of the lines that it is numbered by.
KINDS = (("invoice", "InvoiceNo", ("InvoiceDate", "Country")),
         ("customer", "CustomerID", ("Customer_Segment", "Country")),
         ("product", "StockCode", ("ProductCategory",)))
WORD_BITS = 64
FIGURES = (dims.REV_UNITS, "_n", "_ident_n", "Quantity", "invoices", "customers", "identified", "products")


@dataclass(frozen=True)
class SalesCube:
    """The two tables, or what a filter leaves of them."""

    cells: DataFrame
    marks: DataFrame

    def where(self, pred: Column) -> SalesCube:
        return SalesCube(self.cells.where(pred), self.marks.where(pred))

    def figures(self, *keys: str) -> DataFrame:
        """``FIGURES`` by ``keys``; one row, zeros if nothing is left, without
        keys.  Null keys are a group."""
        sums = self.cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in FIGURES[:4]])
        words = self.marks.groupBy(*keys, "kind", "word").agg(
            F.bit_or("mask").alias("_any"), F.bit_or(F.when(F.col(IDENT), F.col("mask"))).alias("_known"))

        def bits(kind: str, mask: str) -> Column:
            return F.sum(F.when(F.col("kind") == kind, F.bit_count(mask)))

        counts = words.groupBy(*keys).agg(
            bits("invoice", "_any").alias("invoices"), bits("customer", "_any").alias("customers"),
            bits("customer", "_known").alias("identified"), bits("product", "_any").alias("products"))
        both = sums.unionByName(counts, allowMissingColumns=True)
        return both.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FIGURES])


def _cell_lines(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Lines with the columns of their cell."""
    ident = F.col("CustomerID").isNotNull()
    if "HasCustomerID" in df.columns:
        ident = ident & F.coalesce(F.col("HasCustomerID"), F.lit(False))
    names = [c for c in DIMENSIONS if c in df.columns]
    lines = df.select(F.date_trunc("day", "InvoiceDate").cast("timestamp_ntz").alias("InvoiceDate"),
                      *[c for c in names if c != "InvoiceDate"], ident.alias(IDENT),
                      *[key for _, key, _ in KINDS], "Quantity", ident.cast("long").alias("_ident"), tf.money_units("TotalAmount").alias(dims.REV_UNITS))
    return lines, [*names, IDENT]


MONTH = ("Year", "Month")
CALENDAR = ("InvoiceDate", *MONTH, *dims.PEAK_KEYS)


@dataclass(frozen=True)
class _Codes:
    """Numbers for the two halves of a cell, so that rows on the way to the cube
    hold two longs in their place: ``calendar`` has at most 24 rows a day,
    ``profile`` one for each country, category and segment that occur together.
    Both are broadcast."""

    calendar: DataFrame
    profile: DataFrame
    lines: int

    @staticmethod
    def of(lines: DataFrame, cell: list[str]) -> _Codes:
        days, others = [c for c in cell if c in CALENDAR], [c for c in cell if c not in CALENDAR]
        number = F.monotonically_increasing_id()
        calendar = cut(lines.select(*days).distinct().withColumn("_calendar", number), "cube-_calendar")
        counted = cut(lines.groupBy(*others).agg(F.count(F.lit(1)).alias("_n")).withColumn("_profile", number), "cube-_profile")
        profile = counted.drop("_n")
        profile._cut_at = counted._cut_at  # for drop_cut
        return _Codes(calendar, profile, counted.agg(F.sum("_n")).first()[0] or 0)

    def put(self, lines: DataFrame) -> DataFrame:
        """Lines with the numbers in place of the cell's columns."""
        for table in (self.calendar, self.profile):
            names = table.columns[:-1]
            keys = table.withColumnsRenamed({c: f"_{c}_" for c in names})
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in names])
            lines = lines.join(F.broadcast(keys), same).drop(*names, *[f"_{c}_" for c in names])
        return lines

    def back(self, df: DataFrame) -> DataFrame:
        """The cell's columns in place of the numbers; rows stay in their order."""
        known = [c for c in self.calendar.columns if c in df.columns and c != "_calendar"]
        return (df.join(F.broadcast(self.calendar.drop(*known)), "_calendar").join(F.broadcast(self.profile), "_profile")
                .drop("_calendar", "_profile"))


def _pairs(lines: DataFrame) -> DataFrame:
    """Distinct (key, numbers of the cell) of every kind, in one table."""
    of_kind = [lines.where(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), key, "_calendar", "_profile").distinct()
               for kind, key, _ in KINDS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), of_kind)


TURNS = 4
TURN_LINES = 1 << 20  # fewer go at once
LEAST_FILES = 16


def _write_coded(lines: DataFrame, codes: _Codes, turns: int) -> DataFrame:
    """Lines with the numbers of their cell, written in folders by the part of the
    calendar, in order of time, that they are in (``_turn``, from 0)."""
    in_time = Window.orderBy(*MONTH, "InvoiceDate", "_calendar")  # at most 24 rows a day
    part = codes.calendar.select("_calendar", (F.ntile(turns).over(in_time) - 1).alias("_turn"))
    files = max(LEAST_FILES, -(-2 * codes.lines // PARTITION_ROWS))  # of few lines; many stay in the pieces they come in
    return cut(codes.put(lines).join(F.broadcast(part), "_calendar").coalesce(files), "cube-lines", ["_turn"])


@dataclass(frozen=True)
class _Places:
    """Where the cube's rows meet to be written: a month is a place, or several, of
    about ``PARTITION_ROWS`` lines each; a cell is in one."""

    calendar: DataFrame

    @staticmethod
    def of(cells: DataFrame, codes: _Codes) -> _Places:
        months = cells.groupBy("Year", "Month").agg(F.sum("_n").alias("_n")).orderBy("Year", "Month").collect()
        rows, first = [], 0
        for year, month, n in months:
            slices = -(-n // PARTITION_ROWS)
            rows.append((year, month, first, slices))
            first += slices
        types = dict(cells.dtypes)
        known = cells.sparkSession.createDataFrame(rows, f"_y {types['Year']}, _m {types['Month']}, _first long, _slices long")
        same = F.col("Year").eqNullSafe(F.col("_y")) & F.col("Month").eqNullSafe(F.col("_m"))
        return _Places(codes.calendar.join(F.broadcast(known), same).select("_calendar", "_first", "_slices"))

    def put(self, df: DataFrame) -> DataFrame:
        """Rows with their place."""
        place = F.col("_first") + F.pmod(F.hash("_calendar", "_profile"), F.col("_slices"))
        return df.join(F.broadcast(self.calendar), "_calendar").withColumn("_place", place).drop("_first", "_slices")


def _marks(lines: DataFrame, turns: int, cell: list[str], codes: _Codes, places: _Places, kind: str, key: str, near: Sequence[str],
           made: list[DataFrame]) -> Iterator[DataFrame]:
    """(numbers of the cell, kind, word, mask) of one kind of key, turn by turn, rows
    of a month side by side; what is written on the way is added to ``made``."""
    near = [c for c in near if c in cell]
    known = lines.where(F.col(key).isNotNull()).select(key, "_calendar", "_profile")
    # alike is enough, so texts go by their hash: their minimum would sort all rows
    keys = codes.back(known).groupBy(key).agg(*[F.min(c if c == "InvoiceDate" else F.xxhash64(c)).alias(c) for c in near])
    ranked = global_row_number(keys, [*near, key], num_partitions=max(1, -(-codes.lines // PARTITION_ROWS)))
    made.append(ranked)
    ids = ranked.select(key, (F.col("rn") - 1).alias("id"))
    pieces = max(LEAST_FILES, -(-2 * codes.lines // (turns * PARTITION_ROWS)))  # named, so that they aren't put together
    for turn in range(turns):
        pairs = _pairs(lines.where(F.col("_turn") == turn)).where(F.col("kind") == kind).select(key, "_calendar", "_profile")
        numbered = places.put(pairs.join(ids, key).drop(key)).repartition(pieces, "_place")
        words = numbered.withColumns({"word": F.expr(f"id div {WORD_BITS}"), "bit": F.expr(f"shiftleft(1L, cast(id % {WORD_BITS} as int))")})
        yield (words.groupBy("_place", "_calendar", "_profile", "word").agg(F.bit_or("bit").alias("mask"))
               .select("_calendar", "_profile", F.lit(kind).alias("kind"), "word", "mask"))


def write_cube(df: DataFrame) -> SalesCube:
    """Reduce lines (with segments, if they have them) to the cube's tables, in
    the shared folder.  ``df`` is read for the numbers of its cells and once more,
    when its keys and figures are written; the rest reads these."""
    lines, cell = _cell_lines(df)
    codes = _Codes.of(lines, cell)
    turns = max(1, min(TURNS, -(-codes.lines // TURN_LINES)))
    lines = _write_coded(lines, codes, turns)
    made, marks = [codes.calendar, codes.profile, lines], None
    with partitions_for(df.sparkSession, codes.lines):
        sums = lines.groupBy("_calendar", "_profile").agg(
            F.sum(dims.REV_UNITS).alias(dims.REV_UNITS), F.count(F.lit(1)).alias("_n"),
            F.sum("_ident").alias("_ident_n"), F.sum("Quantity").cast("long").alias("Quantity"))
        cells = cut(_by_month(sums, codes, cell, move=True), "cube-cells", MONTH)
        places = _Places.of(cells, codes)
        for kind in KINDS:
            passing = []
            for part in _marks(lines, turns, cell, codes, places, *kind, passing):
                part = _by_month(part, codes, cell)
                marks = cut(part, "cube-marks", MONTH) if marks is None else cut_more(marks, part, MONTH)
            for table in passing:
                drop_cut(table)
    for table in made:
        drop_cut(table)
    return SalesCube(cells, marks)


def _by_month(df: DataFrame, codes: _Codes, cell: list[str], move: bool = False) -> DataFrame:
    """``df`` in order of the months within partitions.  With ``move`` rows of a
    month meet first; a large one is dealt over several partitions.  Rows are moved
    and sorted while they are narrow and get the cell's columns last."""
    narrow = df.join(F.broadcast(codes.calendar.select("_calendar", *MONTH)), "_calendar")
    narrow = narrow.hint("rebalance", *MONTH) if move else narrow
    placed = codes.back(narrow.sortWithinPartitions(*MONTH))
    rest = [c for c in df.columns if c not in ("_calendar", "_profile")]
    return placed.select(*cell, *rest)


# ---------------------------------------------------------------- panels ---

def _kpi_row(cube: SalesCube, suffix: str = "") -> DataFrame:
    names = {dims.REV_UNITS: "_units", "invoices": "total_transactions", "identified": "total_customers",
             "products": "total_products", "_ident_n": "customer_transactions"}
    f = cube.figures().select(*[F.col(a).alias(b + suffix) for a, b in names.items()])
    return f.select(*view._kpi_cols(suffix))


def kpis(cube: SalesCube) -> DataFrame:
    """A30 + A40."""
    return _kpi_row(cube)


def kpi_deltas(cube: SalesCube, pred: Column) -> DataFrame:
    """The filtered figures next to the totals."""
    return view.deltas_of(attach_one_row(_kpi_row(cube), _kpi_row(cube.where(pred), "_f")))


def daily_revenue(cube: SalesCube) -> DataFrame:
    """A32."""
    return (cube.cells.groupBy(F.to_date("InvoiceDate").alias("Date")).agg(F.sum(dims.REV_UNITS).alias(dims.REV_UNITS))
            .select("Date", tf.units_to_money(dims.REV_UNITS).alias("Value")))


def _revenue(cube: SalesCube, key: str) -> DataFrame:
    return (cube.cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(dims.REV_UNITS).alias(dims.REV_UNITS)))


def top_countries(cube: SalesCube, n: int = 10) -> DataFrame:
    """A37."""
    return (_revenue(cube, "Country").orderBy(F.desc(dims.REV_UNITS), "Country").limit(n)
            .select("Country", tf.units_to_money(dims.REV_UNITS).alias("TotalAmount")))


def category_revenue(cube: SalesCube) -> DataFrame:
    """A38."""
    return (_revenue(cube, "ProductCategory").select("ProductCategory", tf.units_to_money(dims.REV_UNITS).alias("TotalAmount"))
            .orderBy("TotalAmount", "ProductCategory"))


def season_summary(cube: SalesCube) -> DataFrame:
    """A35."""
    return dims.season_summary_of(cube.figures("Season").withColumnRenamed("invoices", "Transaction_Count"))


def hourly_sales(cube: SalesCube) -> DataFrame:
    """A11."""
    return cube.where(F.col("Hour").isNotNull()).figures("Hour").select(
        "Hour", tf.units_to_money(dims.REV_UNITS).alias("TotalAmount"), F.col("invoices").alias("Transactions"))


def country_summary(cube: SalesCube) -> DataFrame:
    """A36."""
    return dims.country_summary_of(cube.where(F.col("Country").isNotNull()).figures("Country").withColumnsRenamed(
        {"invoices": "Transaction_Count", "identified": "Customer_Count"}))


def home_market_share(cube: SalesCube, home: str = tf.HOME_MARKET) -> DataFrame:
    """A15 + A39."""
    return dims.home_share_of(cube.where(F.col("Country").isNotNull()).figures("Country").withColumnsRenamed(
        {"invoices": "_inv", "customers": "_cust"}), home)


def segment_distribution(cube: SalesCube) -> DataFrame:
    """A34."""
    known = cube.where(F.col(IDENT) & F.col("Customer_Segment").isNotNull())
    return rfm.segment_shares(known.figures("Customer_Segment").select("Customer_Segment", F.col("identified").alias("Count")))


def temporal_peaks(cube: SalesCube) -> DataFrame:
    """A13."""
    return dims.peaks_of(cube.cells.groupBy(*dims.PEAK_KEYS).agg(F.sum(dims.REV_UNITS).alias(dims.REV_UNITS)))


def panels(cube: SalesCube, pred: Column) -> dict[str, DataFrame]:
    """Every panel that the cube answers, for one filter selection."""
    f = cube.where(pred)
    return {
        "filter_domains": view.filter_domains(cube.cells),
        "kpis": kpis(f),
        "kpi_deltas": kpi_deltas(cube, pred),
        "daily_revenue": daily_revenue(f),
        "top_countries": top_countries(f),
        "segment_distribution": segment_distribution(f),
        "category_revenue": category_revenue(f),
        "season_summary": season_summary(f),
        "hourly_sales": hourly_sales(f),
        "country_summary": country_summary(f),
        "home_market_share": home_market_share(f),
        "temporal_peaks": temporal_peaks(f),
        "kpi_summary_report": view.summary_of(kpis(f)),
    }
