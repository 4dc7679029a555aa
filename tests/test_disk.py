"""What a job leaves on disk while it goes on is bounded: files of finished moves go,
many lines move in parts, tables that only one step reads are deleted."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_cube import files_under, lines, same
from tests.test_single_move import raw_lines
from tillroll.operators import cleaning, cube as cb, view
from tillroll.plans import catalog, layout, materialize


def shuffled(spark) -> set[str]:
    """Files of moves that are on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (str(blocks.apply(i)) for i in range(blocks.size())) if b.startswith("shuffle_")}


def left_by(spark, write) -> set[str]:
    before = shuffled(spark)
    write()
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("write", [
    lambda spark, df: materialize.cut(df, "moved"),
    lambda spark, df: materialize.cut_more(materialize.cut(df, "moved"), df),
    lambda spark, df: materialize.written_table(spark, f"moved-{time.time()}", lambda: df),
    lambda spark, df: layout.write_keyed(df, "id", "moved")])
def test_files_of_a_move_go_as_its_table_is_written(spark, write):
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("id")).count()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name)
    assert len(left_by(spark, lambda: write(spark, df))) <= 2  # a single number of lines that was asked for
    assert spark.conf.get(name) == set_before


@pytest.mark.parametrize("together", [None, "g"])
def test_lines_moved_in_rounds_are_all_there_once(spark, monkeypatch, together):
    monkeypatch.setattr(layout, "ROUND_LINES", 500)
    keys = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 200).otherwise(F.lit(None))
    df = spark.range(3000).select(keys.cast("long").alias("k"), (F.col("id") % 50).alias("g"), "id", (F.col("id") / 7).alias("x"))
    df = df.withColumn("g", F.when(F.col("g") > 5, F.col("g")))
    copies = df.union(df.where("id < 100"))
    rounds = []
    t = layout.write_keyed(copies, "k", "rounds", fraction=0.01, together=None if together is None else F.col(together), rounds=4,
                           finish=lambda d: rounds.append(d) or d)
    assert len(rounds) == 4
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, t.lines.collect())) == sorted(map(key, copies.collect()))
    parts = [set(map(key, r.select("k", "g", "id", "x").collect())) for r in rounds]
    assert max(map(len, parts)) < 0.6 * 3000 and sum(map(len, parts)) == len(set().union(*parts)) == 3000
    by = t.table.where("g is not null and k is not null").groupBy("k", "g").agg(F.count_distinct("_salt").alias("n"))
    if together:  # lines that belong together lie together, and came in one round
        assert by.where("n > 1").isEmpty()
        assert all(len({i for i, p in enumerate(parts) for r in p if r[:2] == kg}) == 1 for kg in {r[:2] for p in parts for r in p} if "None" not in kg)
    twice = t.attach(t.aggregate([F.count("id").alias("n")])).where("k is not null")
    assert twice.agg(F.count("n")).first()[0] == copies.where("k is not null").count()


def test_cleaned_lines_are_the_same_in_rounds(spark, monkeypatch):
    raw = materialize.cut(raw_lines(spark), "raw")
    monkeypatch.setattr(layout, "ROUND_LINES", 100)
    monkeypatch.setattr(cleaning, "TOGETHER_LINES", 5)
    want = sorted(map(str, cleaning.clean_sales(raw).collect()))
    assert sorted(map(str, cleaning.write_clean_sales(raw, "CustomerID", "in-rounds", rounds=4).lines.collect())) == want


def test_cube_made_in_turns(spark, monkeypatch):
    df = lines(spark, 1500)
    df = materialize.cut(df.union(df.where("StockCode = 'p1'")), "lines")
    monkeypatch.setattr(cb, "TURN_LINES", 100)
    monkeypatch.setattr(cb, "PARTITION_ROWS", 100)  # months of several places
    added, cut_more = [], cb.cut_more
    monkeypatch.setattr(cb, "cut_more", lambda table, part, by=(): added.append(part) or cut_more(table, part, by))
    cube = cb.write_cube(df)
    assert len(added) == cb.TURNS * len(cb.KINDS) - 1
    rows = cube.marks.count()
    assert cube.marks.select(*[c for c in cube.marks.columns if c != "mask"]).distinct().count() == rows  # a cell is made in one turn
    pred = view.sales_predicate("2010-12-05", "2011-01-20", columns=df.columns)
    same(cb.kpis(cube), view.kpis(df))
    same(cb.kpi_deltas(cube, pred), view.kpi_deltas(df, pred))
    same(view.filter_domains(cube.cells), view.filter_domains(df))
    words = {r.kind: r.n for r in cube.marks.groupBy("kind").agg(F.count_distinct("word").alias("n")).collect()}
    keys = df.agg(*[F.count_distinct(k).alias(kind) for kind, k, _ in cb.KINDS]).first().asDict()
    assert words == {k: -(-n // cb.WORD_BITS) for k, n in keys.items()}


@pytest.fixture
def tables(tmp_path):
    os.symlink(SF_SMALL, tmp_path / "sf")  # a path that nothing was written for
    return str(tmp_path / "sf")


def raw_of(spark, sf):
    return materialize.is_written(spark, f"raw:{sf}", catalog._inputs(sf))


def test_the_cube_leaves_no_lines_but_the_cleaned(spark, tables):
    catalog.q_cube_filter_domains(spark, tables).collect()
    assert not raw_of(spark, tables) and not materialize.is_written(spark, f"segmented:{tables}", catalog._inputs(tables))
    again = catalog.raw8(spark, tables)  # whoever asks has them
    assert again.count() == catalog.raw8(spark, SF_SMALL).count()


def test_raw_lines_that_were_asked_for_stay(spark, tables):
    raw = catalog.raw_lines(spark, tables)
    n = catalog.cleaned(spark, tables).count()
    assert raw_of(spark, tables) and raw.count() > n
    at = os.path.dirname(raw.inputFiles()[0].split(":", 1)[1].replace("//", "/"))
    materialize.drop_written(spark, f"raw:{tables}", catalog._inputs(tables))
    assert not raw_of(spark, tables) and not files_under(at)
