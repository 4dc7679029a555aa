"""The stages in order, each against what it should keep."""

import random

import corpus_pipeline
from tests.llm.helpers import CLASHES, docs, words
from tests.llm.test_text_dedup import brute_components, brute_near_lines, brute_repeats
from tillroll.llm import line_dedup, substring_dedup, units

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst"}


def corpus() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for i in range(240):
        lang = rng.choice(list(LETTERS))
        rows.append((i, "\n".join(". ".join(words(rng, rng.randint(8, 15), LETTERS[lang]) for _ in range(rng.randint(1, 3)))
                               for _ in range(rng.randint(1, 4))), lang))
    for i in range(240, 270):  # copies and near copies
        _, text, lang = rows[rng.randrange(240)]
        if i % 2:
            w = text.split(" ")
            w[rng.randrange(len(w))] = "zz" + lang
            text = " ".join(w)
        rows.append((i, text, lang))
    rows += [(300, "1234 5678", "aa"), (301, None, "aa"), (302, "", "bb")]
    return rows


def without_units(rows, gone):
    out = []
    for key, text, lang in rows:
        spans = [(g[2], g[3]) for g in gone if g[0] == key]
        left = units.cut(text, spans) if spans else text
        if not spans or left.strip():
            out.append((key, left, lang))
    return out


def without(rows, gone):
    out = []
    for key, text, lang in rows:
        lost = {g[1] for g in gone if g[0] == key}
        left = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in lost)
        if not lost or left.strip():
            out.append((key, left if lost else text, lang))
    return out


def test_stages(spark):
    rows = corpus()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    df = docs(spark, rows, CLASHES)
    columns = df.columns

    def step(name, df):
        out = stages[name](spark, df, "")
        assert out.columns == columns
        return sorted((r.doc_id, r.text, r.lang) for r in out.collect()), out

    want = [r for r in rows if r[0] < 300]
    got, df = step("language_id", df)
    assert got == sorted(want)
    want = without(want, brute_near_lines([r[:2] for r in want], line_dedup.MIN_CHARS))
    got, df = step("line_dedup", df)
    assert got == sorted(want)
    least = {int(k): int(c) for k, _, c in brute_components([r[:2] for r in want])}
    want = [r for r in want if least[r[0]] == r[0]]
    got, df = step("ngram_jaccard_join", df)
    assert got == sorted(want)
    want = without_units(want, brute_repeats([r[:2] for r in want], substring_dedup.MIN_WORDS))
    got, df = step("substring_dedup", df)
    assert got == sorted(want)
    packed = stages["best_fit_packing"](spark, df, "").collect()
    assert {r.doc_id for r in packed} == {r[0] for r in want}


def test_run_over_the_smallest_table(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id").collect()}
    assert ids and ids <= every


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """What a stage wrote goes when the next one starts, as its result is written."""
    import os

    base, df = spark.conf.get("spark.checkpoint.dir"), docs(spark, corpus())
    before = set(os.listdir(base))
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, df, "").write.parquet(str(tmp_path / str(i)))
        df = spark.read.parquet(str(tmp_path / str(i)))
    left = {x.split("-")[0] for x in set(os.listdir(base)) - before}
    assert left <= {"pieces", "packed", "repacked"}
