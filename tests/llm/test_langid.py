"""Language identification: held-out accuracy and the parts of the learner."""

import random
import zlib

import numpy as np

from tests.llm.helpers import CLASHES, awkward, docs, words
from tillroll.llm import langid

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éèêçàuie"}


def labelled(seed: int, n: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, words(rng, rng.randint(3, 60), LETTERS[lang]), lang) for i in range(n) for lang in [rng.choice(list(LETTERS))]]


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = labelled(1) + [(10_000 + (r[0] or 0), r[1], None) for r in awkward(random.Random(2))]
    got = langid.identify(docs(spark, rows, {k: v for k, v in CLASHES.items() if k != "p"})).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    hits = 0
    for r in got:
        key, text, lang = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in LETTERS
        hits += r.held_out and r.lang_pred == lang
    assert hits >= 0.98 * sum(r.held_out and truth[r.doc_id][2] is not None for r in got)


def test_held_out_labels_are_never_learned(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "wrong") for i, t, lang in labelled(3, 200)]
    got = langid.identify(docs(spark, rows))
    assert got.where("lang_pred = 'wrong'").count() == 0


def test_nothing_to_learn(spark):
    got = langid.identify(docs(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(docs(spark, [])).count() == 0


def test_kept_documents(spark):
    rows = labelled(4, 300) + [(5000, "12345 !!", "aa"), (5001, None, "aa"), (5002, "", "aa")]
    df = docs(spark, rows, CLASHES)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] < 5000}


def test_the_sample_is_bounded_and_by_label(spark):
    rows = labelled(5, 400)
    model = langid.fit(docs(spark, rows), sample_per_label=20)
    assert model.labels == sorted(LETTERS)
    right = sum(model.predict(t)[0] == lang for _, t, lang in rows)
    assert right >= 0.95 * len(rows)


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id in most rows, with many texts, and one row many times over."""
    rows = [(0 if i % 3 else i, t, lang) for i, t, lang in labelled(6, 300)] + [(1, "abc abd", "aa")] * 500
    seen = []
    learn = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda xs, *a, **k: seen.append(len(xs)) or learn(xs, *a, **k))
    model = langid.fit(docs(spark, rows), sample_per_label=20)
    assert model.labels == sorted(LETTERS) and 0 < seen[0] <= 3 * 20
    assert sum(model.predict(t)[0] == lang for _, t, lang in rows) >= 0.95 * len(rows)


def test_features_ignore_what_is_not_a_letter():
    assert (langid.grams("Ab, cd") == langid.grams("ab  12 cd")).all()
    assert langid.grams("12") is None and langid.grams("") is None and langid.grams(None) is None
    assert langid.grams("a").sum() == 2  # the letter, and with the blank before it


def test_elastic_net_gives_zeros_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    xs = [(np.array([k, 10 + int(rng.integers(0, 50))]), np.array([1.0, 0.1])) for k in rng.integers(0, 2, 300)]
    ys = [int(x[0][0]) for x in xs]
    sparse, dense = langid.ftrl(xs, ys, 2, l1=1.0), langid.ftrl(xs, ys, 2, l1=0.0)
    assert (sparse[:, 10:60] == 0).sum() > (dense[:, 10:60] == 0).sum()
    assert all(langid._softmax(sparse[:, x[0]] @ x[1] + sparse[:, -1]).argmax() == y for x, y in zip(xs, ys, strict=True))
    logits = rng.standard_normal((4000, 3))
    p = langid._softmax(logits)
    drawn = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(logits * 4, drawn) - 4) < 0.6
