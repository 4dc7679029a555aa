"""Line, substring and shingle dedup against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import CLASHES, awkward, docs, words
from tillroll.llm import line_dedup, ngram_join, substring_dedup, units


def corpus(seed: int) -> list[tuple]:
    """Lines and passages that repeat, exactly and with small changes."""
    rng = random.Random(seed)
    pool = [words(rng, rng.randint(1, 14)) for _ in range(30)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool) if rng.random() < 0.6 else words(rng, rng.randint(1, 12))
            if rng.random() < 0.5 and line:
                k, c = rng.randrange(len(line)), rng.choice("abc")
                line = rng.choice([line[:k] + line[k + 1:], line[:k] + c + line[k:], line[:k] + c + line[k + 1:], line.upper(), "  " + line.replace(" ", "  ")])
            ls.append(line)
        rows.append((i, "\n".join(ls)))
    return rows


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_lines(rows):
    for key, text in rows:
        for i, (start, end, line) in enumerate(units.lines(text or "")):
            yield (key, i, start, end), units.normal(line)


def rank(place):
    return (place[0] is not None, place[0] or 0, place[1])


def brute_near_lines(rows, min_chars):
    found = sorted(((p, x) for p, x in all_lines(rows) if len(x) >= min_chars and p[3] - p[2] >= min_chars), key=lambda v: rank(v[0]))
    out = set()
    for k, (place, x) in enumerate(found):
        first = next((q for q, y in found[:k] if rank(q) < rank(place) and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1), None)
        if first:
            out.add((*place, first[0], first[1], first[2]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_lines_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = line_dedup.removed_lines(docs(spark, rows, CLASHES), min_chars=8).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_near_lines(rows, 8)


def test_segment_keys_and_deletions_lose_no_pair():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(2, 14)))
        k = rng.randrange(len(a))
        b = rng.choice([a[:k] + a[k + 1:], a[:k] + "x" + a[k:], a[:k] + "y" + a[k + 1:], a + "z"])
        ka, kb = line_dedup.segment_keys(a), line_dedup.segment_keys(b)
        common = set(ka) & set(kb)
        if a == b:
            continue
        assert common, (a, b)
        va = line_dedup.deletions(a, [i for i, x in enumerate(ka) if x in common])
        vb = line_dedup.deletions(b, [i for i, x in enumerate(kb) if x in common])
        assert set(va.tolist()) & set(vb.tolist()), (a, b)


def test_line_dedup_of_awkward_rows(spark):
    rows = awkward(random.Random(5)) + [(20, "the same long line is here twice for sure\nanother"), (21, "The same  long line is here twice for sure!"),
                                        (22, "the same long line is here twice for sure")]
    df = docs(spark, rows, CLASHES)
    gone = {(r.doc_id, r.line, r.kept_doc_id) for r in line_dedup.removed_lines(df).collect()}
    assert gone == {(21, 0, 20), (22, 0, 20)}  # equal ids count as one document
    left = line_dedup.deduplicated(df)
    assert left.columns == df.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[20] == rows[-3][1] and 21 not in texts and 22 not in texts and texts[1] is None and texts[2] == ""
    assert left.count() == len(rows) - 2
    assert line_dedup.removed_lines(docs(spark, [])).count() == 0
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


@pytest.mark.parametrize("op", [line_dedup, substring_dedup])
def test_rows_without_an_id_or_with_the_same_one(spark, op):
    """Each row's own decisions take effect, whatever other rows its id has."""
    line = "this one line of ten words stands in all of them"
    own = [" ".join(words(random.Random(k), 9).split()) for k in range(90)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, f"start {k}\n{line}\n{own[k]}") for k in range(90)]
    df = docs(spark, rows, CLASHES)
    left = op.deduplicated(df).collect()
    assert sorted(x for r in left for x in r.text.split("\n") if x != line) == sorted(x for _, t in rows for x in t.split("\n") if x != line)
    assert [r.doc_id for r in left if line in r.text] == [None]
    copies = [(k, line + "\nend") for k in (None, None, 7, 7)]  # equal rows count as one document
    assert sorted((str(r.doc_id), r.text) for r in op.deduplicated(docs(spark, copies)).collect()) == [
        ("7", "end"), ("7", "end"), ("None", line + "\nend"), ("None", line + "\nend")]


def test_exact_copies_of_short_lines(spark):
    rows = [(1, "All rights reserved.\nfirst"), (2, "all  rights reserved.\n\n\nsecond"), (3, "all rights reserved!\nx"), (4, "x"),
            (5, "one line that is long enough to have near lines\nfirst"), (6, "one line that is long enough to have near linez\nlast")]
    df = docs(spark, rows, CLASHES)
    got = {(r.doc_id, r.line, r.kept_doc_id, r.kept_line) for r in line_dedup.removed_lines(df, exact_chars=1).collect()}
    assert got == {(2, 0, 1, 0), (4, 0, 3, 1), (5, 1, 1, 1), (6, 0, 5, 0)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert left == {1: rows[0][1], 2: "\n\nsecond", 3: rows[2][1], 5: "one line that is long enough to have near lines", 6: "last"}


def all_units(rows, min_words):
    """(place, whole, normal form) of lines and of their sentences."""
    for (key, i, start, end), x in all_lines(rows):
        if len(x.split()) < min_words:
            continue
        yield (key, i, start, end), True, x
        line = next(t for k, t in rows if k == key)[start:end]
        parts = re.findall(r"[^.!?]*[.!?]+[ \t]*|[^.!?]+", line)
        assert "".join(parts) == line
        at = start
        for part in parts if len(parts) > 1 else ():
            if len(part.split()) >= min_words:
                yield (key, i, at, at + len(part)), False, units.normal(part)
            at += len(part)


def brute_repeats(rows, min_words):
    first, gone = {}, []
    for place, whole, x in sorted(all_units(rows, min_words), key=lambda v: (v[0][0] is not None, v[0][0] or 0, v[0][2], v[0][3])):
        if x in first:
            gone.append((place, whole, first[x]))
        first.setdefault(x, place)
    lost = {p[:2] for p, whole, _ in gone if whole}
    return {(*p, f[0], f[2], f[3]) for p, whole, f in gone if whole or p[:2] not in lost}


def with_sentences(seed: int) -> list[tuple]:
    """Lines of several sentences, some of which repeat elsewhere."""
    rng = random.Random(seed)
    pool = [words(rng, rng.randint(2, 9)) + rng.choice([".", "!", "?", "..."]) for _ in range(15)]
    return [(i, "\n".join(rng.choice([" ", "  ", "\t"]).join(rng.choice(pool) if rng.random() < 0.4 else words(rng, 6) + "." for _ in range(rng.randint(1, 5)))
                          for _ in range(rng.randint(0, 4)))) for i in range(50)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(100, "\n".join(["a line of more than eight words that one document repeats"] * 3))]
    rows += [(200 + k, t) for k, t in with_sentences(seed)]
    got = substring_dedup.removed_spans(docs(spark, rows, CLASHES), min_words=4).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_repeats(rows, 4)
    texts = dict(rows)
    for r in got:  # original offsets of equal units
        assert units.normal(texts[r.doc_id][r.start:r.end]) == units.normal(texts[r.kept_doc_id][r.kept_start:r.kept_end])
    left = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs(spark, rows), min_words=4).collect()}
    lost = {r.doc_id for r in got}
    for key, text in rows:
        spans = [(r.start, r.end) for r in got if r.doc_id == key]
        if key in lost and not units.cut(text, spans).strip():
            assert key not in left
        else:
            assert left[key] == units.cut(text, spans)
            assert key in lost or left[key] == text


def test_cut():
    text = "One two. Three four! Five\n\nSix. Seven."
    assert units.cut(text, []) == text
    assert units.cut(text, [(9, 21)]) == "One two. Five\n\nSix. Seven."
    assert units.cut(text, [(21, 25)]) == "One two. Three four!\n\nSix. Seven."
    assert units.cut(text, [(0, 25)]) == "\nSix. Seven."
    assert units.cut(text, [(27, 32), (32, 38)]) == "One two. Three four! Five\n"


def test_substring_dedup_of_awkward_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = awkward(random.Random(6)) + [(30, long), (31, long.upper() + "\nrest"), (32, "Some start. " + long + "! And an end"), (None, long),
                                        (33, "Another start. " + long + "! Then")]
    got = {tuple(r) for r in substring_dedup.removed_spans(docs(spark, rows, CLASHES)).collect()}
    n = len(long)
    assert got == {(30, 0, 0, n, None, 0, n), (31, 0, 0, n, None, 0, n), (33, 0, 15, 17 + n, 32, 12, 14 + n)}
    assert substring_dedup.removed_spans(docs(spark, [])).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(rows):
    out = []
    for key, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((key, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    group = list(range(len(sets)))
    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least: dict = {}
    for g, (key, _) in zip(group, sets, strict=True):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    return sorted((str(key), len(s), str(None if key is None else least[g])) for g, (key, s) in zip(group, sets, strict=True))


def near_copies(seed: int) -> list[tuple]:
    """Chains of near copies, a large group round a common base, shared passages."""
    rng = random.Random(seed)
    rows, key = [], 0
    passage = words(rng, 40)
    for _ in range(25):
        base = words(rng, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 5)):
            rows.append((key, " ".join(base)))
            key += 1
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = "w" + str(rng.randint(0, 99))
    centre = words(rng, 100).split()
    for _ in range(40):
        copy = list(centre)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "v" + str(rng.randint(0, 999))
        rows.append((key, " ".join(copy)))
        key += 1
    for _ in range(30):
        rows.append((key, words(rng, rng.randint(0, 40)) + "\n" + passage))
        key += 1
    rows += [(key + i, "same text in many rows of this table") for i in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "long_list"), [(1, 16), (2, 2), (3, 1)])
def test_components_equal_brute_force(spark, seed, long_list):
    rows = near_copies(seed)
    got = ngram_join.join_components(docs(spark, rows, CLASHES), long_list=long_list).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_join_of_awkward_rows(spark):
    rows = [r for r in awkward(random.Random(7)) if r[0] != 5]
    df = docs(spark, rows, CLASHES)
    got = ngram_join.join_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] != 8)
    assert ngram_join.join_components(docs(spark, [])).count() == 0


def test_long_texts_hash_like_short_ones():
    rng = random.Random(8)
    text = words(rng, 5000)
    whole = ngram_join.word_hashes(text)
    assert (ngram_join.word_hashes(text, chunk=100) == whole).all()
    assert len(np.unique(whole)) == len(set(text.split()))
    assert (ngram_join.word_hashes("Ab\x0bcD  \t") == ngram_join.word_hashes("ab cd")).all()
    assert (ngram_join.word_hashes("É") != ngram_join.word_hashes("é")).all()
