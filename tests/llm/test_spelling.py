"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tests.llm.helpers import CLASHES, awkward, docs
from tillroll.llm import spelling


def brute(rows):
    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        made = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        made |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = (made & words.keys()) - {w}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def edited(rng, w):
    k, c = rng.randrange(len(w)), rng.choice("abcé÷")
    return rng.choice([w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:]])


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 14))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aabaaaaa", "bananananas"]
    base += ["x" * 14, "x" * 15, "x" * 16, "y" * 300, "y" * 150 + "z" + "y" * 149, "y" * 301]
    pool = base * 30
    for w in base:
        v = [edited(rng, w) for _ in range(4)]
        pool += v * 2 + [edited(rng, x) for x in v for _ in range(2)] * 2
    pool += [w.upper() for w in base[:20]] + ["chaininga"] * 700 + ["chainingab"] * 40 + ["chainingabc"] * 3
    rng.shuffle(pool)
    out, i = [], 0
    while pool:
        n = rng.randint(1, 60)
        out.append((i, " ".join(pool[:n]) + rng.choice(["", ", 12 -", "\n\n"])))
        pool, i = pool[n:], i + 1
    return out + [(9, "aaaaaaa aaaaaaa")]


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MAX_LEVELS", 15)
    rows = corpus() + awkward(random.Random(4))
    got = spelling.spelling_variants(docs(spark, rows, CLASHES))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)


def test_one_prefix_in_a_third_of_the_words(spark):
    rng = random.Random(8)
    words = ["prefix" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(300)] + ["".join(rng.choice("abcdefg") for _ in range(9)) for _ in range(600)]
    rows = [(i, " ".join(rng.sample(words, 40))) for i in range(80)]
    assert {tuple(r) for r in spelling.spelling_variants(docs(spark, rows)).collect()} == brute(rows)


def test_empty_table_and_no_words(spark):
    assert spelling.spelling_variants(docs(spark, [])).collect() == []
    assert spelling.spelling_variants(docs(spark, [(1, None), (2, "short a b"), (None, "")])).collect() == []
