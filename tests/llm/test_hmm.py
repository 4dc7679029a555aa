"""The hidden Markov language model against plain loops."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHES, awkward, docs, words
from tillroll.llm import hmm


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def train(key):
    return key is None or zlib.crc32(str(key).encode()) % 7 != 2


def corpus(seed=5):
    rng = random.Random(seed)
    rows = awkward(rng)
    for i in range(100, 190):
        rows.append((i, words(rng, rng.randint(0, 60), rng.choice(["abc", "xyz"])).title()))
    return rows + rows[20:24]


class Plain:
    """The same model by loops over texts, tokens and states."""

    def __init__(self, rows, ids, states, mix, own_share):
        self.k, self.mix = states, mix
        self.rows = [(key, [*tokens(text), None]) for key, text in rows]
        self.c = Counter(w for key, ws in self.rows if train(key) for w in ws)
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.own = own = max(2, math.ceil(own_share * self.N))
        self.size = Counter()
        for w, n in self.c.items():
            if w is not None and n < own:
                self.size[n.bit_length()] += n + 1
        start = hmm.start_weights(np.array([ids[w] for w in ids], np.int64), states)
        start = dict(zip(ids, start, strict=True))
        self.e = lambda w, s: self.p0(w) * (start[w][s] if w is not None and self.c[w] >= own else 1)
        self.pi = np.full(states, 1 / states)
        self.A = np.full((states, states), (1 - hmm.STAY) / (states - 1))
        np.fill_diagonal(self.A, hmm.STAY)

    def p0(self, w):
        return (self.c[w] + 1) / (self.N + self.V + 1)

    def share(self, n):
        return (self.size[n.bit_length()] if n else 1) / (self.N + self.V + 1)

    def forward(self, ws):
        a, total = [], 0.0
        for t, w in enumerate(ws):
            now = np.array([(self.pi[s] if t == 0 else a[-1] @ self.A[:, s]) * self.e(w, s) for s in range(self.k)])
            total += math.log10(now.sum())
            a.append(now / now.sum())
        return a, total

    def round(self):
        count, init, move = {}, np.zeros(self.k), np.zeros((self.k, self.k))
        for key, ws in self.rows:
            if not train(key):
                continue
            a, _ = self.forward(ws)
            b = [np.ones(self.k)]
            for w in reversed(ws[1:]):
                e = np.array([self.e(w, s) for s in range(self.k)])
                x = self.A @ (e * b[0])
                b.insert(0, x / x.sum())
            for t, w in enumerate(ws):
                g = a[t] * b[t]
                g /= g.sum()
                n = self.c[w]
                name = w if w is None or n >= self.own else n.bit_length()
                count[name] = count.get(name, 0) + g
                if t == 0:
                    init += g
                else:
                    x = a[t - 1][:, None] * self.A * (np.array([self.e(w, s) for s in range(self.k)]) * b[t])[None]
                    move += x / x.sum()
        mass = sum(count.values())
        self.pi = (init + 1 / self.k) / (init.sum() + 1)
        self.A = (move + 1 / self.k) / (move.sum(1, keepdims=True) + 1)

        def e(w, s):
            n = self.c[w]
            if w is None or n >= self.own:
                return (1 - self.mix) * count.get(w, np.zeros(self.k))[s] / mass[s] + self.mix * self.p0(w)
            q = (1 - self.mix) * count.get(n.bit_length(), np.zeros(self.k))[s] / mass[s] + self.mix * self.share(n)
            return q * self.p0(w) / self.share(n)

        self.e = e


@pytest.mark.parametrize("block_tokens", [400, 1 << 21])
def test_equals_plain_baum_welch(spark, block_tokens):
    rows, share = corpus(), 0.0005
    got = hmm.language_model_scores(docs(spark, rows, CLASHES), states=3, rounds=2, own_share=share, block_tokens=block_tokens)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(map(tuple, got.collect()), key=str)
    seen = sorted({w for _, text in rows for w in tokens(text)})
    keys = spark.createDataFrame([(w, w.encode() if len(w.encode()) <= 64 else b" " + __import__("hashlib").sha256(w.encode()).hexdigest().encode()) for w in seen], "w string, k binary")
    ids = {r.w: r.h for r in keys.select("w", F.xxhash64("k").alias("h")).collect()}
    plain = Plain(rows, ids, 3, hmm.MIX, share)
    assert 4 < plain.own < 20
    for _ in range(2):
        plain.round()
    want = []
    for key, ws in plain.rows:
        base = sum(math.log10(plain.p0(w)) for w in ws)
        want.append((key, not train(key), len(ws), sum(plain.c[w] > 0 for w in ws), plain.N, base, plain.forward(ws)[1]))
    want = sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    model = hmm.Model(3, 0.2, 2, 4, 40, 10, {1: 6})
    model.init, model.move, e = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.random((6, 3))
    texts = [[0, 3, 2], [], [4, 4, 1, 0]]
    steps = hmm.Steps(np.array(sum(texts, []), np.int32), np.array([len(t) for t in texts]), 5)
    got = np.zeros(3)
    for *_, scale in hmm.forward(model, e, steps):
        got[steps.order[:len(scale)]] += np.log(scale)
    for text, score in zip(texts, got, strict=True):
        ws, total = [*text, 5], 0
        for path in itertools.product(range(3), repeat=len(ws)):
            p = model.init[path[0]] * e[ws[0], path[0]]
            for i in range(1, len(ws)):
                p *= model.move[path[i - 1], path[i]] * e[ws[i], path[i]]
            total += p
        assert math.exp(score) == pytest.approx(total)


def test_probabilities_sum_to_one():
    model = hmm.Model(2, 0.2, 3, 5, 5 + 20, 7 + 1, {1: 4, 2: 3})
    n, rng = np.array([1, 1, 2, 4, 4, 5, 3, 0]), np.random.default_rng(2)
    place, sums = np.array([3, 4, 5, 6]), rng.random((4, 2))
    classes, end, move = rng.random((3, 2)), rng.random(2), rng.random((2, 2))
    classes[0] = 0
    init = sums.sum(0) + classes.sum(0) + end - move.sum(0)
    model.learn({(hmm.INIT, 0): init, (hmm.END, 0): end, **{(hmm.MOVE, i): move[i] for i in range(2)}, **{(hmm.CLASS, i): classes[i] for i in range(3)}})
    assert model.emissions(n, place, place, sums).sum(0) == pytest.approx([1, 1])


def test_model_beats_the_unigram_on_held_out_texts(spark):
    rng = random.Random(2)
    vocab = {a: words(rng, 40, a).split() for a in ("abcd", "mnop", "uvwx")}
    rows = [(i, " ".join(rng.choices(vocab[rng.choice(list(vocab))], k=30))) for i in range(300)]
    got = hmm.language_model_scores(docs(spark, rows), states=3, own_share=1e-4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 200


def test_nothing_to_learn_from(spark):
    assert hmm.language_model_scores(docs(spark, [])).collect() == []
    held = next(i for i in range(100) if not train(i))
    got = hmm.language_model_scores(docs(spark, [(held, "a b c"), (held, None)])).collect()
    assert sorted(tuple(r) for r in got) == [(held, True, 1, 0, 0, 0.0, 0.0), (held, True, 4, 0, 0, 0.0, 0.0)]


def test_round_trip_of_packed_tokens():
    for x in ([], [0], [1, 2, 70_000, 1 << 30]):
        assert hmm.unpack(hmm.pack(np.array(x, np.uint32))).tolist() == x


def random_block(seed, sizes, states=3, vocabulary=9):
    rng = np.random.default_rng(seed)
    model = hmm.Model(states, 0.2, 2, 4, 40, 10, {1: 6})
    model.init, model.move = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states)
    sizes = np.array(sizes)
    return model, rng.random((vocabulary + 1, states)), rng.integers(0, vocabulary, sizes.sum()).astype(np.int32), sizes, vocabulary


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_pieces_give_what_whole_texts_give(piece):
    model, e, tokens, sizes, end = random_block(3, [0, 1, 2, 3, 6, 7, 20, 0, 99, 50, 14])
    for wanted in (None, np.arange(len(sizes)) % 4 != 2, np.zeros(len(sizes), bool)):
        whole, cut = (hmm.Steps(tokens, sizes, end, wanted, p) for p in (1000, piece))
        for want, got in zip(hmm.expected(model, e, whole), hmm.expected(model, e, cut), strict=True):
            assert got == pytest.approx(want, rel=1e-5, abs=1e-7)
        scores = []
        for steps in (whole, cut):
            score = np.zeros(len(steps.order))
            for *_, scale in hmm.forward(model, e, steps):
                score[:len(scale)] += np.log(scale)
            scores.append(np.bincount(steps.text[steps.order], score, len(whole.order)))
        assert scores[1] == pytest.approx(scores[0], rel=1e-12)


def test_a_long_text_does_not_make_a_step_a_token():
    model, e, tokens, sizes, end = random_block(4, [20_000] + [250] * 400)
    steps = hmm.Steps(tokens, sizes, end)
    assert sum(1 for _ in hmm.forward(model, e, steps)) < 5_000
    assert hmm.expected(model, e, steps)[2].sum() == pytest.approx(len(tokens) + len(sizes))


def test_words_of_blocks_are_those_of_python(spark):
    rng = random.Random(8)
    odd = ["", " ", "\x1c", "\x1d a", "\x85", "\xa0", " b", "\x0b", "\x0c", "A\tB\rC\nD", " É éE İ ", "y" * 64, "Z" * 65, "Q" * 70 + " q"]
    rows = corpus() + [(1000 + i, " ".join(rng.choices(odd, k=rng.randint(0, 6)))) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = hmm.blocks(docs(spark, rows, CLASHES).coalesce(1), block_tokens=150).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got, known = [], Counter()
    for r in made:
        assert r.train == [train(k) for k in r.docs] and len(set(r.words)) == len(r.words) == len(r.learned)
        assert sum(r.sizes[:-1]) < 150 and (sum(r.sizes) >= 150 or r is made[-1])
        every = iter(hmm.unpack(r.tokens).tolist())
        got += [(k, [bytes(r.words[next(every)]) for _ in range(n)]) for k, n in zip(r.docs, r.sizes, strict=True)]
        assert next(every, None) is None
        known.update({bytes(w): c for w, c in zip(r.words, r.learned, strict=True)})
    short = lambda w: w if len(w) <= 64 else b" " + __import__("hashlib").sha256(w).hexdigest().encode()
    want = [(k, [short(w) for w in (text or "").encode().lower().split()]) for k, text in rows]
    assert got == want
    assert +known == Counter(w for k, ws in want if train(k) for w in ws)
