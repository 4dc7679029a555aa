"""BPE round trip, token counts and packing against the library and brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import CLASHES, awkward, docs, words
from tillroll.llm import bpe, packing, token_counts

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
MIXED = "abcdefghijklmnopqrstuvwxyzéèßÉÇΣσςİıǅñ'_-0123456789 \t\n  \x1ć한글汉字かな🙂👩‍👩‍👧ﬁĲ٣ÅÅ"


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    out += [words(rng, 60) for _ in range(20)]
    return out + ["", "<|endoftext|>a<|startoftext|> b <|endoftext|>", "''s 'll''re", "a" * 9000, "ab" * 4000,
                  "".join(rng.choice("theanigrso") for _ in range(9000)), "word " * 30_000]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_decoding_equal_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    encoder, decoder = bpe.coder(path)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
        assert got == want, text[:60]
        decoder.reset()
        parts = [decoder.feed(got[i:i + 5]) for i in range(0, len(got), 5)] + [decoder.flush()]
        assert "".join(parts) == library.decode(want, skip_special_tokens=False)


def test_packed_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.ids_of(path, text), "<u4").tolist() == want, text[:60]


@pytest.mark.parametrize("name", FILES)
def test_every_code_point_equals_the_library(name):
    """Between letters, numbers and signs; alone and composed with marks."""
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    encoder, _ = bpe.coder(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # the planes of ideographs and private use in steps, everything else whole
    points = [c for c in points if ord(c) < 0x3400 or 0xA000 <= ord(c) < 0xAC00 or 0xD7A0 <= ord(c) < 0x20000 and ord(c) % 2 == 0
              or 0xE0000 <= ord(c) < 0xE0200 or ord(c) % 97 == 0]
    texts = [f"a{c}{c}1{c}!{c}b" for c in points] + [f"e{c}\u0307x {c}\u0301" for c in points[::7]]
    texts += ["\U000105d2\u0307x", "\U00011935\U00011930 y", "\U000113c2\U000113b8"]  # composed in some Unicode versions only
    for at in range(0, len(texts), 5000):
        part = texts[at:at + 5000]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist() == want.ids, ascii(text)
            if name == "byte_bpe_50k.json":
                assert np.frombuffer(packing.ids_of(path, text), "<u4").tolist() == want.ids, ascii(text)


def test_lookahead_is_sufficient():
    """Tokens that end before the bound stay the same whatever follows."""
    model = bpe.BpeModel(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    bound = model.lookahead
    for _ in range(10):
        head = [model.byte_ids[ord(rng.choice("theanigrso "))] for _ in range(3 * bound)]

        def cut(tail, head=head):
            out, end = [], 0
            for t in model.merge(head + tail):
                end += model.length(t)
                if end > len(head) - bound:
                    return out
                out.append(t)
            return out

        tails = [[model.byte_ids[ord(rng.choice("theanigrso "))] for _ in range(rng.randint(0, 200))] for _ in range(4)]
        assert len({tuple(cut(t)) for t in tails}) == 1


def test_improper_merges_have_no_bound():
    assert bpe.BpeModel._lookahead([("ab", "c"), ("a", "b")]) is None
    assert bpe.BpeModel._lookahead([("a", "b"), ("ab", "c")]) == 2


def test_round_trip_query(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = awkward(random.Random(1))
    got = bpe.round_trip_digests(docs(spark, rows, CLASHES), path).collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip_digests(docs(spark, []), path).count() == 0


def test_encode_then_decode(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r for r in awkward(random.Random(2)) if r[0] is not None and r[0] != 5]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark, rows), path), path).collect()}
    assert back == {k: t or "" for k, t in rows}


def brute_pieces(vocab: set[str], word: str) -> int:
    """Greedy longest match, piece by piece; 0 if it gets stuck."""
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_counts():
    rng = random.Random(9)
    for _ in range(300):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.LongestMatch(vocab)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            assert automaton.count(word) == brute_pieces(vocab, word), (vocab, word)


def test_marked_pieces():
    rng = random.Random(10)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        vocab = {p if rng.random() < 0.5 else "##" + p for p in pieces} | {"a", "##b"}
        automaton = token_counts.LongestMatch(vocab, "##")
        for _ in range(30):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 10)))
            n = at = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
                if end is None:
                    n = 0
                    break
                n, at = n + 1, end
            assert automaton.count(word) == n, (vocab, word)


def test_token_counts_query(spark):
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = set(json.load(open(path, encoding="utf-8"))["model"]["vocab"])
    pattern, _ = token_counts.counter(path)
    letters = bpe.byte_letters()
    rows = [r for r in awkward(random.Random(4)) if r[0] != 6]
    got = token_counts.token_counts(docs(spark, rows, CLASHES), path).collect()
    want = []
    for key, text in rows:
        found = pattern.findall(text or "")
        want.append((key, len(found), sum(brute_pieces(vocab, "".join(letters[b] for b in w.encode())) for w in found), 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def check_packing(rows, pieces_of, capacity):
    by_doc: dict = {}
    by_bin: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in by_doc.items()} == pieces_of
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_bin)


@pytest.mark.parametrize("tasks", [None, 40])
def test_packing(spark, tasks):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    rows = [(100 + i, words(rng, int(rng.expovariate(1 / 300)))) for i in range(120)]
    rows += [r for r in awkward(rng) if r[0] is not None and not (r[0] == 5 and r in rows)]
    rows = list({r[0]: r for r in rows}.values()) + [(1000, "<|endoftext|> end <|endoftext|>")]
    want = {}
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want[key] = [(i, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = packing.written(packing.pieces(docs(spark, rows, CLASHES), path), "pieces")
    n = check_packing(packing.best_fit(found, tasks=tasks).collect(), want, 2048)
    least = -(-sum(p[2] for v in want.values() for p in v) // 2048)
    assert n <= (least + 1 if tasks is None else 1.35 * least)
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_bounded_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.put("a", 4) is None and bins.put("b", 7) is None
    assert bins.put("c", 2) == ("c", 2)  # the fullest of three closes
    assert bins.take(5) == ("b", 7) and bins.take(5) is None
    rng = random.Random(8)
    pieces = [(i, rng.randint(1, 10)) for i in range(500)]
    used: dict = {}
    for piece, number, at in packing.pack(pieces, 10, 3):
        if piece is not None:
            assert used.get(number, 0) == at
            used[number] = at + pieces[piece][1]
    assert max(used.values()) <= 10


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n", "\u00a0"])
def test_long_white_space_equals_the_library(blank):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in (blank * 2_000_000, "a word" + blank * 400_000 + "x" + blank * 65_536, blank * 70_000 + "<|endoftext|> end"):
        assert packing.ids_of(path, text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bin_numbers_are_unique():
    every = [packing.bin_number(*x) for x in itertools.product((0, 1, 63), (0, 1, 2 ** 27 - 1), (0, 5, 2 ** 30 - 1))]
    assert len(set(every)) == len(every) and 0 <= min(every) and max(every) < 2 ** 63
    with pytest.raises(OverflowError):
        packing.bin_number(0, 2 ** 27, 0)
