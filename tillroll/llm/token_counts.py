"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  Each state has a failure link to the state that
remains after the longest matches of its text are popped, and the number of
pieces that are popped on the way.  Reading a word then takes one step per
symbol: follow the trie; where it ends, add the popped count and follow the
failure link.  No piece is built.  Both tables are filled once, breadth first.

Continuing pieces may carry a mark (``"##"``): they hang below the state of
the mark, where failure links of a word's rest lead.  With an empty mark both
kinds share the root.

Defined results: null or empty text has 0 words and 0 tokens; a word that the
vocabulary can't cover counts as one token (the unknown piece) and is counted
in ``n_unknown``.  Only the id and text columns are read; repeated rows give
repeated results.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import BpeModel, Words, byte_letters, chunks
from tillroll.llm.common import Out, rows


class LongestMatch:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, vocabulary, mark: str = ""):
        self.next: list[dict[str, int]] = [{}]
        final = {0: False}

        def path(text: str) -> int:
            at = 0
            for c in text:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    final[to] = False
                at = to
            return at

        self.rest = path(mark)  # where a word goes on after a match
        for piece in vocabulary:
            if piece and piece != mark:
                final[path(piece)] = True
        n = len(self.next)
        self.link: list[int] = [-1] * n  # -1: no match is left to pop
        self.pops: list[int] = [0] * n
        queue = deque([0] if self.rest == 0 else [0, self.rest])
        seen = {0, self.rest}
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if v in seen:
                    continue
                seen.add(v)
                if final[v]:
                    self.link[v], self.pops[v] = self.rest, 1
                else:
                    z, pops = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        pops += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.next[z][c], pops
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if the vocabulary can't cover it."""
        nxt, link, pops = self.next, self.link, self.pops
        at = n = 0
        for c in word:
            to = nxt[at].get(c)
            while to is None:
                if link[at] < 0:
                    return 0
                n += pops[at]
                at = link[at]
                to = nxt[at].get(c)
            at = to
        while at != self.rest:  # pop what the end leaves
            if at == 0 or link[at] < 0:
                return 0
            n += pops[at]
            at = link[at]
        return n


def _bytewise(automaton: LongestMatch):
    letters = byte_letters()
    return lambda word: automaton.count("".join([letters[b] for b in word.encode("utf-8", "replace")]))


_READY: dict[tuple[str, str], tuple] = {}


def counter(path: str, mark: str = "") -> tuple:
    """A worker's word pattern and counts for a vocabulary file: a tokenizers
    JSON (its pieces, byte-level letters and word pattern) or a text file with
    a piece a line (words then are runs of non-blanks)."""
    if (path, mark) not in _READY:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pattern = regex.compile(BpeModel._pattern(spec["pre_tokenizer"]))
            _READY[path, mark] = pattern, Words(_bytewise(LongestMatch(spec["model"]["vocab"], mark)))
        else:
            with open(path, encoding="utf-8") as f:
                pieces = [x.rstrip("\n") for x in f]
            _READY[path, mark] = regex.compile(r"\S+"), Words(LongestMatch(pieces, mark).count)
    return _READY[path, mark]


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str, mark: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the words, greedy word-piece tokens and unknown words of the
    whole text.  One map over the scan's partitions, no shuffle."""

    def run(batches):
        pattern, counts = counter(vocabulary, mark)
        out = Out(COUNTS)
        for key, text in rows(batches):
            words = tokens = unknown = 0
            for chunk in chunks(text or ""):
                found = list(map(counts.__getitem__, pattern.findall(chunk)))
                words += len(found)
                bad = found.count(0)
                unknown += bad
                tokens += sum(found) + bad
            out.add((key, words, tokens, unknown))
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long")
