"""BPE encoding and decoding as a streaming transducer.

Encoding.  A merge list is applied to a growing buffer of symbols.  The list
itself bounds how far new text can change tokens to its left (the *sufficient
lookahead*, ``BpeModel.lookahead``): only a merge ``(c, x)`` whose left part
``c`` lies just left of the changed region, and whose right part ``x`` starts
inside it, moves the region's border, by ``len(c)``.  The next such merge must
come later in the list and its right part must begin with the symbol ``c``
(``x`` equals ``c`` or has ``c`` on its left spine), so the largest total move
is a longest path over the merges, found in one pass.  A token that ends at
least that many symbols before the end of the buffer is stable and is emitted
at once; the buffer never holds more than a fixed number of symbols.  Words
shorter than the window are flushed at their end, as the pre-tokenizer ends
all merges there.

If the list is not proper (a merge uses a symbol that a later merge makes, or
two merges make the same symbol), no bound is claimed and a word is buffered
until it ends.

Decoding.  Ids become bytes through a table, and an incremental UTF-8 state
machine turns the bytes into text; bytes of an unfinished character are held
until the next ids.  Without a decoder in the tokenizer file the library joins
the tokens' strings with one blank, and so does ``StreamDecoder``.

Defined results: null text counts as empty; the empty text has no ids and the
SHA-256 of no bytes.  Only ``id_col`` and ``text_col`` are read, so other
columns and their names do not matter; repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm.common import Out, rows

CACHE_WORDS = 500_000  # words that a generation of a worker's cache holds
CACHE_WORD_CHARS = 64
CHUNK_CHARS = 1 << 16  # text is taken in chunks of about so many characters


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte:
    itself if printable in Latin-1, otherwise the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class BpeModel:
    """Vocabulary, merges and text rules of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.lookahead = self._lookahead(merges)
        self.window = 4 * (self.lookahead + 1) if self.lookahead is not None else None
        letters = byte_letters()
        self.byte_ids = [self.vocab.get(c) for c in letters]
        self.last_ids = [self.vocab.get(c + self.suffix) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.special_split = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
                              if self.special else None)
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.pattern = regex.compile(self._pattern(spec["pre_tokenizer"]))
        # the library's own text rules, without its model
        rules = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        low = [chr(c) for c in range(ord(_LATIN_END))]
        self.lowers = self.normalizer is not None and all(
            self.normalizer.normalize_str(c) == c.lower() or c.isspace() for c in low)
        self.agreed: set[str] = set()
        self.odd: set[str] = set()
        self._classify(low)

    @staticmethod
    def _pattern(pre: dict) -> str:
        for p in pre.get("pretokenizers", [pre]):
            if p["type"] == "Split":
                return p["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        # byte-level files without a pattern of their own use this fixed one
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]]) -> int | None:
        left: dict[str, str] = {}    # symbol -> left part of the merge that makes it
        size: dict[str, int] = {}    # symbol -> its length in base symbols
        move: dict[str, int] = {}    # left part of a border merge -> longest move so far
        used: set[str] = set()
        for a, b in merges:
            if a + b in left or a + b in used:
                return None
            used.update((a, b))
            best, x = 0, b
            while x is not None:
                best = max(best, move.get(x, 0))
                x = left.get(x)
            move[a] = max(move.get(a, 0), best + size.get(a, 1))
            left[a + b] = a
            size[a + b] = size.get(a, 1) + size.get(b, 1)
        return max(move.values(), default=0)

    # ---- merging ---------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of ``ids``: lowest rank first, then leftmost."""
        rank, made = self.rank.get, self.made
        if len(ids) <= 4096:
            none = len(made)
            ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                new = made[best]
                ids[i:i + 2] = [new]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((ids[i - 1], new), none)
                if i < len(ranks):
                    ranks[i] = rank((new, ids[i + 1]), none)
            return ids
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[r], -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, emitted through the bounded window."""
        raw = word.encode("utf-8", "replace")
        symbols = [self.byte_ids[b] for b in raw]
        if not symbols:
            return []
        out: list[int] = []
        if self.window is not None:
            at = 0
            while len(symbols) - at > self.window:
                known = symbols[at:at + self.window]  # its last symbol isn't the word's
                done, end = [], 0
                for t in self.merge(known):
                    end += self.length(t)
                    if end > self.window - self.lookahead:
                        break
                    done.append((t, end))
                out += [t for t, _ in done]
                at += done[-1][1]
            symbols = symbols[at:]
        if self.suffix:
            symbols[-1] = self.last_ids[raw[-1]]
        return out + self.merge(symbols)

    @property
    def _sizes(self) -> list[int]:
        if not hasattr(self, "_size_table"):
            k = len(self.suffix)
            self._size_table = [len(s) - (k if k and s.endswith(self.suffix) else 0) for s in self.strings]
        return self._size_table

    def length(self, token: int) -> int:
        """Base symbols (bytes) of a token."""
        return self._sizes[token]

    # ---- text ------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which are parts of their own."""
        return self.special_split.split(text) if any(s in text for s in self.special) else [text]

    def normal(self, text: str) -> str:
        """The library's normal form.  Characters before U+0300 have no
        combining forms and an old, fixed lower case, so a file that asks for
        NFC and lower case only lowers them (white space is left: such files
        drop it)."""
        if self.normalizer is None:
            return text
        if self.lowers and not _BEYOND.search(text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def _classify(self, characters) -> None:
        """Which characters ``pattern`` takes for the same class (letter, number,
        white space, other) as the library, whose Unicode tables are older or
        newer than those of ``regex``: found out once per character."""
        for c in characters:
            probe = f"a{c}{c}1{c}!{c}b"
            (self.agreed if self._split(probe) == self.pattern.findall(probe) else self.odd).add(c)

    def _split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a normal form.  A text with a character of another class
        than the library's is split by the library."""
        if self.odd or _BEYOND.search(text):
            seen = set(text)
            self._classify(seen - self.agreed - self.odd)
            if not self.odd.isdisjoint(seen):
                return self._split(text)
        return self.pattern.findall(text)


_LATIN_END = "\u0300"
_BEYOND = regex.compile("[^\\x00-\\u02FF]")


class Words(dict):
    """What a worker found for the words seen last.  Two generations of at most
    CACHE_WORDS words: a full one becomes the old one, from which words that
    still come are taken over."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of a text that end before white space after a word, where no
    pre-token and no normal form crosses."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at:m.start() + 1]
        at = m.start() + 1
    yield text[at:]


_CUT = regex.compile(r"\S(?=\p{White_Space})")


class StreamEncoder:
    """Ids of a text that comes in chunks (see ``chunks``)."""

    def __init__(self, model: BpeModel):
        self.model, self.words = model, Words(lambda w: packed(model.word(w)))

    def encode(self, text: str) -> Iterator[bytes]:
        m = self.model
        for part in m.parts(text):
            if part in m.special:
                yield packed([m.special[part]])
                continue
            for chunk in chunks(part):
                yield b"".join(map(self.words.__getitem__, m.pre_tokens(m.normal(chunk))))


class StreamDecoder:
    """Text of ids that come in pieces; special tokens are kept."""

    def __init__(self, model: BpeModel):
        self.model = model
        if model.byte_decoder:
            byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
            special = set(model.special)
            self.table = [s.encode() if s in special else b"".join(byte.get(c, c.encode()) for c in s) for s in model.strings]
        else:
            self.table = [s.encode() for s in model.strings]
        self.reset()

    def reset(self) -> None:
        self.first = True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.model.byte_decoder:
            return self.utf8.decode(b"".join([self.table[i] for i in ids]))
        if not ids:
            return ""
        lead = b"" if self.first else b" "
        self.first = False
        return self.utf8.decode(lead + b" ".join([self.table[i] for i in ids]))

    def flush(self) -> str:
        return self.utf8.decode(b"", True)


_MODELS: dict[str, tuple[StreamEncoder, StreamDecoder]] = {}


def coder(path: str) -> tuple[StreamEncoder, StreamDecoder]:
    """A worker's encoder and decoder for a tokenizer file."""
    if path not in _MODELS:
        model = BpeModel(path)
        _MODELS[path] = (StreamEncoder(model), StreamDecoder(model))
    return _MODELS[path]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again; per row the number of
    tokens and the digests of ids and decoded text.  One map over the scan's
    partitions, no shuffle; ids and text are hashed piece by piece."""

    def run(batches):
        encoder, decoder = coder(tokenizer)
        out = Out(DIGESTS)
        for key, text in rows(batches):
            ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            decoder.reset()
            for ids in encoder.encode(text or ""):
                ids_hash.update(ids)
                n += len(ids) // 4
                text_hash.update(decoder.feed(np.frombuffer(ids, "<u4").tolist()).encode())
            text_hash.update(decoder.flush().encode())
            out.add((key, n, ids_hash.hexdigest(), text_hash.hexdigest()))
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text (null: no ids)."""

    def run(batches):
        encoder, _ = coder(tokenizer)
        out = Out(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))
        for key, text in rows(batches):
            ids = np.frombuffer(b"".join(encoder.encode(text or "")), "<u4").astype(np.int32)
            out.add((key, ids), ids.nbytes)
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of ``array<int>`` ids (null: empty)."""

    def run(batches):
        _, decoder = coder(tokenizer)
        out = Out(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        for key, tokens in rows(batches):
            decoder.reset()
            text = "".join([decoder.feed((tokens or [])[i:i + 4096]) for i in range(0, len(tokens or []), 4096)]) + decoder.flush()
            out.add((key, text), len(text))
            if out.full():
                yield out.batch()
        yield out.batch()

    return ids.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
