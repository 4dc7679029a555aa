"""Best-fit packing of token sequences with a bounded number of open bins.

Tokenizing: ids of a whole text (those of the tokenizers library, see
``ids_of``) and an end id; only documents of more than
``capacity`` ids are cut, into full pieces from the end, so that the first may
be shorter.

Packing: pieces meet bins in arrival order.  Open bins stand in stacks by free
space; a bitset (one integer, a bit per free space) finds the tightest bin that
a piece fits by its lowest set bit at or above the piece's length.  No bin
fits: a new one opens; if that makes more than ``open_bins``, the fullest (the
bitset's lowest bit) closes.  A full bin closes at once.

Every task packs its own share of at most about ``TASK_PIECES`` pieces, long ones
first.  Bins that are at most half full at the end of a task (those which could
still meet) are packed again as wholes by a ``FAN_IN``-th of the tasks, round by
round; no task ever holds more than a bounded number of bins.

Defined results: null text packs as the empty text (its end id alone).  Rows
may repeat: each row is packed for itself and equal ids are told apart by no
one (``doc_id`` should be unique); equal lengths go in the order of id and
piece.  Texts of any length are taken whole, long runs of blanks too.  An empty
table gives an empty result.  Numbers of sequences are exact, not hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import BpeModel, byte_letters, packed
from tillroll.llm.common import Out, rows, written

CAPACITY = 2048
OPEN_BINS = 8192
TASK_PIECES = 16_384
FAN_IN = 16


class OpenBins:
    """A bounded set of open bins, found by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.n = 0, 0
        self.stacks: list[list] = [[] for _ in range(capacity + 1)]

    def take(self, least: int):
        """The fullest open bin with at least ``least`` free, or None."""
        up = self.bits >> least
        if not up:
            return None
        free = least + (up & -up).bit_length() - 1
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n -= 1
        return found, free

    def put(self, item, free: int):
        """Keep a bin open; returns the bin that closes for it, if any."""
        if free == 0:
            return item, 0
        self.stacks[free].append(item)
        self.bits |= 1 << free
        self.n += 1
        return self.take(0) if self.n > self.limit else None

    def rest(self) -> Iterator:
        while (x := self.take(0)) is not None:
            yield x


def pack(pieces: Iterable[tuple[object, int]], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[object, int, int]]:
    """Bins for (piece, length): yields (piece, bin, offset) as pieces come and
    at the end (None, bin, used) for each open bin that is half full at most."""
    bins, made = OpenBins(capacity, open_bins), 0
    for piece, length in pieces:
        found = bins.take(length)
        if found is None:
            found, made = (made, capacity), made + 1
        number, free = found
        yield piece, number, capacity - free
        bins.put(number, free - length)
    for number, free in bins.rest():
        if 2 * free >= capacity:
            yield None, number, capacity - free


_READY: dict[str, tuple] = {}

#: The faster library's word pattern fails on very long runs of white space.
_LONG_BLANKS = re.compile(r"\s{65536}")


def _tokenizer(path: str) -> tuple:
    """A worker's byte-level BPE with the vocabulary, word pattern and special
    tokens of a tokenizers file: their ids, from a faster library and, for texts
    that it can't take, from the tokenizers library itself."""
    if path not in _READY:
        import tiktoken
        from tokenizers import Tokenizer

        model = BpeModel(path)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in s): i for s, i in model.vocab.items() if s not in model.special}
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        _READY[path] = model, tiktoken.Encoding("own", pat_str=model.pattern.pattern, mergeable_ranks=ranks, special_tokens={}), library
    return _READY[path]


def ids_of(path: str, text: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    model, words, library = _tokenizer(path)
    if len(text) >= 65536 and _LONG_BLANKS.search(text):
        return packed(library.encode(text, add_special_tokens=False).ids)
    return b"".join(packed([model.special[p]]) if p in model.special else words.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes()
                    for p in model.parts(text))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of at most ``capacity`` ids; no shuffle."""
    end = packed([end_id])

    def run(batches):
        out = Out(PIECES)
        for key, text in rows(batches):
            ids = ids_of(tokenizer, text or "") + end
            n, start, k = len(ids) // 4, 0, 0
            length = n % capacity or capacity
            while start < n:
                out.add((key, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                start, k, length = start + length, k + 1, capacity
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _PIECES)


_TASK_BITS, _BIN_BITS = 27, 30


def bin_number(level: int, task: int, number: int) -> int:
    """A bin's name: its round, task and place in the task, so no two share one."""
    if task >> _TASK_BITS or number >> _BIN_BITS or level >> 6:
        raise OverflowError("too many tasks or bins for a 63-bit number")
    return (level << _TASK_BITS | task) << _BIN_BITS | number


def _first(capacity: int, open_bins: int):
    schema = pa.schema([*PIECES, ("bin", pa.int64()), ("offset", pa.int64()), ("used", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        out = Out(schema)
        for piece, number, at in pack(((r, r[3]) for r in rows(batches)), capacity, open_bins):
            name = bin_number(0, task, number)
            out.add((*piece, name, at, None) if piece else (None, None, None, None, None, name, None, at))
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _again(capacity: int, open_bins: int, level: int):
    schema = pa.schema([("bin", pa.int64()), ("into", pa.int64()), ("base", pa.int64()), ("used", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        out = Out(schema)
        for piece, number, at in pack(((r[0], r[1]) for r in rows(batches)), capacity, open_bins):
            name = bin_number(level, task, number)
            out.add((piece, name, at, None) if piece else (None, name, None, at))
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def best_fit(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``found`` should be a written table, as it is counted first.  ``tasks``
    first-round tasks (default: one for each ``TASK_PIECES`` pieces) take pieces
    dealt by a hash of document and piece, so no key can be hot."""
    n = tasks or 1 + found.count() // TASK_PIECES
    dealt = found.repartition(n, "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(
        _first(capacity, open_bins), _PIECES + ", bin long, offset long, used long")
    placed = written(dealt, "packed")
    left = placed.where("piece is null").select("bin", "used")
    moves = None  # bin of the first round -> bin that took it, place there
    level = 0
    while n > 1:
        level, n = level + 1, -(-n // FAN_IN)
        dealt = left.repartition(n, "bin").sortWithinPartitions(F.desc("used"), "bin").mapInArrow(
            _again(capacity, open_bins, level), "bin long, into long, base long, used long")
        step = written(dealt, "repacked")
        left = step.where("bin is null").select(F.col("into").alias("bin"), "used")
        step = step.where("bin is not null").select("bin", "into", "base")
        if moves is None:
            moves = step
        else:
            s = step.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("base").alias("_base"))
            moves = moves.join(s, "into", "left").select(
                "bin", F.coalesce("_into", "into").alias("into"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base"))
    out = placed.where("piece is not null")
    if moves is not None:
        out = out.join(moves, "bin", "left")
    else:
        out = out.withColumn("into", F.lit(None).cast("long")).withColumn("base", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents.  The pieces (a few numbers each)
    are written once, so lost executors don't tokenize again."""
    return best_fit(written(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity, open_bins)
