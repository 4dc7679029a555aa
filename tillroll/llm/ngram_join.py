"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document's set holds the 64-bit hashes of its distinct word shingles.  Sets x
and y reach the similarity only if they share T = ceil(s (|x|+|y|) / (1+s))
shingles, so y occurs T times among the inverted lists of x's shingles.
DivideSkip merges only the short lists and probes the long ones:

* shingles of more than ``long_list`` documents are *long*.  They are counted over
  all documents (pre-aggregated in each task) and kept as a bitmap of a fixed
  size; a wrong bit only moves a shingle in the order below.
* All sets are ordered alike, short shingles first.  Of a set of n, only the
  first n - ceil(s n) + 1 shingles are indexed; a pair that reaches the
  similarity meets in one of those lists.  Long lists are indexed by sets that
  consist of almost nothing else.
* Merging the lists counts each pair's occurrences.  If x's indexed part ends
  first, it misses exactly (indexed - occurrences) of them in y, so pairs with
  too few occurrences are dropped without loss.
* Pairs that are left are settled by binary probes of one whole set in the other.

Equal sets are one class from the start.  Since components are wanted, a class
is first probed against a few *heads*, the classes that meet most others in its
lists.  After that only different components can bring something new: each class
is a query that merges its lists, in bounded chunks, and looks for classes of
larger components alone.  A large group of near copies so costs about one probe
each, and no link between components is lost.

Texts are never shuffled; each pass over them derives what it needs.

Defined results: null or empty text, or text without words, has an empty set and
links with nothing.  A row with a null id takes no part; its component is null.
Rows with an equal id are separate documents.  An empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import Out, partitions, rows, written
from tillroll.llm.graph import components
from tillroll.operators.skew import join_back

WORDS = 5
PERCENT = 80
LONG_LIST = 16
HEADS = 4              # classes of a list that others are probed against first
LIST_CHUNK = 4096      # classes of a list that travel together
MAP_BITS = 26          # bits of the fixed bitmaps, as a power of two
FLUSH = 2_000_000      # shingles a task gathers before it hands them on
SEEN = 200_000         # classes a task remembers to have handed on

_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            for name, base in (("up", _B), ("down", _BI)):
                x = np.full(2 * n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


_POWERS = _Powers()
_BYTES = np.arange(256, dtype=np.uint64)
_LETTER = _BYTES + np.uint64(1) + ((_BYTES >= 65) & (_BYTES <= 90)) * np.uint64(32)  # A-Z lowered, from 1
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, chunk: int = 1 << 18) -> np.ndarray:
    """Hashes of the words (runs of anything but blanks and control blanks),
    A-Z lowered.  Long texts go through in chunks cut at blanks."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    blank = _BLANK[data]
    out, at = [], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        if end < len(data):
            after = np.flatnonzero(blank[end:])
            end = end + int(after[0]) if len(after) else len(data)
        b, gap = data[at:end], np.concatenate(([True], blank[at:end], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = edge[::2], edge[1::2]
        if len(start):
            _POWERS.grow(len(b) + 1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_LETTER[b] * _POWERS.up[:len(b)], out=total[1:])
            h = (total[stop] - total[start]) * _POWERS.down[start]
            out.append(_mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; with fewer words
    that of the whole sequence."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h + w[k:len(w) - n + 1 + k]) * np.uint64(_B)
    h = _mix(h)
    h.sort()
    new = h[1:] != h[:-1]
    return h if new.all() else h[np.concatenate(([True], new))]


def class_of(s: np.ndarray) -> int:
    """64-bit key of a whole set; equal sets have equal keys."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class _Texts:
    """Sets of the documents of one task, each class once while remembered."""

    def __init__(self, words: int):
        self.words, self.seen = words, set()

    def new(self, batches):
        for (text,) in rows(batches):
            s = shingles(text, self.words)
            if len(s) and (c := class_of(s)) not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(c)
                yield c, s


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string"))


def fixed_bitmap(found: DataFrame, buckets: int, least: int = 1) -> np.ndarray:
    """Bits of the values that come more than ``least - 1`` times in ``found``
    (bucket, blob of unsigned 32-bit values): 2 ** MAP_BITS bits, whatever the
    input.  Buckets are ranges of the values, so each task fills its own stretch
    and the driver only puts stretches side by side."""
    width = (1 << MAP_BITS) // buckets

    def fill(key, table):
        values = np.sort(np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in table.column("blob")]))
        if least > 1:
            late, early = values[least - 1:], values[:max(0, len(values) - least + 1)]
            values = late[late == early]
        bits = np.zeros(width, np.uint8)
        bits[(values >> np.uint32(32 - MAP_BITS)).astype(np.int64) - key[0].as_py() * width] = 1
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    filled = found.repartition(partitions(found), "bucket").groupBy("bucket").applyInArrow(fill, "bucket int, bits binary")
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in written(filled, "bitmap").collect():  # the bitmap's fixed size at most
        at = row.bucket * width // 8
        out[at:at + width // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _bit(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values >> np.uint64(64 - MAP_BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _buckets(spark_partitions: int) -> int:
    return 1 << min(MAP_BITS - 6, max(6, (4 * spark_partitions - 1).bit_length()))


def _blobs(values: np.ndarray, buckets: int):
    """(bucket, blob) rows of sorted 32-bit values."""
    cut = np.searchsorted(values, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 32) // buckets))
    for k, part in enumerate(np.split(values, cut)):
        if len(part):
            yield k, part.astype("<u4").tobytes()


SHINGLED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
_SHINGLED = "doc_id long, n_shingles long, c long, bucket int, blob binary"


def shingled(docs: DataFrame, words: int, long_list: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts for two things: set size and class of every row,
    and (``blob``) the shingles of the classes, counted per task as far as needed
    to tell those of more than ``long_list`` documents."""

    def run(batches):
        out, seen, held, n = Out(SHINGLED), set(), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            for k, blob in _blobs(np.repeat(values, np.minimum(counts, long_list + 1)), buckets):
                out.add((None, None, None, k, blob), len(blob))

        for key, text in rows(batches):
            s = shingles(text, words)
            c = class_of(s) if len(s) else None
            out.add((key, len(s), c, None, None))
            if c is not None and key is not None and c not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                held.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(s)
            if n >= FLUSH:
                flush()
                held, n = [], 0
            if out.full():
                yield out.batch()
        if held:
            flush()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SHINGLED)


POSTS = pa.schema([("t", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("last", pa.int64())])
_POSTS = "t long, c long, n int, last long"


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def postings(docs: DataFrame, long: np.ndarray, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The indexed shingles ``t`` of each class ``c`` (in the common order; long
    ones are positive), its set size ``n`` and its last indexed shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(long)  # of a fixed size

    def run(batches):
        ts, cs, ns, rows_held = [], [], [], 0

        def batch():
            k = np.array([len(t) for t in ts])
            t = np.concatenate(ts)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.repeat(np.array(cs, np.int64), k)), pa.array(np.repeat(np.array(ns, np.int32), k)),
                                               pa.array(np.repeat(t[np.cumsum(k) - 1], k))], schema=POSTS)

        for c, s in _Texts(words).new(batches):
            order = (s >> np.uint64(1)) | (_bit(shared.value, s).astype(np.uint64) << np.uint64(63))
            order.sort()
            ts.append(_signed(order[:len(s) - least_overlap(len(s), percent) + 1]))
            cs.append(c)
            ns.append(len(s))
            rows_held += len(ts[-1])
            if rows_held >= 100_000:
                yield batch()
                ts, cs, ns, rows_held = [], [], [], 0
        if ts:
            yield batch()

    return _texts(docs, id_col, text_col).mapInArrow(run, _POSTS)


def _met(batches):
    """Of rows sorted by (t, c): those of lists with another class, repeats
    dropped.  Long lists are spread over tasks and kept as they are."""
    held = None  # the last row so far, and whether it has met another
    met = False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(4)]
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        t, c = cols[0], cols[1]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        cols = [x[new] for x in cols]
        t = cols[0]
        same = t[1:] == t[:-1]
        shared = np.concatenate(([met], same)) | np.concatenate((same, [False]))
        held, met = [x[-1:] for x in cols], bool(shared[-1])
        out = (shared | (t > 0))[:-1]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in cols], schema=POSTS)
    if held is not None and (met or held[0][0] > 0):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], schema=POSTS)


def met_postings(posts: DataFrame) -> DataFrame:
    """Postings that share their list.  Only long lists can be hot: those are
    dealt out by class as well."""
    salt = F.when(F.col("t") > 0, F.pmod(F.xxhash64("c"), F.lit(64))).otherwise(F.lit(0))
    return (posts.repartition(partitions(posts), F.col("t"), salt).sortWithinPartitions("t", "c").mapInArrow(_met, _POSTS))


SETS = pa.schema([("c", pa.int64()), ("s", pa.binary())])


def candidate_sets(docs: DataFrame, pairs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The whole sets of the classes in ``pairs`` (x, y).  A fixed bitmap of them
    keeps other documents out before the shuffle."""
    buckets = _buckets(partitions(docs))
    classes = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()

    def blobs(batches):
        out = Out(pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))
        for batch in batches:
            values = np.sort(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            for k, blob in _blobs(values, buckets):
                out.add((k, blob))
        yield out.batch()

    wanted = docs.sparkSession.sparkContext.broadcast(fixed_bitmap(classes.mapInArrow(blobs, "bucket int, blob binary"), buckets))

    def run(batches):
        out = Out(SETS)
        for c, s in _Texts(words).new(batches):
            if _bit(wanted.value, np.array([c], np.int64).view(np.uint64))[0]:
                out.add((c, s.tobytes()), s.nbytes)
                if out.full():
                    yield out.batch()
        yield out.batch()

    sets = _texts(docs, id_col, text_col).mapInArrow(run, "c long, s binary")
    # one aggregate both picks the wanted classes and drops repeats: a join could
    # be planned anew while its costly side, the texts, is running
    both = sets.withColumn("wanted", F.lit(False)).unionByName(classes.select("c", F.lit(None).cast("binary").alias("s"), F.lit(True).alias("wanted")))
    return both.groupBy("c").agg(F.max("wanted").alias("wanted"), F.max("s").alias("s")).where("wanted and s is not null").select("c", "s")


def probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of classes that reach the similarity, by binary probes
    of the smaller set in the larger one."""

    def run(batches):
        out = Out(pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        for x, y, a, b in rows(batches):
            a, b = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                out.add((x, y))
        yield out.batch()

    xs = sets.select(F.col("c").alias("x"), F.col("s").alias("xs"))
    ys = sets.select(F.col("c").alias("y"), F.col("s").alias("ys"))
    return pairs.select("x", "y").join(xs, "x").join(ys, "y").select("x", "y", "xs", "ys").mapInArrow(run, "u long, v long")


def _merge(percent: int):
    """Merge the lists of each query (rows sorted by it) and keep the classes of
    larger components that occur often enough for the similarity."""

    def found(q, lists):
        x, xn, xlast, xk, xks = q
        c, n, last, k, ks = (np.concatenate([np.asarray(a.field(i)) for a in lists]) for i in range(5))
        ok = ((ks > xks) | ((ks == xks) & (k > xk))) & (100 * np.minimum(n, xn) >= percent * np.maximum(n, xn))
        c, at, o = np.unique(c[ok], return_index=True, return_counts=True)
        n, last = n[ok][at].astype(np.int64), last[ok][at]
        need = -(-percent * (n + xn) // (100 + percent))

        def least(size):  # occurrences among the indexed part of a set that ends first
            return size - -(-percent * size // 100) + 1 - size + need

        enough = o >= np.where(xlast <= last, least(np.int64(xn)), least(n))
        return c[enough]

    def run(batches):
        out = Out(pa.schema([("x", pa.int64()), ("y", pa.int64())]))
        query, lists = None, []

        def close():
            for y in found(query, lists).tolist():
                out.add((query[0], y))

        for b in batches:  # x, xn, xlast, xk, xks, list
            head = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            for i, q in enumerate(head):
                if q != query:
                    if query is not None:
                        close()
                    query, lists = q, []
                lists.append(b.column(5)[i].values)
            if out.full():
                yield out.batch()
        if query is not None:
            close()
        yield out.batch()

    return run


def cross_pairs(posts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that may reach the similarity:
    every class of a smaller component (by size, then name) is a query against
    the lists it shares with larger ones."""
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("ks"))
    known = written(known.join(sizes, "component").select(F.col("node").alias("c"), F.col("component").alias("k"), "ks"), "sized_components")
    at = written(posts.join(known, "c", "left").withColumns({"k": F.coalesce("k", "c"), "ks": F.coalesce("ks", F.lit(1))}), "placed")
    rank = F.struct("ks", "k")
    lists = written(at.groupBy("t").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("m"), F.min(rank).alias("low"))
                    .where("top != low").select("t", "top", F.ceil(F.col("m") / LIST_CHUNK).cast("int").alias("chunks")), "open_lists")
    here = written(at.join(lists, "t"), "open_postings")
    chunk = F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")
    chunks = here.groupBy("t", chunk.alias("chunk")).agg(F.collect_list(F.struct("c", "n", "last", "k", "ks")).alias("list"))
    queries = here.where(rank < F.col("top")).select("t", F.col("c").alias("x"), F.col("n").alias("xn"), F.col("last").alias("xlast"),
                                                      F.col("k").alias("xk"), F.col("ks").alias("xks"))
    merged = queries.join(written(chunks.select("t", "list"), "list_chunks"), "t").select("x", "xn", "xlast", "xk", "xks", "list")
    return merged.repartition(partitions(posts), "x").sortWithinPartitions("x").mapInArrow(_merge(percent), "x long, y long")


def class_components(docs: DataFrame, long: np.ndarray, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``node, component`` of the classes that link with another one; ``long`` is
    the bitmap of long shingles."""
    posts = written(met_postings(postings(docs, long, words, percent, id_col, text_col)), "postings")

    # the heads of each list, and for each class those it meets most often
    counts = written(posts.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "class_counts")
    first = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("m"), "c"))
    heads = written(posts.join(counts, "c").withColumn("r", first).where(F.col("r") <= HEADS).select("t", F.struct("c", "n").alias("y")), "heads")
    meets = posts.join(heads, "t").where("c != y.c").groupBy(F.col("c").alias("x"), F.col("y.c").alias("y")).agg(
        F.count(F.lit(1)).alias("o"), F.first("n").alias("xn"), F.first("y.n").alias("yn"))
    often = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("o"), "y"))
    star = (meets.where(100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
            .where(F.col("o") * 400 >= F.col("xn") * (100 - percent))  # a quarter of what near copies share here
            .withColumn("r", often).where(F.col("r") <= HEADS).select("x", "y"))
    star = written(star, "star_pairs")
    links = written(probed(star, written(candidate_sets(docs, star, words, id_col, text_col), "star_sets"), percent), "star_links")

    cross = written(cross_pairs(posts, components(links), percent), "cross_pairs")
    rest = written(probed(cross, written(candidate_sets(docs, cross, words, id_col, text_col), "cross_sets"), percent), "cross_links")
    return components(links.unionByName(rest))


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, long_list: int = LONG_LIST,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents that reach
    the similarity with each other, directly or through others, share a
    component, named by its smallest ``doc_id``."""
    buckets = _buckets(partitions(docs))
    table = written(shingled(docs, words, long_list, buckets, id_col, text_col), "shingled")
    found = table.where("bucket is null").select("doc_id", "n_shingles", "c")
    long = fixed_bitmap(table.where("bucket is not null").select("bucket", "blob"), buckets, long_list + 1)
    linked = written(class_components(docs, long, words, percent, id_col, text_col), "class_components")
    in_class = found.where("c is not null and doc_id is not null")
    alone = found.where("c is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    sizes = in_class.groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    label = F.coalesce("component", "c")
    classes = sizes.join(linked.withColumnRenamed("node", "c"), "c", "left").withColumn("k", label)
    least = classes.groupBy("k").agg(F.min("least").alias("component_id"))
    classes = written(classes.select("c", "m", "k").join(least, "k").select("c", "m", "component_id"), "classes")
    return join_back(in_class, classes, "c", "m").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component (its smallest id), and those
    without words or id; all columns kept.  An id goes with any of its rows."""
    found = join_components(docs, id_col=id_col, text_col=text_col)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone_doc_id"))
    return docs.join(gone, F.col(id_col) == F.col("_gone_doc_id"), "left_anti")
