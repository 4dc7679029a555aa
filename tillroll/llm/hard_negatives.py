"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors' components become integers, ``floor(scale * x)``, and a row's score is
its integer inner product with an anchor.  Candidates are ordered along a
Hilbert curve through the dimensions that vary most and cut into Parquet blocks
of ``BLOCK_ROWS`` rows; a block's zone map has the smallest and largest value of
each dimension and the labels it holds.  Interval arithmetic over a zone map
bounds the scores that any row of the block can reach with an anchor, and only
blocks whose bounds reach into an anchor's windows are read for it:

1. *Probe*: the blocks with the highest bounds give each anchor first partners,
   and so a least score that its last positive must reach.
2. *Positives*: every block that holds the label and whose bound reaches that
   score is read; the best rows of the label are exact then.
3. *Probe* and *negatives*: the same for each positive's window of scores;
   here a block must have another label, reach the window from above, and not
   lie above all of it.

Bounds only leave out blocks that can't hold a result, so results are exact
whatever the order.  Anchors go in chunks of ``CHUNK`` along the same curve; a
chunk meets the zone maps in groups, and a block's vectors in matrix products,
so memory is bounded by a chunk and a block and no pair of rows is ever a row of
a table but for the best few that a block offers an anchor.  These are kept by
a window limit, which Spark applies before the shuffle as well.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part.  Only vectors of equal length are compared;
those without components score 0.  Zero vectors take part.  Of rows with an
equal id, each is a candidate for other anchors, and the one with the smallest
label and vector is the anchor; none is its own partner.  Ties go to the smaller
id.  Scores are exact, beyond 64 bits they are cut to the largest or smallest
long.  An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Out, discard, partitions, rows, written

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
BLOCK_ROWS = 256
CHUNK = 256
GROUP = 1024
CURVE_DIMS, CURVE_BITS, CURVE_LENGTHS = 15, 4, 64
PROBES = 2
SALTS = 16
_LONG = 2 ** 63 - 1


# --------------------------------------------------------------- integers ---

def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles: 64-bit integers, or Python's if larger."""
    with np.errstate(over="ignore"):
        v = np.floor(scale * x)
    if not v.size or np.abs(v).max() < 2.0 ** 62:
        return v.astype(np.int64)
    exact = [[int(c) if np.isfinite(c) else scale * int(o) for c, o in zip(r, row, strict=True)] for r, row in zip(v.tolist(), x.tolist(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` and ``b``: by doubles while every
    sum is below 2^53, else by 64-bit integers or Python's."""
    most = [int(np.abs(m).max()) if m.size else 0 for m in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _packed(v: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them; its name comes first."""
    if v.dtype == object:
        return b"O" + "\n".join(map(str, v.ravel().tolist())).encode()
    most = int(np.abs(v).max()) if v.size else 0
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    return kind[1].encode() + v.astype("<" + kind).tobytes()


def _unpacked(data: bytes, dim: int, count: int) -> np.ndarray:
    if not dim:
        return np.zeros((count, 0), np.int64)
    if data[:1] == b"O":
        return np.array([int(x) for x in data[1:].split()], object).reshape(count, dim)
    return np.frombuffer(data, "<i" + data[:1].decode(), offset=1).astype(np.int64).reshape(count, dim)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with coordinates of ``bits`` bits;
    ``bits`` times the number of dimensions is at most 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # from the curve's turns and swaps to Gray code
        for i in range(n):
            turned = (x[i] & q) != 0
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0])
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


# ------------------------------------------------------------------ blocks ---

def _valid(table: DataFrame, id_col: str, vec_col: str, label: Column, anchors: Column) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above every number
    return (table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & label.isNotNull())
            .select(F.size(x).alias("dim"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.coalesce(anchors, F.lit(False)).alias("anchor"), x.alias("x")))


def _vectors(batches) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of equal length with their vectors."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            yield dim, part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _curve(valid: DataFrame) -> dict[int, list[tuple[int, float, float]]]:
    """For the ``CURVE_LENGTHS`` most common lengths of vectors, the dimensions
    that vary most with their smallest and largest value.  Others' rows all get
    place 0, which costs time but no result."""
    kinds = {"dim": pa.int32(), "d": pa.int32(), "n": pa.int64(), "s": pa.float64(), "ss": pa.float64(), "lo": pa.float64(), "hi": pa.float64()}

    def run(batches):
        held: dict[int, list] = {}
        for dim, _, x in _vectors(batches):
            y = x * 2.0 ** -600  # squares stay finite
            new = [len(x), y.sum(0), (y * y).sum(0), x.min(0), x.max(0)]
            old = held.get(dim)
            held[dim] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        for dim, (n, s, ss, lo, hi) in held.items():
            cols = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, n, np.int64), s, ss, lo, hi]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(kinds))

    sums = valid.mapInArrow(run, "dim int, d int, n long, s double, ss double, lo double, hi double").groupBy("dim", "d").agg(
        F.sum("n").alias("n"), (F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("var"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    most = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("var"), "d"))
    found: dict[int, list] = {}
    for r in sums.withColumn("r", most).where(F.col("r") <= CURVE_DIMS).orderBy(F.desc("n"), "dim", "r").limit(CURVE_DIMS * CURVE_LENGTHS).collect():
        found.setdefault(r.dim, []).append((r.d, r.lo, r.hi))
    return found


_KEYED = pa.schema([("dim", pa.int32()), ("place", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("v", pa.binary())])
_KEYED_TYPES = "dim int, place long, id long, label long, anchor boolean, v binary"


def _keyed(valid: DataFrame, scale: int) -> DataFrame:
    """Each vector's integers and its place on the curve."""
    curve, cells = _curve(valid), 1 << CURVE_BITS

    def run(batches):
        for dim, part, x in _vectors(batches):
            place = np.zeros(len(x), np.int64)
            if curve.get(dim):
                at = [(x[:, d] / 2 - lo / 2) / max(hi / 2 - lo / 2, 5e-324) for d, lo, hi in curve[dim]]
                place = hilbert(np.clip(np.stack(at, 1) * cells, 0, cells - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(place), part.column("id"), part.column("label"), part.column("anchor"),
                                              pa.array([_packed(r) for r in integers(x, scale)], pa.binary())], schema=_KEYED)

    return valid.mapInArrow(run, _KEYED_TYPES)


_BLOCKS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
                     ("v", pa.binary()), ("zone", pa.binary()), ("held", pa.list_(pa.int64()))])
_BLOCK_TYPES = "block long, dim int, n int, ids array<long>, labels array<long>, v binary, zone binary, held array<long>"


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    """Rows in their order, cut into blocks with zone maps: ``zone`` has the
    smallest values, then the largest, ``held`` the labels."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block():
            dim = held[0][0]
            v = np.concatenate([_unpacked(r[4], dim, 1) for r in held])
            zone = np.stack([v.min(0), v.max(0)]) if dim else np.zeros((2, 0), np.int64)
            row = [number, dim, len(held), [r[2] for r in held], [r[3] for r in held], _packed(v), _packed(zone), sorted({r[3] for r in held})]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for row in rows(batches):
            if held and (len(held) == size or held[0][0] != row[0]):
                yield block()
                number += 1
            held.append(row)
        if held:
            yield block()

    by = ["dim", "place", "id", "label", "v"]
    return keyed.select(*by).repartitionByRange(partitions(keyed), *by).sortWithinPartitions(*by).mapInArrow(run, _BLOCK_TYPES)


def _zones(blocks: DataFrame) -> DataFrame:
    """Zone maps of up to ``GROUP`` neighbouring blocks a row."""
    group = [F.shiftright("block", 32).alias("task"), F.floor(F.col("block") % F.lit(1 << 32) / GROUP).alias("part")]
    return (blocks.groupBy(F.col("dim"), *group).agg(F.collect_list(F.struct("block", "zone", "held")).alias("zones"))
            .withColumn("salt", F.pmod(F.xxhash64("task", "part"), F.lit(SALTS)).cast("int")).drop("task", "part"))


def _everywhere(chunks: DataFrame) -> DataFrame:
    """A copy of each chunk of anchors for each salt."""
    return chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


# ----------------------------------------------------------------- windows ---

class _Chunk:
    """Anchors with the windows of scores that are wanted of each: ``anchor``
    is the place of a window's anchor, ``low`` and ``high`` bound its scores."""

    def __init__(self, row: dict):
        self.number, self.dim = row["chunk"], row["dim"]
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.v = _unpacked(row["v"], self.dim, len(self.ids))
        w = row["windows"]
        self.anchor = np.array([x["anchor"] for x in w], np.int64)
        self.window = [x["partner"] for x in w]
        self.low = np.array([x["low"] for x in w], np.int64)
        self.high = np.array([x["high"] for x in w], np.int64)


def _bounds(v: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest score of each anchor with any row between each
    zone's smallest and largest values: (anchors, zones) each."""
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    lo, hi = zones[:, 0], zones[:, 1]
    both = np.concatenate((up, down), 1)
    return product(both, np.concatenate((hi, lo), 1)), product(both, np.concatenate((lo, hi), 1))


_PICKS = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("anchor", pa.int32()), ("upper", pa.int64())])


def _wanted(chunks: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """``chunk, block, anchor, upper``: blocks that can hold a row of one of the
    anchor's windows, by their bounds and labels (``same``: the anchor's label,
    else another)."""
    met = _everywhere(chunks).join(zones, ["dim", "salt"])

    def run(batches):
        out = Out(_PICKS)
        for batch in batches:
            for row in batch.to_pylist():
                c, z = _Chunk(row), row["zones"]
                upper, lower = _bounds(c.v, np.stack([_unpacked(b["zone"], c.dim, 2) for b in z]) if c.dim else np.zeros((len(z), 2, 0), np.int64))
                held = [np.array(b["held"]) for b in z]
                for k, b in enumerate(z):
                    has = np.isin(c.labels, held[k])
                    fits = has if same else (len(held[k]) > 1) | ~has
                    hit = fits[c.anchor] & (upper[c.anchor, k] >= c.low) & (lower[c.anchor, k] <= c.high)
                    for a in np.unique(c.anchor[hit]).tolist():
                        out.add((c.number, b["block"], a, int(upper[a, k])))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return met.mapInArrow(run, "chunk long, block long, anchor int, upper long")


_FOUND = pa.schema([("anchor_id", pa.int64()), ("partner", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _read(picks: DataFrame, chunks: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor_id, partner, id, score``: the best ``k`` rows of each window from
    the blocks picked for its anchor."""
    cells = picks.groupBy("chunk", "block").agg(F.collect_set("anchor").alias("picked"))  # CHUNK at most
    rows_of = blocks.select("block", F.col("ids").alias("bids"), F.col("labels").alias("blabels"), F.col("v").alias("bv"), "n")
    met = cells.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(_everywhere(chunks), ["chunk", "salt"]).join(rows_of, "block")

    def run(batches):
        out = Out(_FOUND)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Chunk(row)
                ids, labels = np.array(row["bids"], np.int64), np.array(row["blabels"], np.int64)
                scores = product(c.v, _unpacked(row["bv"], c.dim, row["n"]))
                picked = np.zeros(len(c.ids), bool)
                picked[row["picked"]] = True
                for w in np.nonzero(picked[c.anchor])[0].tolist():
                    a = c.anchor[w]
                    s = scores[a]
                    at = np.nonzero(((labels == c.labels[a]) == same) & (ids != c.ids[a]) & (s >= c.low[w]) & (s <= c.high[w]))[0]
                    if len(at) > k:
                        least = np.partition(s[at], len(at) - k)[len(at) - k]
                        at = at[s[at] >= least]
                    at = at[np.lexsort((ids[at], -s[at]))][:k]
                    for x in at.tolist():
                        out.add((int(c.ids[a]), c.window[w], int(ids[x]), int(s[x])))
                if out.full():
                    yield out.batch()
        yield out.batch()

    best = Window.partitionBy("anchor_id", "partner").orderBy(F.desc("score"), "id")
    return (met.mapInArrow(run, "anchor_id long, partner long, id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def _windows(chunks: DataFrame, per_window: DataFrame) -> DataFrame:
    """The chunks with the windows (``chunk, anchor, partner, low, high``)."""
    w = per_window.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("anchor", "partner", "low", "high"))).alias("windows"))
    return chunks.drop("windows").join(w, "chunk")


def _search(chunks: DataFrame, windows: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of every window: a probe of the blocks with the
    highest bounds raises each window's least score, then all blocks that still
    can hold a row are read."""
    at = _windows(chunks, windows)
    picks = written(_wanted(at, zones, same), "picks")
    first = Window.partitionBy("chunk", "anchor").orderBy(F.desc("upper"), "block")
    probe = picks.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PROBES).drop("r")
    seen = (_read(probe, at, blocks, same, k).groupBy("anchor_id", "partner").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")).where(F.col("c") == k))
    places = chunks.select("chunk", F.posexplode("ids").alias("anchor", "anchor_id"))
    seen = seen.join(places, "anchor_id").select("chunk", "anchor", F.col("partner").alias("p"), "least")
    raised = written(windows.alias("w").join(
        seen.alias("s"), (F.col("w.chunk") == F.col("s.chunk")) & (F.col("w.anchor") == F.col("s.anchor")) & F.col("w.partner").eqNullSafe(F.col("s.p")), "left")
        .select("w.chunk", "w.anchor", "partner", F.greatest("low", F.coalesce("least", "low")).alias("low"), "high"), "raised_windows")
    least = raised.groupBy("chunk", "anchor").agg(F.min("low").alias("low"))
    rest = picks.join(least, ["chunk", "anchor"]).where(F.col("upper") >= F.col("low")).drop("low")
    out = written(_read(rest, _windows(chunks, raised), blocks, same, k), "found")
    discard(picks, raised)
    return out


def hard_negatives(table: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 80, scale: int = SCALE,
                   block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each anchor row (``anchors``, over the table's columns) and each of
    its best ``positives`` rows of the same label, the best ``negatives`` rows of
    other labels that score at most as high, and at least ``least`` percent."""
    keyed = written(_keyed(_valid(table, id_col, vec_col, label, anchors), scale), "curve")
    blocks = written(_blocks(keyed, block_rows), "blocks")
    zones = _zones(blocks)
    one = keyed.where("anchor").groupBy("id").agg(F.min(F.struct("label", "dim", "v", "place")).alias("r")).select("id", "r.*")
    chunks = written(_blocks(one, CHUNK).select(F.col("block").alias("chunk"), "dim", "ids", "labels", "v"), "anchors")
    places = chunks.select("chunk", F.posexplode("ids").alias("anchor", "anchor_id"))
    every = places.select("chunk", "anchor", F.lit(0).cast("long").alias("partner"), F.lit(-_LONG - 1).alias("low"), F.lit(_LONG).alias("high"))
    found = _search(chunks, every, blocks, zones, True, positives).select(
        "anchor_id", F.col("rank").cast("long").alias("partner"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * least / 100).cast("long")
    windows = (found.join(places, "anchor_id").select("chunk", "anchor", "partner", low.alias("low"), F.col("positive_score").alias("high"))
               .where(F.col("low") <= F.col("high")))
    hard = _search(chunks, windows, blocks, zones, False, negatives)
    out = written(hard.join(found, ["anchor_id", "partner"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "hard_negatives")
    discard(keyed, blocks, chunks)
    return out
