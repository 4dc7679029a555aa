"""Nearest-neighbour graphs by NN-descent on Spark.

A node's list of near nodes is refined through its neighbours' neighbours: each
node is a *centre* that brings together the vectors of its neighbours and of
those that list it, and every pair among them that has a new member is measured
there (a small matrix product); pairs that improve a list are handed on.  Lists
start from blocks of rows that are neighbours in several random orderings of the
space (signs of random projections), so that hot regions are spread over blocks
of a fixed size.

Vectors travel as one byte a component for this; results are always measured
anew on the original vectors, in double precision.  Equal vectors are one node.

Nulls: a vector takes part if it and its id are not null, its components are
finite and not all zero, and it has the most common number of components.  Of
rows with an equal id one counts, that with the smallest vector bytewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import Out, partitions, rows, written
from tillroll.operators.skew import join_back

BLOCK = 256    # rows that an initial block compares with each other
SIGNS = 10     # random projections of an ordering
START = 8      # neighbours that a block gives to a row


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x`` (little-endian floats of the input's precision) of the vectors
    that take part."""
    single = df.schema[vec_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"

    def run(batches):
        out = Out(pa.schema([("id", pa.int64()), ("x", pa.binary()), ("dim", pa.int32())]))
        for key, vec in rows(batches):
            if key is not None and vec and None not in vec:
                x = np.asarray(vec, kind)
                if np.isfinite(x).all() and x.any():
                    out.add((key, x.tobytes(), len(x)), x.nbytes)
                    if out.full():
                        yield out.batch()
        yield out.batch()

    found = df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "id long, x binary, dim int")
    found = written(found, "vectors")
    common = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found.where(F.col("dim") == (common["dim"] if common else 0)).groupBy("id").agg(F.min("x").alias("x"))


def kind_of(df: DataFrame, vec_col: str) -> str:
    return "<f4" if df.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, x, n`` (equal vectors under their smallest id) and members
    ``id, node``."""
    nodes = written(vectors.groupBy("x").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    per_key = nodes.select("x", "node", F.col("n").alias("_n"))
    members = written(join_back(vectors, per_key, "x", "_n").select("id", "node"), "members")
    return nodes.select(F.col("node").alias("id"), "x", "n"), members


def bytes_of(nodes: DataFrame, kind: str, unit: bool) -> DataFrame:
    """``id, q``: a scale and one signed byte a component, of unit length first
    if ``unit``."""

    def run(batches):
        out = Out(pa.schema([("id", pa.int64()), ("q", pa.binary())]))
        for key, x in rows(batches):
            x = np.frombuffer(x, kind).astype(np.float64)
            if unit:
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
            scale = max(np.abs(x).max() / 127, 1e-300)
            out.add((key, np.float64(scale).tobytes() + np.rint(x / scale).astype(np.int8).tobytes()))
            if out.full():
                yield out.batch()
        yield out.batch()

    return written(nodes.select("id", "x").mapInArrow(run, "id long, q binary"), "quantized")


def _floats(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return raw[:, 8:].view(np.int8).astype(np.float32) * raw[:, :8].copy().view(np.float64).astype(np.float32)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances among the rows."""
    own = np.einsum("ij,ij->i", x, x)
    return np.maximum(own[:, None] + own[None, :] - 2 * (x @ x.T), 0)


PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float32())])
_PAIRS = "u long, v long, d float"


def _emit(u, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32())], schema=PAIRS)


def initial(quantized: DataFrame, orderings: int, seed: int) -> DataFrame:
    """Pairs from blocks of neighbours in ``orderings`` random orderings."""

    def keyed(batches):
        planes: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _floats(batch.column(1).to_pylist())
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((orderings, x.shape[1], SIGNS + 1)).astype(np.float32)
            for o in range(orderings):
                p = x @ planes[o]
                sign = p[:, :SIGNS] > 0
                sign = np.logical_xor.accumulate(sign, axis=1)  # neighbouring cells differ in one sign
                cell = sign @ (1 << np.arange(SIGNS)[::-1]) + (o << SIGNS)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(p[:, SIGNS]), batch.column(0), batch.column(1)],
                                                 names=["cell", "p", "id", "q"])

    def compared(batches):
        held: list[tuple] = []

        def block():
            ids = np.array([r[1] for r in held], np.int64)
            if len(ids) > 1:
                d = _distances(_floats([r[2] for r in held]))
                np.fill_diagonal(d, np.inf)
                k = min(START, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield _emit(np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel())

        for cell, key, q in rows(batches):
            if held and (len(held) >= BLOCK or cell >> SIGNS != held[-1][0] >> SIGNS):
                yield from block()
                held = []
            held.append((cell, key, q))
        if held:
            yield from block()

    n = partitions(quantized)
    return (quantized.mapInArrow(keyed, "cell long, p float, id long, q binary")
            .repartitionByRange(n, "cell", "p", "id").sortWithinPartitions("cell", "p", "id").select("cell", "id", "q")
            .mapInArrow(compared, _PAIRS))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; a pair counts as new if every row has it so."""
    best = pairs.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return (best.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("k") <= k).drop("k"))


def _local_join(keep: int):
    def run(batches):
        held: list[tuple] = []
        us, vs, ds = [], [], []

        def centre():
            if len(held) < 2 or not any(r[2] for r in held):
                return
            ids = np.array([r[1] for r in held], np.int64)
            new = np.array([r[2] for r in held], bool)
            worst = np.array([r[3] for r in held], np.float32)
            d = _distances(_floats([r[4] for r in held]))
            d[~(new[:, None] | new[None, :])] = np.inf
            np.fill_diagonal(d, np.inf)
            k = min(keep, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dn = np.take_along_axis(d, near, 1)
            ok = dn < worst[:, None]
            us.append(np.repeat(ids, k)[ok.ravel()])
            vs.append(ids[near][ok])
            ds.append(dn[ok])

        for row in rows(batches):  # u, v, new, worst, q
            if held and row[0] != held[0][0]:
                centre()
                held = []
                if len(us) >= 200:
                    yield _emit(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))
                    us, vs, ds = [], [], []
            held.append(row)
        if held:
            centre()
        if us:
            yield _emit(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))

    return run


def both_ways(edges: DataFrame, k: int) -> DataFrame:
    """Lists and the ``k`` nearest of those that list a node: u, v, new."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "new")
    back = back.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("k") <= k).drop("k")
    return edges.unionByName(back).groupBy("u", "v").agg(F.max("new").alias("new"), F.min("d").alias("d"))


def descend(quantized: DataFrame, k: int, rounds: int, orderings: int = 8, seed: int = 1, settled: float = 0.01,
            start: DataFrame | None = None) -> DataFrame:
    """Written neighbour lists ``u, v, d, new`` after at most ``rounds`` rounds,
    or when less than a share ``settled`` of the entries is new."""
    n = partitions(quantized)
    pairs = initial(quantized, orderings, seed).withColumn("new", F.lit(True))
    if start is not None:
        pairs = pairs.unionByName(start.withColumn("new", F.lit(True)))
    edges = written(nearest(pairs, k), "neighbours")
    for _ in range(rounds):
        worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        nodes = quantized.join(worst.withColumnRenamed("u", "id"), "id").select(F.col("id").alias("v"), "worst", "q")
        met = both_ways(edges, k).join(nodes, "v").select("u", "v", "new", "worst", "q")
        found = met.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_local_join(max(4, k // 2)), _PAIRS)
        pairs = edges.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True)))
        edges = written(nearest(pairs, k), "neighbours")
        counts = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("new").cast("long")).alias("new")).first()
        if (counts["new"] or 0) <= settled * counts["n"]:
            break
    return edges
