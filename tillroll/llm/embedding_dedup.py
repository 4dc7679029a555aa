"""Embedding near-duplicates by NN-descent.

The neighbour graph is refined until it settles (``nn_graph``).  A node whose
whole list lies within the threshold is *saturated*: it may have more links than
its list holds, in its own component and in others, as closer members of a dense
family crowd them out.  So all nodes of components with a saturated node are
measured against each other, block against block; a block knows its mean
direction and the largest angle to it, and pairs of blocks that the triangle
inequality excludes are left out.  Only counts and pairs of connected components
leave this, and components it connects are one.  All links are measured in
double precision on the original vectors.

Recall is audited on a fixed number of nodes against all nodes, a node at a time
and apart for nodes outside dense components.  Where links are rare such a sample
may see none; so a fixed number of nodes get a planted partner, just within the
threshold, that takes part in the descent, and the share of these pairs found is
measured too.  Below ``least_recall`` the graph is refined again with twice the
list and twice as many other orderings.  If that stays in vain, all nodes are measured in blocks, which is
exact and quadratic, and a warning says so.

Equal vectors are one node: its members link with each other and with all
members of linked nodes.

Defined results: see ``nn_graph`` for vectors that take no part; they link with
nothing and are their own component.  An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import nn_graph
from tillroll.llm.common import Out, partitions, rows, written
from tillroll.llm.graph import components
from tillroll.operators.skew import join_back

THRESHOLD = 0.95
K, ROUNDS, ORDERINGS = 12, 3, 16
BLOCK = 256
CHUNK = 1024  # blocks whose mean directions are compared at once
AUDIT_NODES = 256
LEAST_RECALL = 0.99
PLANTED = 512
_SLACK = 0.02  # of the cosine, for vectors of one byte a component

BALLS = pa.schema([("block", pa.int64()), ("mean", pa.binary()), ("angle", pa.float64()), ("comps", pa.binary()), ("ids", pa.binary()),
                   ("ns", pa.binary()), ("xs", pa.binary())])
_BALLS = "block long, mean binary, angle double, comps binary, ids binary, ns binary, xs binary"


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def verified(pairs: DataFrame, nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) whose cosine reaches the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64) for i in (2, 3))
                cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                ok = pa.array(cos >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    xs = nodes.select(F.col("id").alias("u"), F.col("x").alias("xu"))
    ys = nodes.select(F.col("id").alias("v"), F.col("x").alias("xv"))
    return pairs.select("u", "v").join(xs, "u").join(ys, "v").select("u", "v", "xu", "xv").mapInArrow(run, "u long, v long")


def blocks_of(group: DataFrame, kind: str) -> DataFrame:
    """Nodes (``family, component, id, x, n``) in blocks of at most ``BLOCK`` of
    one family that lie near each other in a random ordering: a row per block
    with its nodes one after the other, its mean direction and the largest angle
    to it."""

    def keyed(batches):
        planes: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(3).to_pylist(), kind)
                if planes is None:
                    planes = np.random.default_rng(1).standard_normal((x.shape[1], nn_graph.SIGNS + 1))
                p = x @ planes
                sign = np.logical_xor.accumulate(p[:, :nn_graph.SIGNS] > 0, axis=1)
                cell = sign @ (1 << np.arange(nn_graph.SIGNS)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(p[:, nn_graph.SIGNS]), *batch.columns],
                                                 names=["cell", "p", "family", "component", "id", "x", "n"])

    def packed(batches):
        out = Out(BALLS)
        held: list[tuple] = []

        def block():
            _, comps, ids, xs, ns = zip(*held, strict=True)
            u = _unit(list(xs), kind)
            mean = u.mean(axis=0)
            size = np.sqrt(mean @ mean)
            mean = mean / size if size > 1e-6 else u[0]
            angle = float(np.arccos(np.clip(u @ mean, -1, 1)).max())
            parts = [np.array(c, np.int64).tobytes() for c in (comps, ids, ns)] + [b"".join(xs)]
            out.add((min(ids), mean.tobytes(), angle, *parts), sum(map(len, parts)))

        for row in rows(batches):  # family, component, id, x, n
            if held and (len(held) >= BLOCK or row[0] != held[0][0]):
                block()
                held = []
                if out.full():
                    yield out.batch()
            held.append(row)
        if held:
            block()
        yield out.batch()

    placed = group.select("family", "component", "id", "x", "n").mapInArrow(keyed, "cell long, p double, family long, component long, id long, x binary, n long")
    return (placed.repartitionByRange(partitions(group), "family", "cell", "p", "id").sortWithinPartitions("family", "cell", "p", "id")
            .select("family", "component", "id", "x", "n").mapInArrow(packed, _BALLS))


def near_blocks(balls: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks (``a, b``, each pair once, a block with itself too) that
    may hold a link: by the triangle inequality of angles, no others do."""
    chunks = 1 + balls.count() // CHUNK
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    meets = balls.select("block", "mean", "angle", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("o")).select(
        F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "block", "mean", "angle")
    widest = float(np.arccos(threshold)) + 1e-6

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        block, angle, c = (table.column(n).to_numpy() for n in ("block", "angle", "c"))
        mean = np.frombuffer(b"".join(table.column("mean").to_pylist()), np.float64).reshape(len(block), -1)
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        apart = np.arccos(np.clip(mean[left] @ mean[right].T, -1, 1))
        x, y = np.nonzero(apart <= widest + angle[left][:, None] + angle[right])
        a, b = block[left[x]], block[right[y]]
        if i == j:
            a, b = a[a <= b], b[a <= b]
        return pa.table({"a": a, "b": b})

    return meets.repartition(partitions(balls), "i", "j").groupBy("i", "j").applyInArrow(run, "a long, b long")


def measured_in_blocks(group: DataFrame, kind: str, threshold: float) -> DataFrame:
    """All links among the nodes (``family, component, id, x, n``), within and
    between components.  Written rows ``u, v, links``: of a node and a block
    its number of links (``v`` null), and pairs of components that a link
    connects (``links`` null)."""
    balls = written(blocks_of(group, kind), "blocks")
    pairs = near_blocks(balls, threshold)
    turned = F.xxhash64("a", "b") % 2 == 0  # so that no block stands on one side of all its pairs
    pairs = written(pairs.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"),
                                 F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b")), "block_pairs")
    held = ["comps", "ids", "ns", "xs"]
    met = (pairs.join(balls.select(F.col("block").alias("a"), *held), "a")
           .join(balls.select(F.col("block").alias("b"), *(F.col(c).alias(f"o_{c}") for c in held)), "b")
           .select("a", "b", *held, *(f"o_{c}" for c in held)))

    def run(batches):
        out = Out(pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())]))
        for a, b, *parts in rows(batches):
            (ca, ia, na), (cb, ib, nb) = ([np.frombuffer(p, np.int64) for p in parts[k:k + 3]] for k in (0, 4))
            x, y = (np.frombuffer(parts[k], kind).reshape(n, -1).astype(np.float64) for k, n in ((3, len(ia)), (7, len(ib))))
            near = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ (y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]).T >= threshold
            if a == b:
                np.fill_diagonal(near, False)
            for ids, counts in [(ia, near @ nb)] + ([(ib, near.T @ na)] if a != b else []):
                for u, links in zip(ids.tolist(), counts.tolist(), strict=True):
                    if links:
                        out.add((u, None, links))
            i, j = np.nonzero(near & (ca[:, None] != cb))
            for u, v in np.unique(np.stack((ca[i], cb[j]), axis=1), axis=0).tolist():
                out.add((u, v, None))
            if out.full():
                yield out.batch()
        yield out.batch()

    return written(met.mapInArrow(run, "u long, v long, links long"), "block_links")


def audit(nodes: DataFrame, links: DataFrame, settled: DataFrame, kind: str, threshold: float, size: int = AUDIT_NODES) -> float:
    """Recall of the links in ``links`` (u < v) or among the ``settled`` nodes
    (node, component), which are measured in blocks.  ``size`` nodes of the
    settled ones and ``size`` others are compared with all nodes by brute force;
    of either kind, the mean over nodes with a link of the share found; the
    smaller mean.  So neither a node with many links nor the settled ones hide
    what others miss."""
    marked = nodes.select("id", "x").join(settled.select(F.col("node").alias("id"), F.lit(True).alias("s")), "id", "left")
    marked = written(marked.select("id", "x", F.coalesce("s", F.lit(False)).alias("s")), "audit_nodes")
    sample = [r for s in (False, True) for r in marked.where(F.col("s") == s).orderBy(F.xxhash64("id")).limit(size).collect()]  # a fixed number of rows
    if not sample:
        return 1.0
    ids, inner = np.array([r.id for r in sample], np.int64), np.array([r.s for r in sample], bool)
    known = nodes.sparkSession.sparkContext.broadcast(_unit([bytes(r.x) for r in sample], kind))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                v, s = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                near = (_unit(part.column(1).to_pylist(), kind) @ known.value.T >= threshold) & (v[:, None] != ids)
                measured = near & s[:, None] & inner
                a, b = np.nonzero(near & ~measured)
                n = measured.sum(axis=0)
                at = np.flatnonzero(n)  # found: only their number goes on
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[b], ids[at]))), pa.array([*v[a].tolist(), *[None] * len(at)], pa.int64()),
                                                  pa.array(np.concatenate((np.ones(len(a), np.int64), n[at])))], names=["u", "v", "n"])

    true = written(marked.mapInArrow(run, "u long, v long, n long"), "audit")
    hit = links.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("hit"))
    found = true.join(hit, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")) & F.col("v").isNotNull(), "left")
    share = found.groupBy("u").agg((F.sum(F.when(F.col("v").isNull() | F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    shares = {r.u: r.share for r in share.collect()}  # at most a row per sampled node
    kinds = ([shares[i] for i in ids[inner == s].tolist() if i in shares] for s in (False, True))
    return min((float(np.mean(x)) for x in kinds if x), default=1.0)


def partners(nodes: DataFrame, kind: str, threshold: float, size: int = PLANTED) -> list[tuple[int, int, bytes]]:
    """(new id, node, vector) of ``size`` nodes: the node's direction, turned
    in a random plane to a cosine just above the threshold.  None where vectors
    have one component, or if ids leave no room for new ones."""
    ends = nodes.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if ends["lo"] is None:
        return []
    base = ends["hi"] + 1 if ends["hi"] < (1 << 63) - 1 - size else ends["lo"] - size
    sample = nodes.orderBy(F.xxhash64("id", F.lit(7))).select("id", "x").limit(size).collect()  # a fixed number of rows
    x = _unit([bytes(r.x) for r in sample], kind)
    if x.shape[1] < 2 or base < -(1 << 63):
        return []
    away = np.random.default_rng(2).standard_normal(x.shape)
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    away /= np.sqrt(np.einsum("ij,ij->i", away, away))[:, None]
    cos = threshold + 0.1 * (1 - threshold)
    y = cos * x + np.sqrt(1 - cos * cos) * away
    return [(base + i, r.id, y[i].astype(kind).tobytes()) for i, r in enumerate(sample)]


def planted_recall(lists: DataFrame, full: DataFrame, pairs: DataFrame) -> float:
    """Share of the pairs (p, s) that the lists hold, or of which a list is full
    of nodes within the threshold: its component is measured in blocks."""
    listed = lists.select("u", "v")
    listed = listed.unionByName(listed.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    hit = pairs.join(listed.select(F.col("u").alias("p"), F.col("v").alias("s"), F.lit(1).alias("hit")), ["p", "s"], "left")
    for end in ("p", "s"):
        hit = hit.join(full.select(F.col("node").alias(end), F.lit(1).alias(f"full_{end}")), end, "left")
    row = hit.agg(F.count(F.lit(1)).alias("n"), F.count(F.coalesce("hit", "full_p", "full_s")).alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                    k: int = K, least_recall: float = LEAST_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    kind = nn_graph.kind_of(df, vec_col)
    vectors = nn_graph.usable(df, id_col, vec_col)
    nodes, members = nn_graph.classes(vectors)
    spark = df.sparkSession
    extra = partners(nodes, kind, threshold)
    added = spark.createDataFrame([(p, bytearray(x)) for p, _, x in extra], "id long, x binary")
    planted = spark.createDataFrame([(p, s) for p, s, _ in extra], "p long, s long")
    real = lambda c: ~F.col(c).between(extra[0][0], extra[-1][0]) if extra else F.lit(True)
    quantized = nn_graph.bytes_of(nodes.select("id", "x").unionByName(added), kind, unit=True)
    near_enough = F.col("d") <= 2 * (1 - threshold + _SLACK)
    lists = None
    for attempt in range(3):
        lists = nn_graph.descend(quantized, k, ROUNDS, ORDERINGS << attempt, seed=attempt + 1,
                                 start=None if lists is None else lists.select("u", "v", "d"))
        pairs = lists.where(near_enough & real("u") & real("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = written(verified(pairs, nodes, kind, threshold), "near_links")
        comps = written(components(links), "near_components")
        full = lists.where(near_enough).groupBy("u").count().where(F.col("count") >= k).select(F.col("u").alias("node"))
        saturated = comps.join(full, "node", "left_semi").select("component").distinct()
        settled = written(comps.join(saturated, "component", "left_semi"), "saturated")
        if min(planted_recall(lists, full, planted), audit(nodes, links, settled, kind, threshold)) >= least_recall:
            families = settled.withColumn("family", F.col("component"))
            break
        k *= 2
    else:  # the exact way for all nodes; those outside dense families share blocks
        warnings.warn(f"near-duplicate recall stayed below {least_recall}: all vectors are measured in blocks", stacklevel=2)
        dense = settled.select(F.col("node").alias("id"), F.col("component").alias("family"))
        families = (nodes.select("id").join(comps.withColumnRenamed("node", "id"), "id", "left").join(dense, "id", "left")
                    .select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"), "family"))
    group = nodes.join(families.withColumnRenamed("node", "id"), "id")
    measured = measured_in_blocks(written(group.select("family", "component", "id", "x", "n"), "group_nodes"), kind, threshold)
    many = measured.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    merged = components(measured.where("v is not null").select("u", "v")).select(F.col("node").alias("component"), F.col("component").alias("larger"))
    comps = comps.join(merged, "component", "left").select("node", F.coalesce("larger", "component").alias("component"))
    lone = merged.join(comps.select(F.col("node").alias("component")), "component", "left_anti")  # nodes that only the exact way links
    comps = comps.unionByName(lone.select(F.col("component").alias("node"), F.col("larger").alias("component")))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    few = (both.join(nodes.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("few")))
    per_node = (nodes.select("id", "n").join(comps.withColumnRenamed("node", "id"), "id", "left")
                .join(many, "id", "left").join(few, "id", "left")
                .select(F.col("id").alias("node"), "n", F.coalesce("component", "id").alias("component_id"),
                        (F.coalesce("links", "few", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")))
    per_node = written(per_node.withColumn("_n", F.col("n")).drop("n"), "node_links")
    found = join_back(members, per_node, "node", "_n").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    found = found.dropDuplicates(["vec_id"])
    every = df.select(F.col(id_col).cast("long").alias("vec_id"))
    return every.join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
