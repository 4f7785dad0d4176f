"""Near duplicates among vectors by cross-polytope hashing (Andoni et al., 2015) with fast Hadamard rotations and multiprobe.

A vector is filled up to a power of two and rotated three times (random signs, then a Hadamard transform); its hash is the
nearest signed axis. A table joins FUNCTIONS such hashes to one bucket; besides its own bucket a vector looks into the PROBES
buckets that the smallest further turns would give. Vectors that meet in a bucket are candidates, and every link is proven.

Links are counted without a row for each pair of a dense group. Equal vectors are one node. A node that lies within half the
angle of a bucket's first node joins the ball around it, and all nodes of a ball are linked with each other: angles are a
metric. Balls that meet in a bucket are compared by their centres: within the angle less both radii all their nodes are linked,
beyond the angle plus both radii none. Only where neither holds, the nodes of one are compared with the centre of the other, and
only where that leaves it open, node by node.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, pair_hashes, ready, written
from tessera.operators.graphs import connected_components

#: At a cosine of 0.95 a table finds 93, 74 and 63 percent of the pairs of 8, 64 and 256 components; eight tables miss 1 in 50,000
#: of 64. A bucket is one of (2 x components)^FUNCTIONS, which should be no fewer than the vectors.
TABLES, FUNCTIONS, PROBES, RANKS = 8, 3, 8, 3
#: Angles (radians) closer than this to a bound count as undecided, as arccos of a rounded cosine is this exact at least.
SLACK = 1e-6
#: Components worked on at a time.
PIECE = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the Hadamard matrix of its length (a power of two), over the square root of the length."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        a, b = pairs[:, :, :1], pairs[:, :, 1:]
        x = np.concatenate([a + b, a - b], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 42) -> np.ndarray:
    """For unit rows: int64 of shape (rows, tables, 1 + probes), the own bucket first."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, functions, 3, size))
    ranks = min(RANKS, size)
    turns = np.array(list(itertools.product(range(ranks), repeat=functions)))
    taken = min(1 + probes, len(turns))
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        cost, axes = 0.0, []
        for j in range(functions):
            y = x
            for s in signs[t, j]:
                y = hadamard(y * s)
            far = np.abs(y)
            top = np.argsort(-far, axis=1, kind="stable")[:, :ranks]
            reach = np.take_along_axis(far, top, 1)
            axes.append((2 * top + (np.take_along_axis(y, top, 1) < 0)).astype(np.uint64)[:, turns[:, j]])
            cost = cost + ((reach[:, :1] - reach) ** 2)[:, turns[:, j]]
        key = np.full(axes[0].shape, mix(np.array([t + 1 + (size << 8)], np.uint64))[0])
        for a in axes:
            key = pair_hashes(key, a)
        nearest = np.argsort(cost, axis=1, kind="stable")[:, :taken]
        keys = np.take_along_axis(key, nearest, 1).view(np.int64)
        out[:, t, :taken] = keys
        out[:, t, taken:] = keys[:, :1]
    return out


def units(lists: list, size: int) -> np.ndarray:
    """Rows of length one, as doubles; scaled first, so that no square overflows."""
    x = np.array(lists, np.float64).reshape(len(lists), size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(lists: list, extra: int = 1) -> Iterator[tuple[np.ndarray, int]]:
    """(places, length) of the vectors of each length, a bounded number of components at a time."""
    lengths = np.array([len(v) for v in lists], np.int64)
    for size in np.unique(lengths):
        places = np.flatnonzero(lengths == size)
        step = max(1, PIECE // (int(size) * extra))
        for i in range(0, len(places), step):
            yield places[i : i + step], int(size)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    # null or empty vectors and null components give false or null
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _bucket_rows(nodes: DataFrame, tables: int, functions: int, probes: int, seed: int) -> DataFrame:
    """node, key, own: the buckets of every node, its own ones marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vectors = batch.column("node").to_numpy(), batch.column("vector").to_pylist()
            for places, size in _by_length(vectors, 4):
                keys = buckets(units([vectors[i] for i in places], size), tables, functions, probes, seed)
                # vectors of other lengths never meet
                keys = pair_hashes(keys.view(np.uint64), np.full(keys.shape, size, np.uint64)).view(np.int64)
                own = np.zeros(keys.shape, bool)
                own[:, :, 0] = True
                owner = np.repeat(node[places], keys[0].size)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys.ravel()), pa.array(own.ravel())], names=["node", "key", "own"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, key long, own boolean").distinct()


def angles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b and longs or doubles besides) with ``cosine`` and ``angle``; null where the lengths differ.

    The cosine of a pair is worked out in double precision and the same whichever comes first.
    """
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("vector_a").to_pylist(), batch.column("vector_b").to_pylist()
            cosine = np.full(len(va), np.nan)
            for places, size in _by_length(va):
                places = np.array([i for i in places if len(vb[i]) == size], np.int64)
                if len(places):
                    cosine[places] = (units([va[i] for i in places], size) * units([vb[i] for i in places], size)).sum(axis=1)
            gone = np.isnan(cosine)
            turn = np.arccos(np.clip(cosine, -1.0, 1.0))
            more = [pa.array(cosine, pa.float64(), mask=gone), pa.array(turn, pa.float64(), mask=gone)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, "cosine", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("vector").alias(f"vector_{x}")), x)
    return pairs.select(*kept, "vector_a", "vector_b").mapInArrow(run, f"{kinds}, cosine double, angle double")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _balls(nodes: DataFrame, rows: DataFrame, angle: float) -> DataFrame:
    """node, ball, off: the centre that a node belongs to (a node; perhaps in another ball), and its angle to it."""
    first = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key", "first")
    tries = rows.join(first, "key").filter("node <> first").select(F.col("node").alias("b"), F.col("first").alias("a")).distinct()
    near = angles(tries, nodes).filter(F.col("angle") <= angle / 2 - SLACK)
    best = near.groupBy("b").agg(F.min(F.struct("a", "angle")).alias("best"))
    return written(
        nodes.join(best, F.col("node") == F.col("b"), "left").select(
            "node", "weight", F.coalesce("best.a", "node").alias("ball"), F.coalesce("best.angle", F.lit(0.0)).alias("off")
        )
    )


def node_links(nodes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """node, links, component for ``nodes`` (node, vector, weight) and their buckets ``rows`` (node, key, own).

    ``links`` counts the rows behind all nodes linked with a node, those behind the node itself included.
    """
    angle = math.acos(least)
    members = _balls(nodes, rows, angle)
    balls = written(
        members.groupBy("ball").agg(F.sum("weight").alias("weight"), F.max("off").alias("radius"), F.count(F.lit(1)).alias("size"))
    )
    # balls that meet in a bucket of one of them
    met = rows.join(members.select("node", "ball"), "node").groupBy("key", "ball").agg(F.max("own").alias("own"))
    met = written(met)
    several = met.groupBy("key").agg(F.min("ball").alias("low"), F.max("ball").alias("high"), F.max("own").alias("any"))
    several = several.filter("low <> high and any").select("key")
    met = met.join(several, "key")
    pairs = met.filter("own").select("key", F.col("ball").alias("x")).join(met.select("key", F.col("ball").alias("y")), "key")
    pairs = pairs.filter("x <> y").select(*_ordered("x", "y")).distinct()
    seen = angles(pairs, nodes)
    for x in "ab":
        ends = balls.select(F.col("ball").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("weight", "radius", "size")))
        seen = seen.join(ends, x)
    reach = F.col("radius_a") + F.col("radius_b")
    seen = seen.filter(F.col("angle") - reach <= angle + SLACK)
    seen = written(seen.withColumn("all", F.col("angle") + reach <= angle - SLACK))
    whole = seen.filter("all")
    ball_gain = whole.select(F.col("a").alias("ball"), F.col("weight_b").alias("gain")).unionByName(
        whole.select(F.col("b").alias("ball"), F.col("weight_a").alias("gain"))
    )
    edges = whole.select("a", "b")

    # undecided: the nodes of the larger ball against the centre of the other one
    open_ = seen.filter("not all")
    a_first = F.col("size_a") >= F.col("size_b")
    open_ = open_.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("ball"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(a_first, F.col("radius_b")).otherwise(F.col("radius_a")).alias("radius"))
    single = open_.join(members.select("ball", "node", "weight"), "ball")
    single = angles(single.select(F.col("node").alias("a"), F.col("other").alias("b"), "ball", "weight", "radius"), nodes)
    single = single.filter(F.col("angle") - F.col("radius") <= angle + SLACK)
    single = written(single.withColumn("all", F.col("angle") + F.col("radius") <= angle - SLACK))
    met_all = single.filter("all")
    node_gain = met_all.join(balls.select(F.col("ball").alias("b"), F.col("weight").alias("gain")), "b").select(F.col("a").alias("node"), "gain")
    ball_gain = ball_gain.unionByName(met_all.select(F.col("b").alias("ball"), F.col("weight").alias("gain")))
    edges = edges.unionByName(met_all.select(F.col("ball").alias("a"), "b"))

    # still undecided: node against node
    left = single.filter("not all").select(F.col("a").alias("x"), F.col("ball").alias("ball_x"), F.col("weight").alias("weight_x"), F.col("b").alias("ball"))
    last = left.join(members.select("ball", F.col("node").alias("y"), F.col("weight").alias("weight_y")), "ball").filter("x <> y")
    last = angles(last.select(F.col("x").alias("a"), F.col("y").alias("b"), "ball_x", F.col("ball").alias("ball_y"), "weight_x", "weight_y"), nodes)
    last = written(last.filter(F.col("cosine") >= least))
    node_gain = node_gain.unionByName(last.select(F.col("a").alias("node"), F.col("weight_y").alias("gain")))
    node_gain = node_gain.unionByName(last.select(F.col("b").alias("node"), F.col("weight_x").alias("gain")))
    edges = edges.unionByName(last.select(F.col("ball_x").alias("a"), F.col("ball_y").alias("b")))

    parts = connected_components(balls.select(F.col("ball").alias("node")), edges.select("a", "b").distinct())
    ball_gain = ball_gain.groupBy("ball").agg(F.sum("gain").alias("ball_gain"))
    node_gain = node_gain.groupBy("node").agg(F.sum("gain").alias("node_gain"))
    known = balls.select("ball", F.col("weight").alias("inside")).join(ball_gain, "ball", "left")
    known = known.join(parts.select(F.col("node").alias("ball"), "component"), "ball")
    links = F.col("inside") + F.coalesce("ball_gain", F.lit(0)) + F.coalesce("node_gain", F.lit(0))
    return members.select("node", "ball").join(known, "ball").join(node_gain, "node", "left").select("node", links.alias("links"), "component")


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.95, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 42
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``, which needs ``vec_id`` and ``embedding``.

    Rows are linked if the cosine of their vectors, in double precision, is ``least`` or more and their balls share a bucket;
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable by links, itself included.
    Vectors that are null, empty or zero, or hold null or non-finite components, are linked with nothing, and vectors of
    different lengths are not linked. Rows with equal vectors are linked, also with equal or null vec_ids; a component without
    any vec_id has none. kept: vec_id is component_id (so repeated rows are kept alike; null vec_ids are kept only where the
    component has no vec_id). Other columns stay out, so names cannot clash. An empty table gives no rows.
    """
    if not 0 < least < 1:
        raise ValueError("the least cosine lies between 0 and 1")
    ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    groups = rows.filter(usable(F.col("vector"))).groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("vec_id"))
    nodes = written(groups.select(F.monotonically_increasing_id().alias("node"), "*"))
    found = written(node_links(nodes, written(_bucket_rows(nodes, tables, functions, probes, seed)), least))
    smallest = found.join(nodes.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = nodes.select("node", F.col("vector").alias("_vector")).join(found, "node").join(smallest, "component")
    known = known.select("_vector", "links", "component_id")
    joined = rows.join(known, F.col("vector") == F.col("_vector"), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
