import math
import os

import numpy as np
import pyarrow.dataset as ds
import pytest

from tessera.llm import vector_dups as vd

KINDS = "vec_id long, embedding array<double>, label int, node string, weight string, vector string"


def slow(ids, vectors, least):
    """vec_id, links, component, kept from all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    links = [[] for _ in ids]
    for size in {len(v) for v, o in zip(vectors, ok) if o}:
        at = [i for i, v in enumerate(vectors) if ok[i] and len(v) == size]
        x = np.array([vectors[i] for i in at], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for r in range(0, len(at), 1000):
            for i, j in zip(*np.nonzero(x[r : r + 1000] @ x.T >= least)):
                if i + r != j:
                    links[at[i + r]].append(at[j])
    out, seen = [None] * len(ids), set()
    for i in range(len(ids)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            fresh = set(links[stack.pop()]) - group
            group |= fresh
            stack += fresh
        seen |= group
        name = min((ids[k] for k in group if ids[k] is not None), default=None)
        for k in group:
            out[k] = (ids[k], len(links[k]), name, ids[k] == name)
    return sorted(out, key=str)


def got(spark, ids, vectors, **more):
    rows = [(i, v, 1, "a", "b", "c") for i, v in zip(ids, vectors)]
    return sorted((tuple(r) for r in vd.near_duplicate_vectors(spark.createDataFrame(rows, KINDS), **more).collect()), key=str)


def turned(r, x, cosine):
    """Unit vectors at the given cosine to x."""
    y = r.normal(size=x.shape)
    y -= (y * x).sum() * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y)


def cloud(r, n, d, cosine):
    x = r.normal(size=d)
    x /= np.linalg.norm(x)
    return [turned(r, x, cosine) for _ in range(n)]


@pytest.mark.parametrize("size", [3, 100])
def test_links_against_all_pairs(spark, size):
    """Tight and loose clouds, chains, copies and scaled copies around the bound."""
    r = np.random.default_rng(size)
    vectors = [v for c in (0.9999, 0.99, 0.985, 0.976, 0.97, 0.96) for v in cloud(r, 40, size, c)]
    x = cloud(r, 1, size, 1.0)[0]
    for _ in range(30):
        vectors.append(x)
        x = turned(r, x, 0.955)
    vectors += [v for v in r.normal(size=(200, size))]
    vectors += [vectors[3]] * 5 + [7.5 * vectors[4], 1e200 * vectors[4], -vectors[4], 1e-200 * vectors[200]]
    vectors = [[float(c) for c in v] for v in vectors]
    ids = [int(i) for i in r.permutation(len(vectors))]
    assert got(spark, ids, vectors) == slow(ids, vectors, 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [-0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0, 0.0], [1.0], [5.0], [-1.0], [1.0, 1.01], [1.0, 1.0], [3.0, -3.0], [3.0, -3.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 8, 7, 9, 10, 11, 12, 13, 14, None, None, None]
    ids, vectors = ids + [0, 8, None], vectors + [None, [1.0, 1.0], None]
    assert got(spark, ids, vectors) == slow(ids, vectors, 0.95)
    assert got(spark, ids, vectors, least=0.5) == slow(ids, vectors, 0.5)
    assert vd.near_duplicate_vectors(spark.createDataFrame([], KINDS)).collect() == []


def test_a_dense_cloud_makes_no_pairs(spark):
    """2,000 near copies: balls, not pairs, are compared."""
    r = np.random.default_rng(1)
    vectors = [[float(c) for c in v] for v in cloud(r, 2000, 64, 0.999)]
    counted = []
    plain = vd.angles
    try:
        vd.angles = lambda pairs, nodes: counted.append(pairs.count()) or plain(pairs, nodes)
        assert got(spark, list(range(2000)), vectors) == slow(list(range(2000)), vectors, 0.95)
    finally:
        vd.angles = plain
    assert sum(counted) < 40_000


def test_recall_at_the_bound(spark):
    """Pairs at a cosine of just over 0.95, the hardest to find, share a bucket."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([turned(r, v, 0.9501) for v in x])
    a, b = vd.buckets(x), vd.buckets(y)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    assert met.mean() > 0.999


def test_hadamard_is_orthogonal():
    h = vd.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="no such table here")
def test_recall_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    rows = ds.dataset("/root/testdata/check_s/embeddings.parquet").to_table()
    want = {r[0]: r for r in slow(rows["vec_id"].to_pylist(), rows["embedding"].to_pylist(), 0.95)}
    found = {r.vec_id: tuple(r) for r in vd.near_duplicate_vectors(table).collect()}
    assert found.keys() == want.keys()
    assert sum(r[1] for r in found.values()) >= 0.999 * sum(r[1] for r in want.values())
    assert sum(found[i] != want[i] for i in want) <= 10
