"""Similarity over dense vectors: blocked matrix products with partial results per block."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import top_n_per

BLOCK_ROWS = 16384  # a vector is sent once to each block of the other side, so few large blocks move least
SPREAD = 4  # smaller tables still make this many blocks, if they hold a quarter of BLOCK_ROWS each
STRIP_ROWS = 256  # left rows of a block whose products are held at once


def cosine(a: str, b: str):
    """Cosine of two array columns; 0 where lengths differ or a norm is 0."""
    x, y = F.col(a), F.col(b)

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(total(F.transform(x, lambda p: p.cast("double") * p))) * F.sqrt(
        total(F.transform(y, lambda q: q.cast("double") * q))
    )
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot / norm).otherwise(F.lit(0.0))


def pair_cosine(pairs: DataFrame, a: str = "a_vec", b: str = "b_vec") -> DataFrame:
    return pairs.withColumn("similarity", cosine(a, b))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _strips(left: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit rows) of a left block, a strip at a time, so that a task never holds the products of a whole block pair."""
    for at in range(0, len(left), STRIP_ROWS):
        strip = left.iloc[at : at + STRIP_ROWS]
        yield strip["id"].to_numpy(), _unit_rows(strip["vec"])


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` highest scores of every row, highest first, the earlier column on ties, without sorting whole rows."""
    rows, width = score.shape
    if width <= n:
        return np.argsort(-score, axis=1, kind="stable")
    least = np.partition(score, width - n, axis=1)[:, width - n, None]
    above = score > least
    # all above the n-th score, and of those equal to it the first ones, as many as are missing
    level = score == least
    missing = n - above.sum(axis=1)
    surplus = level.sum(axis=1) > missing
    if surplus.any():
        level[surplus] &= np.cumsum(level[surplus], axis=1) <= missing[surplus, None]
    best = np.nonzero(above | level)[1].reshape(rows, n)
    order = np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1)


def _block_count(df: DataFrame) -> int:
    rows = df.count()
    return max(1, math.ceil(rows / BLOCK_ROWS), min(SPREAD, math.ceil(SPREAD * rows / BLOCK_ROWS)))


def _blocked(left: DataFrame, right: DataFrame):
    """Every left block paired with every right block: groups of bounded size, keyed (lb, rb)."""
    n_left, n_right = _block_count(left), _block_count(right)
    own_l = F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")
    own_r = F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")
    l = left.select("id", "vec", own_l.alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("rb"))
    r = right.select(
        F.col("id").alias("right_id"), F.col("vec").alias("right_vec"), own_r.alias("own_rb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("other_lb"),
    )
    return l.groupBy("lb", "rb").cogroup(r.groupBy("other_lb", "own_rb"))


def top_similar(queries: DataFrame, vectors: DataFrame, n: int, skip_self: bool) -> DataFrame:
    """(query_id, match_id, similarity, rank): the ``n`` most similar vectors of every query.

    Similarity is rounded to three decimals before ranking; ties go to the smaller id. A block pair
    yields at most ``n`` rows per query, so the full table of pairs is never written.
    """

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "match_id": [], "similarity": []}).astype(
                {"query_id": "int64", "match_id": "int64", "similarity": "float64"}
            )
        right = right.sort_values("right_id")
        ids, other = right["right_id"].to_numpy(), _unit_rows(right["right_vec"]).T
        parts = []
        for own, unit in _strips(left):
            score = unit @ other
            score *= 1000
            score += 0.5
            np.floor(score, out=score)
            score /= 1000
            score[np.isnan(score)] = -np.inf
            if skip_self:
                score[own[:, None] == ids[None, :]] = -np.inf
            best = _best(score, n)
            out = pd.DataFrame(
                {
                    "query_id": np.repeat(own, best.shape[1]),
                    "match_id": ids[best].ravel(),
                    "similarity": np.take_along_axis(score, best, axis=1).ravel(),
                }
            )
            parts.append(out[np.isfinite(out["similarity"])])
        return pd.concat(parts)

    partial = _blocked(queries, vectors).applyInPandas(block, "query_id long, match_id long, similarity double")
    return top_n_per(partial, ["query_id"], [F.desc("similarity"), F.asc("match_id")], n, rank="rank")


def similar_companies(vectors: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most similar other companies of every company. ``vectors`` has (id, vec)."""
    return top_similar(vectors, vectors, n, skip_self=True)


def semantic_search(queries: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best companies for every query vector."""
    return top_similar(queries, vectors, n, skip_self=False)


def vector_duplicates(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(id, duplicate_of): the first earlier vector with cosine at or above ``threshold``.

    Equal vectors are folded into one before comparing, and one row per vector comes out, so a large
    group of copies is neither compared with itself nor written out in pairs.
    """
    folded = vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "first": []}).astype("int64")
        right = right.sort_values("right_id")
        ids, other = right["right_id"].to_numpy(), _unit_rows(right["right_vec"]).T
        parts = []
        for own, unit in _strips(left):
            near = unit @ other >= threshold
            hit = near.any(axis=1)
            # ids ascend, so the first hit is the smallest one
            parts.append(pd.DataFrame({"id": own[hit], "first": ids[near[hit].argmax(axis=1)]}))
        return pd.concat(parts)

    firsts = _blocked(folded, folded).applyInPandas(block, "id long, first long").groupBy("id").agg(F.min("first").alias("first"))
    # a unit vector may fall a rounding step short of 1 with itself, so its own id is added back
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    labelled = folded.withColumn("norm", norm).join(firsts, "id", "left").select(
        "vec", F.when(F.col("norm") > 0, F.least("id", "first")).alias("first")
    )
    return vectors.join(labelled, "vec").filter("first < id").select("id", F.col("first").alias("duplicate_of"))
