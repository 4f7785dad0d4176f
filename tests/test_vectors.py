"""Blocks of vectors: the best n of a row, and what a task holds."""
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tessera.operators import vectors


def test_best_columns_are_those_of_a_stable_sort():
    rng = np.random.default_rng(5)
    score = np.round(rng.normal(size=(300, 40)), 1)
    score[rng.random(score.shape) < 0.2] = -np.inf
    for n in (1, 5, 39, 40, 50):
        assert (vectors._best(score, n) == np.argsort(-score, axis=1, kind="stable")[:, :n]).all()


@pytest.mark.parametrize("job", ["top_similar", "vector_duplicates"])
def test_a_block_pair_is_multiplied_in_strips(spark, monkeypatch, job):
    """Products of two blocks of 4,096 vectors take 134 MB; a task holds a strip of them."""
    held = {}

    class Pairs:
        def applyInPandas(self, block, schema):
            held["block"] = block
            raise StopIteration

    monkeypatch.setattr(vectors, "_blocked", lambda left, right: Pairs())
    with pytest.raises(StopIteration):
        table = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
        vectors.top_similar(table, table, 10, True) if job == "top_similar" else vectors.vector_duplicates(table)
    vecs = list(np.random.default_rng(1).normal(size=(4096, 16)))
    left, right = pd.DataFrame({"id": range(4096), "vec": vecs}), pd.DataFrame({"right_id": range(4096), "right_vec": vecs})
    tracemalloc.start()
    held["block"](left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_scoring_texts_holds_the_vectors_of_a_piece_only(spark):
    """Before, a batch of 10,000 texts became lists of Python numbers, more than 100 MB of them."""
    from tessera.sources import registry

    texts = pd.Series([f"word {i} of many" for i in range(4000)] + [None, ""])
    registry.hashing_embedder()(texts[:10])
    tracemalloc.start()
    sizes = [len(part) for part in registry.scored(iter([texts]), registry.hashing_embedder)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(texts) and max(sizes) <= registry.PIECE_ROWS and peak < 5e6
    long = pd.Series(["x" * registry.PIECE_LETTERS] * 3 + ["y", "z"])
    assert [len(part) for part in registry.scored(iter([long]), lambda: lambda s: s)] == [1, 1, 1, 2]
    rows = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, concat('a b ', id, ' a')) as text").coalesce(2)
    for row in rows.select("id", "text", registry.score_text("text").alias("v")).collect():
        want = registry.hashing_embedder()(pd.Series([row.text]))[0]
        assert np.allclose(row.v, want) and len(row.v) == 384
