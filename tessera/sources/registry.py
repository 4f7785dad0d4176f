"""Pluggable sources and text models."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sets import union_sources


@dataclass(frozen=True)
class Source:
    """A named reader of landed records; lower tiers come first."""

    name: str
    tier: int
    read: Callable[[SparkSession, str], DataFrame]


class SourceRegistry:
    """Sources by (tier, name); a load is the union of what they read."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def add(self, name: str, tier: int):
        def keep(read: Callable[[SparkSession, str], DataFrame]):
            self._sources[name] = Source(name, tier, read)
            return read

        return keep

    def ordered(self, requested: list[str] | None = None) -> list[Source]:
        chosen = [s for s in self._sources.values() if requested is None or s.name in requested]
        return sorted(chosen, key=lambda s: (s.tier, s.name))

    def load(self, spark: SparkSession, path: str, requested: list[str] | None = None) -> DataFrame:
        return union_sources([s.read(spark, path).withColumn("source", F.lit(s.name)) for s in self.ordered(requested)])


def hashing_embedder(dims: int = 384) -> Callable[[pd.Series], pd.Series]:
    """Deterministic text vectors: word counts hashed to ``dims`` buckets, scaled to unit length."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            v = np.zeros(dims, dtype=np.float32)
            for word in text.lower().split():
                v[zlib.crc32(word.encode()) % dims] += 1.0
            norm = float(np.linalg.norm(v))
            out.append(v / np.float32(norm) if norm else v)
        return pd.Series(out)

    return embed


#: Texts, and letters of texts, that a model gets at once: an Arrow batch holds up to 10,000 texts of any length.
PIECE_ROWS, PIECE_LETTERS = 256, 1 << 20


def scored(batches: Iterator[pd.Series], make_model: Callable[[], Callable[[pd.Series], pd.Series]]) -> Iterator[pd.Series]:
    """The results of one model for all batches, a piece at a time, so that a task never holds those of a whole batch."""
    model = make_model()
    for batch in batches:
        if batch.empty:
            yield model(batch)
        ends = batch.str.len().fillna(0).cumsum().to_numpy()
        at = 0
        while at < len(batch):
            so_far = ends[at - 1] if at else 0
            end = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(ends, so_far + PIECE_LETTERS, side="right"))))
            yield model(batch.iloc[at:end])
            at = end


def score_text(
    column: Column | str, make_model: Callable[[], Callable[[pd.Series], pd.Series]] = hashing_embedder, returns: str = "array<float>"
) -> Column:
    """Apply a text model to a column in pieces of Arrow batches; the model is made once per task."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return scored(batches, make_model)

    return run(column)
