"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its words; a document is toxic if any sentence is: 1 - product(1 - p)
(noisy-or with a small constant leak; sentences without a weighted word don't count). Weights are fitted to document labels alone, and then point at the sentences that make a document toxic. Words
are runs of letters and digits, lower-case A-Z; they and their beginnings are hashed to a fixed number of features; sentences
end at ``. ! ?`` or a line break.

The fit uses a bounded sample of labelled rows (SAMPLE documents, those with the smallest hash of doc_id); scoring reads whole
texts of all rows, in one pass without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_MARK, LOWER_ASCII, byte_lists, mix, ready, slices, text_bounds, words_in, written

#: Bits of a feature; labelled documents to learn from at most; documents a feature must occur in; standard deviations by which it
#: must be more frequent in toxic documents; steps; strength of the L1 penalty; beginnings of words, in bytes, that are features too.
FEATURE_BITS, SAMPLE, LEAST_DOCUMENTS, EVIDENCE, STEPS, PENALTY = 20, 12000, 3, 2.5, 150, 1e-4
PREFIXES = (4, 5, 6)
FEATURES = 1 << FEATURE_BITS  # the weight after the last feature is that of nothing, the one after that the bias
PRIOR = -6.0
THRESHOLD = 0.3
_IS_END = np.zeros(256, bool)
_IS_END[list(b".!?\n")] = True


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, word_bounds, doc_bounds, starts): words of sentence s are rows word_bounds[s] to word_bounds[s + 1] of features
    (a word and its beginnings), sentences of text i are doc_bounds[i] to doc_bounds[i + 1], and ``starts`` are the byte places of sentences in their text.

    Sentences have at least one word; a text without words has no sentence.
    """
    data = b" ".join(texts).translate(LOWER_ASCII)
    at, h = words_in(data, IS_MARK, PREFIXES)
    ends = np.cumsum(_IS_END[np.frombuffer(data, np.uint8)]) if data else np.zeros(0, np.int64)
    bounds = text_bounds(texts)
    doc = np.searchsorted(bounds, at, "right") - 1
    number = ends[at] if len(at) else ends
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(number) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    salt = np.arange(1 + len(PREFIXES), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    features = np.where(h == 0, FEATURES, (mix(h + salt) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)).astype(np.int32)
    doc_bounds = np.searchsorted(doc[first], np.arange(len(texts) + 1))
    return features, np.concatenate([first, [len(at)]]), doc_bounds, at[first] - bounds[doc[first]]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights of all features and, last, the bias: Adam steps on the noisy-or likelihood, with soft thresholding."""
    y, n, width = labels.astype(bool), len(texts), 1 + len(PREFIXES)
    with_, without = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.int64)
    for begin in range(0, n, 500):
        features, words, docs, _ = sentences(texts[begin : begin + 500])
        owner = np.repeat(np.arange(len(docs) - 1), np.diff(words[docs]) * width)
        once = np.unique(owner * (FEATURES + 1) + features.ravel())
        column, toxic = once % (FEATURES + 1), y[begin : begin + 500][once // (FEATURES + 1)]
        with_ += np.bincount(column[toxic], minlength=FEATURES + 1)
        without += np.bincount(column[~toxic], minlength=FEATURES + 1)
    share = (with_ + without) / n
    sure = with_ / max(1, y.sum()) - without / max(1, (~y).sum())
    spread = np.sqrt(share * (1 - share) * (1 / max(1, y.sum()) + 1 / max(1, (~y).sum())) + 1e-12)
    used = np.flatnonzero((with_ + without >= LEAST_DOCUMENTS) & (sure >= EVIDENCE * spread))
    used = used[used < FEATURES]
    compact = np.full(FEATURES + 1, len(used), np.int32)
    compact[used] = np.arange(len(used))
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, n, 500):
        features, words, docs, _ = sentences(texts[begin : begin + 500])
        told = compact[features]
        says = (told < len(used)).any(axis=1)  # words that say something
        kept.append((told[says], np.diff(np.concatenate([[0], np.cumsum(says)])[words]), np.diff(docs)))
    columns, lengths, per_doc = (np.concatenate(x) for x in zip(*kept))
    words, docs = (np.concatenate([[0], np.cumsum(x)]) for x in (lengths, per_doc))
    w, bias = np.zeros(len(used) + 1), PRIOR
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.clip(_sums(w[columns].sum(axis=1), words) + bias, -40, 40)
        p = np.where(lengths > 0, 1 / (1 + np.exp(-z)), 0)
        leak = 1 / (1 + np.exp(-bias))
        total = _sums(np.where(lengths > 0, np.logaddexp(0, z), 0), docs) + np.logaddexp(0, bias)
        slope = np.where(y, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = p * np.repeat(slope, np.diff(docs)) / n
        grad = np.bincount(columns.ravel(), np.repeat(g, lengths * width), len(used) + 1)
        rate = 0.15 if step < steps * 2 // 3 else 0.04
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        tilt = g.sum() + leak * slope.mean()
        mb, vb = 0.9 * mb + 0.1 * tilt, 0.99 * vb + 0.01 * tilt**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        scale = rate / (np.sqrt(v / c2) + 1e-5)
        w = w - scale * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - scale * penalty, 0)
        w[-1] = 0
        bias -= rate / (np.sqrt(vb / c2) + 1e-5) * mb / c1
    out = np.zeros(FEATURES + 2, np.float32)
    out[used], out[-1] = w[:-1], bias
    return out


def score(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document scores, sentence probabilities, doc_bounds, sentence starts).

    A sentence without any weighted word has probability 0, so that length alone makes nothing toxic; every text has a small
    constant probability (the leak of the noisy-or), which is all that a text without words has.
    """
    features, words, docs, starts = sentences(texts)
    told = weights[features]
    z = np.clip(_sums(told.sum(axis=1, dtype=np.float64), words) + float(weights[-1]), -40, 40)
    says = np.diff(np.concatenate([[0], np.cumsum((told != 0).any(axis=1))])[words]) > 0
    total = _sums(np.where(says, np.logaddexp(0, z), 0), docs) + np.logaddexp(0, float(weights[-1]))
    return np.clip(-np.expm1(-total), 0, 1), np.where(says, 1 / (1 + np.exp(-z)), 0), docs, starts


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the decimal doc_id is 2 modulo 4 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from a bounded sample of the labelled rows that are not held out.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic`` (null: not a label). If no label can be
    used, every score is that of the prior.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(sample)
    )
    chosen = written(chosen)  # at most ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        marks: list[int] = []
        for batch in batches:
            texts += byte_lists(batch)
            marks += batch.column("toxic").to_pylist()
        if texts:
            weights = fit(texts, np.array(marks))
            yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary())})

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).coalesce(1).mapInArrow(run, "weights binary").collect()
    if not found:
        out = np.zeros(FEATURES + 2, np.float32)
        out[-1] = PRIOR
        return out
    return np.frombuffer(found[0].weights, np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double), predicted (int) and offending (array of start, end, p: byte ranges of sentences).

    ``docs`` needs ``text``; other columns pass through, except ones with the three names, which are replaced. A sentence
    offends if its own probability reaches ``threshold``. Null, empty and blank texts get the constant score of no evidence.
    """
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(weights)  # one number a feature, whatever the corpus
    docs = docs.drop("score", "predicted", "offending")
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = byte_lists(batch)
            total, p, docs_at, starts = score(texts, model.value)
            spans: list[list] = [[] for _ in texts]
            of = np.searchsorted(docs_at, np.arange(len(p)), "right") - 1
            for k in np.flatnonzero(p >= threshold):
                end = starts[k + 1] if k + 1 < docs_at[of[k] + 1] else len(texts[of[k]])
                spans[of[k]].append({"start": int(starts[k]), "end": int(end), "p": float(p[k])})
            columns = [*batch.columns, pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.array(spans, found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted", "offending"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int, offending array<struct<start: bigint, end: bigint, p: double>>")
