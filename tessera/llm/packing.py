"""Cost-balanced packing of documents into sequences of fixed token capacity.

A sequence costs, for each of its pieces of n ids, ``linear * n + quadratic * n * n`` (attention stays inside a piece).
Pieces go in descending order of length to the cheapest sequence that still has room. Every task packs the documents it
reads, in windows of bounded size: nothing is shuffled, and the padding is less than one sequence a window.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ready
from tessera.llm.tokens import END_ID, encoder

#: Cost of a token and of a pair of tokens: a layer's matrices against its attention, for a model width of 1024.
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
#: Ids that one window holds before it is packed.
WINDOW = 1 << 20

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
)


def pack(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple]]:
    """Sequences as lists of (item, start, length); items longer than ``capacity`` are cut into full sequences first.

    The rest goes, longest first (ties: earlier item first), to the cheapest sequence with room for all of it. If none
    has, it is cut over the sequences with most room. There are as many sequences as the ids need at least, so less
    than one capacity stays unused; every id is placed once, and items without ids give nothing.
    """
    full, rest = [], []
    for item, n in enumerate(lengths):
        whole = n // capacity
        full += [[(item, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            rest.append((n % capacity, item, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(r[0] for r in rest) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    open_: list[list[tuple]] = [[] for _ in range(count)]

    def put(k: int, item: int, start: int, n: int) -> None:
        open_[k].append((item, start, n))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n

    for n, item, start in rest:
        while n:
            fits = np.flatnonzero(room >= n)
            k = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(n, int(room[k]))
            put(k, item, start, part)
            n, start = n - part, start + part
    return full + open_


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, linear: float = LINEAR, quadratic: float = QUADRATIC, window: int = WINDOW
) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, cost.

    ``docs`` needs ``doc_id`` and ``text``; a document is its ids and the end id, null counts as empty, repeated rows are
    packed each by itself, null doc_ids stay null. ``vocabulary`` is a file of the tokenizers library. ``cost`` is the
    estimated cost of the whole sequence. A table without rows gives no pieces.
    """
    ready(docs.sparkSession)

    def flush(number: int, ids: list, blobs: list[bytes]) -> tuple[int, pa.RecordBatch | None]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost")}
        for sequence in pack([len(b) // 4 for b in blobs], capacity, linear, quadratic):
            offset, cost = 0, sum(linear * n + quadratic * n * n for _, _, n in sequence)
            for item, start, n in sequence:
                blob = blobs[item]
                for k, v in zip(out, (ids[item], start, n, blob[4 * start : 4 * (start + n)], len(blob) // 4, number, offset, cost)):
                    out[k].append(v)
                offset += n
            number += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return number, pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = END_ID.to_bytes(4, "little")
        ids, blobs, held, number = [], [], 0, None
        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "text"))):
                number = part << 36 if number is None else number
                blob = encode(text) + end
                ids.append(doc_id)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= window:
                    number, out = flush(number, ids, blobs)
                    yield out
                    ids, blobs, held = [], [], 0
        if blobs:
            yield flush(number, ids, blobs)[1]

    return docs.select("doc_id", "text", F.spark_partition_id().alias("_part")).mapInArrow(run, PIECES)
