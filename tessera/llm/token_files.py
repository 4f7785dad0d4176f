"""Token ids of a corpus in grammar-compressed shards (Re-Pair), in ascending doc_id order, with random access.

A shard holds whole documents. Frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), round by
round; the end id never enters a pair, so no symbol spans documents. A shard stores its rules, the expansion length of each
rule, the remaining symbols and an index of its documents; any id range is decoded from the symbols that cover it.

Shards are rows of a Parquet table with a binary column ``shard``, so any store that Spark writes will do, lost tasks are
written again, and files appear only once complete. Bytes of a shard, all little-endian::

    "RPR1"  u32 documents  u32 rules  u32 symbols  u64 ids  u32 first nonterminal  u8 bits a symbol
    rules    2 x u32 each: left and right symbol; rule k is symbol first nonterminal + k
    lengths  u32 each: ids that a rule stands for
    index    documents x (u8 has_id, i64 doc_id, u32 symbols, u32 ids)
    symbols  packed with ``bits`` bits each, low bit first
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ready, slots
from tessera.llm.tokens import END_ID, encoder

MAGIC = b"RPR1"
HEADER = struct.Struct("<4sIIIQIB")
INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("symbols", "<u4"), ("ids", "<u4")])
#: Ids of a shard; occurrences that make a pair frequent; pairs replaced in a round; rounds.
SHARD_IDS, FREQUENT, PAIRS, ROUNDS = 1 << 20, 6, 4096, 7


SLOTS = 17  # bits of the table that tells which neighbours may be a pair to replace; it stays in a core's cache


def _apart(keys: np.ndarray) -> np.ndarray:
    """The pairs, most frequent first, that can be replaced at once: no symbol is a left part of one and a right part of another."""
    left, right, out = set(), set(), []
    for key in keys.tolist():
        a, b = key >> 32, key & 0xFFFFFFFF
        if a == b and a not in left and a not in right or a != b and a not in right and b not in left:
            left.add(a)
            right.add(b)
            out.append(key)
    return np.array(out, np.uint64)


def _frequent(keys: np.ndarray, end: int, least: int) -> np.ndarray:
    """Frequent pairs, most frequent first."""
    keys = np.sort(keys)
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
    counts = np.diff(ends, prepend=-1)
    often = np.flatnonzero(counts >= least)
    some, counts = keys[ends[often]], counts[often]
    ok = (some >> np.uint64(32) != end) & (some & np.uint64(0xFFFFFFFF) != end)
    return some[ok][np.argsort(-counts[ok], kind="stable")[:PAIRS]]


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOTS)


def compress(ids: np.ndarray, first: int, end: int = END_ID, least: int = FREQUENT, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k, a row (left, right), is symbol ``first + k``; ids must be below ``first``."""
    seq, rules = ids.astype(np.uint32), [np.zeros(0, np.uint64)]
    base = first
    for _ in range(rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        pairs = _apart(_frequent(keys, end, least))
        if not len(pairs):
            break
        place = np.full(1 << SLOTS, -1, np.int16)
        own = _slot((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
        place[own[::-1]] = np.arange(len(pairs))[::-1]
        stays = place[own] == np.arange(len(pairs))  # of two pairs in one slot the rarer waits for the next round
        pairs, own = pairs[stays], own[stays]
        place[own] = np.arange(len(pairs))
        which = place[_slot(seq[:-1], seq[1:])]
        hit = np.flatnonzero(which >= 0)
        which = which[hit]
        right = pairs[which] == keys[hit]
        hit, which = hit[right], which[right]
        same = np.flatnonzero(seq[hit] == seq[hit + 1])
        if len(same):  # in a run of one symbol every second place
            at = hit[same]
            order = np.arange(len(at))
            begins = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, order, 0))
            stays = np.ones(len(hit), bool)
            stays[same[(order - begins) % 2 == 1]] = False
            hit, which = hit[stays], which[stays]
        seq[hit] = base + which.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        rules.append(pairs)
        base += len(pairs)
    flat = np.concatenate(rules)
    return seq.astype(np.int64), np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    out: list[int] = []
    size = lambda s: out[s - first] if s >= first else 1
    for a, b in rules.tolist():
        out.append(size(a) + size(b))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of the symbols."""
    big = symbols >= first
    held: list[np.ndarray] = []  # what each rule stands for
    if big.any():
        for a, b in rules.tolist():
            held.append(np.concatenate([held[a - first] if a >= first else [a], held[b - first] if b >= first else [b]]))
    width = np.ones(len(symbols), np.int64)
    source = np.arange(len(symbols))
    if held:
        sizes = np.array([len(h) for h in held], np.int64)
        width[big] = sizes[symbols[big] - first]
        source[big] = len(symbols) + (np.cumsum(sizes) - sizes)[symbols[big] - first]
    pool = np.concatenate([symbols, *held]).astype("<u4")
    ends = np.cumsum(width)
    return pool[np.repeat(source - (ends - width), width) + np.arange(int(width.sum()))]


def _pack(values: np.ndarray, bits: int) -> bytes:
    spread = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, bits: int, start: int, end: int) -> np.ndarray:
    low, high = start * bits // 8, -(-end * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, high - low, low), bitorder="little")
    spread = np.zeros((end - start, 32), np.uint8)
    spread[:, :bits] = flat[start * bits - low * 8 :][: (end - start) * bits].reshape(-1, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def write_shard(doc_ids: list[int | None], blobs: list[bytes]) -> bytes:
    """A shard of documents, each given as its ids (little-endian u32) that end with the end id."""
    ids = np.frombuffer(b"".join(blobs), "<u4")
    first = int(ids.max()) + 1
    symbols, rules = compress(ids, first)
    lengths = lengths_of(rules, first)
    index = np.zeros(len(blobs), INDEX)
    index["has_id"] = [d is not None for d in doc_ids]
    index["doc_id"] = [d or 0 for d in doc_ids]
    index["ids"] = [len(b) // 4 for b in blobs]
    ends = np.searchsorted(_starts(symbols, lengths, first), np.cumsum(index["ids"].astype(np.int64)))
    index["symbols"] = np.diff(np.concatenate([[0], ends]))
    bits = max(1, int(symbols.max()).bit_length())
    head = HEADER.pack(MAGIC, len(blobs), len(rules), len(symbols), len(ids), first, bits)
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + index.tobytes() + _pack(symbols, bits)


def _starts(symbols: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """Place of the first id of each symbol."""
    width = np.ones(len(symbols), np.int64)
    big = symbols >= first
    width[big] = lengths[symbols[big] - first]
    return np.cumsum(width) - width


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        magic, documents, rules, self.n_symbols, self.n_ids, self.first, self.bits = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(data, "<u4", rules, at + 8 * rules).astype(np.int64)
        self.index = np.frombuffer(data, INDEX, documents, at + 12 * rules)
        self.packed = data[at + 12 * rules + INDEX.itemsize * documents :]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order."""
        ids = expand(_unpack(self.packed, self.bits, 0, self.n_symbols), self.rules, self.first)
        at = 0
        for x in self.index:
            yield (int(x["doc_id"]) if x["has_id"] else None), ids[at : at + int(x["ids"])]
            at += int(x["ids"])

    def document(self, k: int) -> np.ndarray:
        """The ids of document k, from its own symbols alone."""
        start = int(self.index["symbols"][:k].sum())
        return expand(_unpack(self.packed, self.bits, start, start + int(self.index["symbols"][k])), self.rules, self.first)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high (without it) of the shard, from the symbols that cover them."""
        low, high = max(0, low), min(high, self.n_ids)
        if low >= high:
            return np.zeros(0, "<u4")
        symbols = _unpack(self.packed, self.bits, 0, self.n_symbols)
        starts = _starts(symbols, self.lengths, self.first)
        a, b = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high))
        return expand(symbols[a:b], self.rules, self.first)[low - int(starts[a]) :][: high - low]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, shard_ids: int = SHARD_IDS, tasks: int | None = None) -> None:
    """Writes the ids of all documents under ``path``: one row per shard with part, number, n_ids and the shard's bytes.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty; each document ends with the end id). Documents are in ascending
    doc_id order, nulls first, ties ordered by a hash of the text; repeated rows stay. An empty table gives an empty table.
    """
    spark = ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode, END_ID.to_bytes(4, "little")
        ids, blobs, held, number, part = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "number": pa.array([number], pa.int32()),
                    "n_ids": pa.array([held], pa.int64()),
                    "shard": pa.array([write_shard(ids, blobs)], pa.binary()),
                }
            )

        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "text"))):
                ids.append(doc_id)
                blobs.append(encode(text) + end)
                held += len(blobs[-1]) // 4
                if held >= shard_ids:
                    yield flush()
                    ids, blobs, held, number = [], [], 0, number + 1
        if blobs:
            yield flush()

    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(tasks or slots(spark), *order).sortWithinPartitions(*order)
    shards = ordered.select("doc_id", "text", F.spark_partition_id().alias("_part")).mapInArrow(
        run, "part int, number int, n_ids long, shard binary"
    )
    shards.write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32) of every document in the files."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column("begin").to_pylist(), batch.column("shard").to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in Shard(data).documents():
                    rows.append((doc_id, begin, len(ids), ids.tobytes()))
                    begin += len(ids)
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    shards = spark.read.schema("part int, number int, n_ids long, shard binary").parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_begin"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    begins = shards.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_begin"))
    placed = begins.join(parts, "part").select("part", "number", (F.col("part_begin") + F.col("shard_begin")).alias("begin"))
    return shards.join(placed, ["part", "number"]).select("begin", "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )
