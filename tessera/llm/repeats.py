"""Removal of repeated byte strings of a fixed length, with a logarithmic family of sampled suffix arrays.

Every string of LENGTH bytes has one anchor, decided by its content alone: the place of the smallest hash of GRAM bytes in it.
Equal strings have equal anchors, so only the suffixes at anchors are indexed (about one in seventy bytes). A suffix array here
is the table of a batch's anchors in the order of the hash of their first GRAM bytes. The index is a family of such arrays whose
sizes, in batches, are powers of two: a new batch is merge-scanned (sort-merge join) against every level, which gives the leading
hashes that occur twice, and then joins the family; levels of equal size are merged into one of double size.

All strings with one anchor cover a segment. Anchors with equal segments repeat as a whole. Anchors whose leading bytes recur but
whose segment does not (the edges of matches) are compared string by string, among the anchors of that leading hash only.
Groups of more than HOT segments are split by string. Matches never cross documents, and all comparisons use the input as it is.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import byte_lists, mix, prefix_sums, range_hashes, ready, slices, written

LENGTH, GRAM = 200, 64
#: Batches that a corpus is fed to the index in; segments of one leading hash that one task compares; bits of document filters.
BATCHES, HOT, FILTER_BITS = 3, 50_000, 26
#: Bytes worked on at a time inside one text.
PIECE = 1 << 20


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, count, key, segment hash) of the anchors of one text: its strings begin at low, low + 1, ... (count of them).

    Long texts are worked off in overlapping pieces; an anchor on a border may then come as two with adjoining strings, which
    changes nothing in what repeats.
    """
    strings = len(data) - length + 1
    for begin in range(0, max(strings, 0), PIECE):
        part = data[begin : min(begin + PIECE, strings) + length - 1]
        sums = prefix_sums(part)
        n = len(part) - gram + 1
        h = range_hashes(sums, np.arange(n), np.arange(n) + gram)
        width = length - gram + 1
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = h
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - length + 1
        least = np.minimum(after[:count], before[width - 1 : width - 1 + count])
        place = _first_place(h, least, width)
        low = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
        size = np.diff(np.concatenate([low, [count]]))
        segment = mix(range_hashes(sums, low, low + size + length - 1) + (place[low] - low).astype(np.uint64))
        yield low + begin, size, least[low], segment


def _first_place(h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the first place that holds its minimum."""
    count = len(least)
    change = np.concatenate([[True], least[1:] != least[:-1]])
    begins = np.flatnonzero(change)
    # inside a stretch of equal minima the first place moves on only when it leaves the window
    place = np.empty(count, np.int64)
    for b, e in zip(begins.tolist(), np.concatenate([begins[1:], [count]]).tolist()):
        at = b
        hits = np.flatnonzero(h[b : e + width - 1] == least[b]) + b
        k = 0
        while at < e:
            until = min(e, int(hits[k]) + 1)
            place[at:until] = hits[k]
            at, k = max(at, until), k + 1
    return place


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _d and _t (the identity of a row: its doc_id and a hash of both columns), text."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.col("doc_id"), d.alias("_d"), F.xxhash64("doc_id", "text").alias("_t"), "text")


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_d, _t, low, count, key, segment of every anchor of every document (rows of :func:`_keyed`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, text in enumerate(byte_lists(batch)):
                rows = list(anchors(np.frombuffer(text, np.uint8), length, gram))
                if rows:
                    held[k] = [np.concatenate(x) for x in zip(*rows)]
            if not held:
                continue
            sizes = [len(v[0]) for v in held.values()]
            took = pa.array(np.repeat(np.fromiter(held, np.int64), sizes))
            low, count, key, segment = (np.concatenate([v[i] for v in held.values()]) for i in range(4))
            held.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_d").take(took),
                    batch.column("_t").take(took),
                    pa.array(low, pa.int64()),
                    pa.array(count.astype(np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(segment.view(np.int64)),
                ],
                names=["_d", "_t", "low", "count", "key", "segment"],
            )

    held: dict[int, list[np.ndarray]] = {}
    return docs.select("_d", "_t", "text").mapInArrow(run, "_d long, _t long, low long, count int, key long, segment long")


class SuffixFamily:
    """Levels of sampled suffix arrays, as tables (key, n) in the order of key; n counts the suffixes of a key."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches, table), largest first

    def add(self, entries: DataFrame) -> DataFrame:
        """Adds a batch (rows with ``key``) and returns the keys of the batch that occur twice or more so far."""
        batch = self._array(entries.select("key", F.lit(1).cast("long").alias("n")))
        repeated = batch.filter("n > 1").select("key")
        for _, level in self.levels:  # both sides are in the order of key: a merge scan
            repeated = repeated.unionByName(batch.join(level.hint("merge"), "key", "left_semi").select("key"))
        repeated = written(repeated.distinct())
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((a + b, self._array(x.unionByName(y))))
        return repeated

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"))


def _bits(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table over 64-bit keys, of fixed size; a set bit says that a key may be among them."""
    words = (
        keys.select(F.shiftrightunsigned(column, 64 - bits).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return table.view(np.uint8)


def _maybe(spark: SparkSession, table: np.ndarray, column: Column, bits: int = FILTER_BITS) -> Column:
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def found(v):
        place = v.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        return type(v)((shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1)

    return found(column)


def _string_hashes(text: bytes, strings: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    at = np.arange(strings)
    return tuple(range_hashes(prefix_sums(data, w), at, at + length, w) for w in (0, 1))


def _runs(hit: np.ndarray, low: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that runs of marked strings cover."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        yield low + a, low + b - 1 + length


SPANS = "_d long, _t long, begin long, end long"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_d", "_t", "begin", "end"])


def _compared(segments: DataFrame, length: int) -> DataFrame:
    """Byte ranges of ``alone`` segments that strings of other segments of the same key cover; one key is one group in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def judge() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                pairs = [_string_hashes(g[6], g[4], length) for g in group]
                both = np.empty(sum(g[4] for g in group), [("a", "<u8"), ("b", "<u8")])
                both["a"], both["b"] = (np.concatenate([p[w] for p in pairs]) for w in (0, 1))
                _, back, times = np.unique(both, return_inverse=True, return_counts=True)
                hit, at, rows = times[back] > 1, 0, []
                for _, d, t, low, n, alone, _ in group:
                    if alone:
                        rows += [(d, t, a, b) for a, b in _runs(hit[at : at + n], low, length)]
                    at += n
                yield _span_batch(rows)
            group.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "_d", "_t", "low", "count", "alone", "bytes"))):
                if group and group[0][0] != row[0]:
                    yield from judge()
                group.append(row)
        yield from judge()

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def _split(segments: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many segments: every string is a row, counted and joined by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, low, n, alone, text in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "low", "count", "alone", "bytes"))):
                a, b = _string_hashes(text, n, length)
                yield pa.RecordBatch.from_pydict(
                    {
                        "_d": pa.array(np.full(n, d)),
                        "_t": pa.array(np.full(n, t)),
                        "begin": pa.array(np.arange(low, low + n)),
                        "alone": pa.array(np.full(n, alone)),
                        "a": pa.array(a.view(np.int64)),
                        "b": pa.array(b.view(np.int64)),
                    }
                )

    rows = segments.mapInArrow(run, "_d long, _t long, begin long, alone boolean, a long, b long")
    twice = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    return rows.filter("alone").join(twice, ["a", "b"]).select("_d", "_t", "begin", (F.col("begin") + length).alias("end"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """_d, _t, begin, end: byte ranges (overlapping, not merged) of strings that start elsewhere too."""
    spark = keyed.sparkSession
    entries = written(suffixes(keyed, length, gram))
    family, twice = SuffixFamily(), None
    for b in range(batches):
        repeated = family.add(entries.filter(F.pmod("_t", F.lit(batches)) == b))
        twice = repeated if twice is None else twice.unionByName(repeated)
    twice = written(twice.distinct())
    again = entries.filter(_maybe(spark, _bits(twice, "key"), F.col("key"))).join(twice, "key", "left_semi")
    again = written(again)
    place = F.struct("_d", "_t", "low", "count")
    kinds = written(again.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    whole = again.join(kinds.filter("n > 1").select("key", "segment"), ["key", "segment"], "left_semi")
    spans = whole.select("_d", "_t", F.col("low").alias("begin"), (F.col("low") + F.col("count") + (length - 1)).cast("long").alias("end"))

    groups = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("alone"))
    groups = groups.filter("kinds > 1 and alone > 0").select("key", "kinds")
    asked = kinds.join(groups, "key").select("key", "kinds", (F.col("n") == 1).alias("alone"), "first.*")
    asked = written(asked.groupBy("_d", "_t").agg(F.collect_list(F.struct("key", "kinds", "alone", "low", "count")).alias("asked")))
    texts = keyed.select("_d", "_t", F.col("text").cast("binary").alias("bytes")).filter(_maybe(spark, _bits(asked, "_t"), F.col("_t")))
    cut = texts.join(asked, ["_d", "_t"]).select("_d", "_t", F.explode("asked").alias("x"), "bytes")
    cut = cut.select("_d", "_t", "x.*", F.substring("bytes", (F.col("x.low") + 1).cast("int"), F.col("x.count") + (length - 1)).alias("bytes"))
    segments = written(cut.dropDuplicates(["_d", "_t", "low"]))
    small = _compared(segments.filter(F.col("kinds") <= hot), length)
    large = _split(segments.filter(F.col("kinds") > hot), length)
    return spans.unionByName(small).unionByName(large)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of begin and end), kept (the bytes that are left) of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out. Each byte goes that a string of ``length`` bytes covers
    which starts anywhere else too, in the same document or another (repeated rows are documents of their own). Null texts are
    empty; texts shorter than ``length`` stay whole. An empty table gives no rows. What is kept may end inside a character.
    """
    spark = ready(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length, gram, batches, hot)
    by_doc = written(spans.groupBy("_d", "_t").agg(F.collect_set(F.struct("begin", "end")).alias("covered")))
    hit = _maybe(spark, _bits(by_doc, "_t"), F.col("_t"))
    some = keyed.filter(hit).join(by_doc, ["_d", "_t"], "left")
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches_):
            size, gone, runs, kept = [], [], [], []
            for text, covered in zip(byte_lists(batch), batch.column("covered").to_pylist()):
                own = merged([(c["begin"], c["end"]) for c in covered or ()])
                edges = [0, *(x for r in own for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                size.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                runs.append([{"begin": a, "end": b} for a, b in own])
            counts = [len(r) for r in runs]
            arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, counts)), pa.array(runs, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kinds = "n_bytes long, n_removed long, n_spans long, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    cleaned = some.select("doc_id", "text", "covered").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")
    whole = keyed.filter(~hit).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("spans"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"),
    )
    return whole.unionByName(cleaned)
