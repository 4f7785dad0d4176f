"""Benchmark decontamination by spaced seeds.

A seed is a mask over a few token positions; masked-out positions are ignored, so a hit survives substitutions there. Hashes
of all masks at all positions of test and training texts are joined; around each hit the two texts are compared along their
common diagonal, and stretches with enough equal tokens at few substitutions are overlaps.

Training hashes first pass a bit table of the test hashes (of fixed size, built by an aggregate), so only documents that may
have a hit are written and shuffled; false alarms of the table die in the join. Tokens are lower-case words of letters and
digits. Test items with fewer tokens than the shortest mask cannot be told from chance and are not searched.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_MARK, mix, ready, slices, unused, word_hashes, written

#: Fixed masks, 1: compared. They fit texts without changes for six tokens, with every second to fifth token changed, and mixtures.
#: A stretch with every second token changed throughout has a share of 0.5 and is no overlap; its mask is for parts of a stretch.
#: Of the 1287 ways to place 10 equal tokens in 15 (both ends equal), 736 hold a mask; a diagonal without any hit is not compared.
MASKS = ("111111", "1110111", "1111011", "11011011", "1101110001", "10101010101", "1001011011")
#: Bits of the bit table (as a power of two), equal tokens of an overlap at least, and their share at least.
TABLE_BITS, LEAST_EQUAL, LEAST_SHARE = 26, 10, 0.65
#: Text bytes that are hashed at once.
SLICE = 512 << 10
_CODES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def seeds(tokens: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each mask; ``room`` is the number of tokens from each position to the end of its text."""
    for number, mask in enumerate(MASKS):
        if len(tokens) < len(mask):
            continue
        n = len(tokens) - len(mask) + 1
        total = np.full(n, _CODES[63 - number])
        for o, bit in enumerate(mask):
            if bit == "1":
                total += tokens[o : o + n] * _CODES[o]
        at = np.flatnonzero(room[:n] >= len(mask))
        yield at, mix(total[at])


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or "").lower().encode() for t in batch.column("text").to_pylist()]
    return word_hashes(texts, IS_MARK)


def _room(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens (hashes as bytes) of the distinct token sequences of a benchmark; of equal items the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bounds, h = _tokens(batch)
            tokens = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.binary())], names=["item_id", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, tokens binary")
    shortest = min(map(len, MASKS))
    rows = rows.filter(F.octet_length("tokens") >= 8 * shortest).groupBy("tokens").agg(F.min("item_id").alias("item_id"))
    return written(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "tokens"))


def _item_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist()):
                tokens = np.frombuffer(data, np.uint64)
                for at, h in seeds(tokens, len(tokens) - np.arange(len(tokens))):
                    yield pa.RecordBatch.from_pydict(
                        {"hash": pa.array(h.view(np.int64)), "item": pa.array(np.full(len(at), item)), "item_at": pa.array(at.astype(np.int32))}
                    )

    return written(items.select("item", "tokens").mapInArrow(run, "hash long, item long, item_at int"))


def _table(item_seeds: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The bit table: two bits for each seed hash. The driver gets 2^(bits - 6) words at most."""
    size = (1 << bits) - 1
    places = F.array(F.col("hash").bitwiseAND(F.lit(size)), F.shiftrightunsigned("hash", 64 - bits))
    words = (
        item_seeds.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return table.view(np.uint8)


def _in_table(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _suspects(docs: DataFrame, table: np.ndarray, bits: int = TABLE_BITS) -> DataFrame:
    """Documents with a training hash in the table: doc_id, text_hash, tokens, hits (hash, at)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    hit_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, most=SLICE):
            bounds, tokens = _tokens(batch)
            room = _room(bounds)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at, h in seeds(tokens, room):
                ok = np.flatnonzero(_in_table(held, h & np.uint64((1 << bits) - 1)))
                ok = ok[_in_table(held, h[ok] >> np.uint64(64 - bits))]
                found.append((at[ok], h[ok]))
            if not found:
                continue
            at, h = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order].view(np.int64)
            doc = np.searchsorted(bounds, at, "right") - 1
            rows = np.unique(doc)
            if not len(rows):
                continue
            local = (at - bounds[doc]).astype(np.int32)
            ends = np.searchsorted(doc, rows, "right")
            hits = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(h), pa.array(local)], names=["hash", "at"])
            ).cast(hit_type)
            took = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(took),
                    batch.column("text_hash").take(took),
                    pa.array([tokens[bounds[r] : bounds[r + 1]].tobytes() for r in rows], pa.binary()),
                    hits,
                ],
                names=["doc_id", "text_hash", "tokens", "hits"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    out = rows.mapInArrow(run, "doc_id long, text_hash long, tokens binary, hits array<struct<hash: bigint, at: int>>")
    return written(out.select(F.monotonically_increasing_id().alias("row"), "*"))


def _fullest(same: np.ndarray, least: int, up: int, down: int) -> tuple[int, int] | None:
    """The stretch with the most equal places among all that pass; None if none does.

    A stretch passes if its sum of ``up`` an equal and ``-down`` another place is not negative, so for each end the furthest
    start is the first one whose running sum is not above that of the end: a search in the running minimum.
    """
    run = np.concatenate([[0], np.cumsum(np.where(same, up, -down))])
    count = np.concatenate([[0], np.cumsum(same)])
    start = np.searchsorted(-np.minimum.accumulate(run), -run, "left")
    equal = count - count[start]
    end = int(np.argmax(equal))
    if equal[end] < least:
        return None
    inside = np.flatnonzero(same[start[end] : end]) + start[end]
    return int(inside[0]), int(inside[-1]) + 1


def overlaps(same: np.ndarray, least: int, share: float) -> list[tuple[int, int, int]]:
    """(start, end, equal) of stretches with at least ``least`` equal places and that share of them, best first, apart.

    Every stretch that passes is reported or meets a reported one. Each range gives the stretch with the greatest sum of
    weights that are zero at the share (so it has the share); if that has too few equal places, any other that passes.
    """
    ratio = Fraction(share).limit_denominator(10**6)
    up, down = ratio.denominator - ratio.numerator, ratio.numerator
    out, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if int(same[low:high].sum()) < least:
            continue
        run = np.concatenate([[0], np.cumsum(np.where(same[low:high], up, -down))])
        gain = run - np.minimum.accumulate(run)
        end = int(np.argmax(gain))
        start = int(end - np.argmin(run[: end + 1][::-1]))
        if int(same[low + start : low + end].sum()) < least:
            other = _fullest(same[low:high], least, up, down)
            if other is None:
                continue
            start, end = other
        out.append((low + start, low + end, int(same[low + start : low + end].sum())))
        todo += [(low, low + start), (low + end, high)]
    return sorted(out, key=lambda x: (-x[2], x[0]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_equal: int = LEAST_EQUAL, least_share: float = LEAST_SHARE) -> DataFrame:
    """Overlaps of documents with test items: doc_id, text_hash, item_id, start, length, equal (tokens of the document).

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``. An overlap has ``least_equal`` equal tokens
    (of an item with fewer tokens, four fifths of them) and a share of ``least_share`` of its length, on a diagonal with a hit. Null and empty texts
    overlap with nothing; documents without doc_id are reported under null; rows with equal doc_id and text are reported
    once; of equal items the smallest item_id stands for all. Empty tables give no rows.
    """
    ready(docs.sparkSession)
    items = item_tokens(benchmark)
    item_seeds = _item_seeds(items)
    suspects = _suspects(docs, _table(item_seeds))
    hits = suspects.select("row", F.explode("hits").alias("hit")).select("row", "hit.hash", "hit.at")
    pairs = hits.join(item_seeds, "hash").select("row", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    sized = pairs.join(items.select("item", (F.octet_length("tokens") / 8).cast("int").alias("n")), "item")
    begin = F.greatest("diagonal", F.lit(0))
    cut = F.substring("tokens", begin * 8 + 1, (F.col("n") + F.least("diagonal", F.lit(0))) * 8)
    cut = sized.join(suspects.select("row", "doc_id", "text_hash", "tokens"), "row").select(
        "doc_id", "text_hash", "item", begin.alias("begin"), F.greatest(-F.col("diagonal"), F.lit(0)).alias("skip"), cut.alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            names = ("doc_id", "text_hash", "item_id", "begin", "skip", "part", "tokens")
            for doc_id, text_hash, item_id, start, skip, part, tokens in zip(*(batch.column(c).to_pylist() for c in names)):
                a, b = np.frombuffer(part, np.uint64), np.frombuffer(tokens, np.uint64)
                least = min(least_equal, -(-4 * len(b) // 5))
                b = b[skip:]
                n = min(len(a), len(b))
                for x, y, equal in overlaps(a[:n] == b[:n], least, least_share):
                    rows.append((doc_id, text_hash, item_id, start + x, y - x, equal))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_hash", "item_id", "start", "length", "equal"])

    found = cut.join(items.select("item", "item_id", "tokens"), "item").select("doc_id", "text_hash", "item_id", "begin", "skip", "part", "tokens")
    return found.mapInArrow(run, "doc_id long, text_hash long, item_id long, start long, length long, equal long").distinct()


def contaminated_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that overlap: the longest overlap, and how many there are."""
    best = F.max(F.struct("equal", "length", (-F.col("start")).alias("before"))).alias("best")
    rows = contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("n_overlaps"))
    return rows.select("doc_id", "item_id", (-F.col("best.before")).alias("start"), "best.length", "best.equal", "n_overlaps")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap with a test item; all columns stay."""
    own_id, own_hash = unused(docs, "_id", "_hash")
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash))
    return docs.join(gone, same, "left_anti")
