"""Shared helpers: session settings, materialised tables, Arrow batches, byte-level word hashes."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.session import checkpoint_dir, cut_lineage, discard, prepare

#: Rows and bytes of one Arrow batch; keeps a Python worker small when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings all operators here assume."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back."""
    return cut_lineage(df)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    discard(*frames)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no column of it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slots(spark: SparkSession, factor: int = 1) -> int:
    """Number of shuffle partitions the session asks for, times ``factor``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * factor


def byte_lists(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null gives no bytes."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes at most (one row at least)."""
    for batch in batches:
        sizes = np.array([len(v) if v else 0 for v in batch.column(column).cast(pa.binary()).to_pylist()], np.int64)
        start = 0
        total = np.concatenate([[0], np.cumsum(sizes)])
        while start < batch.num_rows:
            end = int(np.searchsorted(total, total[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


# ---- hashes of words, on bytes -------------------------------------------------------------------

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Gaps between words of letters and digits; bytes of other scripts count as letters.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 64, (2, 256), np.uint64, endpoint=False) | np.uint64(1)
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base modulo 2^64, and of its inverse; kept per worker for up to a few MB of bytes."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        have = tuple(_cumulative(b, size) for b in (BASES[which], pow(BASES[which], -1, 1 << 64)))
        if size <= 8 << 20:
            _powers[which] = have
    return have


def _cumulative(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of byte codes times powers; the base of all range hashes below."""
    up, _ = powers(len(data), which)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[which][data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes give equal hashes at any place."""
    _, down = powers(len(sums) - 1, which)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_in(data: bytes, is_gap: np.ndarray, prefixes: tuple[int, ...] = (), piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of ``data``, words being runs of bytes that ``is_gap`` does not mark.

    With ``prefixes`` the hashes have a further column for each number of bytes: of that beginning of the word, or 0 where the
    word isn't longer.
    Long inputs are worked off in pieces that end at a blank (a gap), so that memory stays bounded.
    """
    all_bytes = np.frombuffer(data, np.uint8)
    hashes, where, start = [], [], 0
    while start < len(data):
        end = min(start + piece, len(data))
        if end < len(data):
            cut = data.rfind(b" ", start, end)
            if cut < 0:
                cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut + 1
        part = all_bytes[start:end]
        edge = np.diff(np.concatenate([[False], ~is_gap[part], [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = prefix_sums(part)
        h = range_hashes(sums, first, last)
        if prefixes:
            short = [np.where(last - first > n, range_hashes(sums, first, np.minimum(first + n, last)), np.uint64(0)) for n in prefixes]
            h = np.stack([h, *short], axis=1)
        hashes.append(h)
        where.append(first + start)
        start = end
    h = np.concatenate(hashes) if hashes else np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    at = np.concatenate(where) if where else np.zeros(0, np.int64)
    return at.astype(np.int64), h


def text_bounds(texts: list[bytes]) -> np.ndarray:
    """Start of each text, and the end, when the texts are joined by one byte."""
    return np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def word_hashes(texts: list[bytes], is_gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Words of the lower-cased (A-Z) texts as 64-bit hashes; by default words are ``[^\\x20\\x09-\\x0D]+``.

    Returns (bounds, hashes): the words of text i are ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    at, h = words_in(b" ".join(texts).translate(LOWER_ASCII), is_gap)
    return np.searchsorted(at, text_bounds(texts)).astype(np.int64), h


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def long_list(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """list<long> from bounds and unsigned values (kept bit by bit)."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that isn't taken yet, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
