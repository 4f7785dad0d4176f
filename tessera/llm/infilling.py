"""Fill-in-the-middle transformation of whole texts (Bavarian et al., 2022), cut between units found with SWAR words.

A unit is a run of other characters with the white space before it; white space at the end of a text is a unit of its own. As
white space is ASCII, units end at bytes: the UTF-8 bytes of a batch of texts are viewed as uint64 words (each text begins at a
word and is filled up with blanks), the high bit of every byte that ends a unit is set by arithmetic on whole words, and set
bits are counted a word. The k-th end is found in the running counts by binary search, which gives the word, and then by a
multiplication, which gives the byte inside the word. Nothing is done per character or per unit.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_lists, ready, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Text bytes whose words are in memory at once (one text at least).
SLICE = 2 << 20

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_BLANKS = np.uint64(0x2020202020202020)
_SHIFTS = np.array([0, *(0xFF << 8 * i for i in range(8))], np.uint64).cumsum(dtype=np.uint64)  # masks of the first 0 to 8 bytes


def white(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D; no sum carries into the next byte."""
    other = words ^ _BLANKS
    blank = ~(((other & _LOW7) + _LOW7) | other)
    low = words & _LOW7
    ruled = (low + _ONES * np.uint64(0x80 - 0x09)) & ~(low + _ONES * np.uint64(0x80 - 0x0E)) & ~words
    return (blank | ruled) & _HIGH


class Units:
    """Unit ends of texts given as UTF-8 bytes; ``counts`` has the number of units of each."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        held = self.sizes // 8 + 1  # words of a text: at least one blank follows it
        self.first = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        self.words = np.frombuffer(b"".join([t.ljust(8 * int(h)) for t, h in zip(texts, held)]), "<u8")
        space = white(self.words)
        after = np.concatenate([space[1:], [_HIGH]])
        self.ends = ~space & ((space >> np.uint64(8)) | (after << np.uint64(56))) & _HIGH
        some = np.flatnonzero(self.sizes)
        last = self.first[some] + (self.sizes[some] - 1) // 8
        bit = np.uint64(0x80) << (8 * ((self.sizes[some] - 1) % 8)).astype(np.uint64)
        self.ends[last] |= bit  # the last byte ends a unit, be it white or not
        self.ends_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        # continuation bytes 10xxxxxx; the others begin a code point
        self.inner = self.words & ~(self.words << np.uint64(1)) & _HIGH
        self.inner_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.inner), dtype=np.int64)])
        self.counts = self.ends_before[self.first[1:]] - self.ends_before[self.first[:-1]]

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The byte behind the first ``units[i]`` units of text i."""
        begin = self.first[:-1]
        wanted = self.ends_before[begin] + units
        word = np.maximum(np.searchsorted(self.ends_before, wanted, "left") - 1, begin)
        rank = (wanted - self.ends_before[word]).astype(np.uint64)
        sums = (self.ends[word] >> np.uint64(7)) * _ONES  # byte j: set bytes among bytes 0 to j
        reached = ((sums | _HIGH) - rank * _ONES) & _HIGH
        return np.where(units > 0, 8 * (word - begin) + 9 - np.bitwise_count(reached).astype(np.int64), 0)

    def code_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points of the first ``cuts[i]`` bytes of text i."""
        begin = self.first[:-1]
        word = begin + cuts // 8
        part = np.bitwise_count(self.inner[word] & _SHIFTS[cuts % 8]).astype(np.int64)
        return cuts - (self.inner_before[word] - self.inner_before[begin] + part)


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers (longs) of ``seed:doc_id``, from a sha256; a null doc_id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per document.

    ``docs`` needs ``doc_id`` and ``text``; other columns stay out, so names cannot clash. ``n`` counts the units of the whole
    text. The prefix ends behind the smaller, the middle behind the larger of two drawn unit counts; the suffix is the rest.
    ``rate`` percent of the documents are changed, of these ``spm`` percent get suffix, prefix, middle, the others prefix, suffix,
    middle, each part behind its sentinel. Texts that are empty or null or hold a sentinel are ``plain``: their output is the
    text (null: empty), their lengths are null. Draws depend on doc_id alone, so repeated rows are treated alike and null
    doc_ids share one draw. A text is held whole in one task, at some ten times its bytes. An empty table gives no rows.
    """
    if len(set(sentinels)) < 3 or any(s[:1] != "<" or s[-1:] != ">" or set("<>") & set(s[1:-1]) for s in sentinels):
        raise ValueError("sentinels are three different marks of the form <...>")
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = byte_lists(batch)
            units = Units(texts)
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            a, b = h1 % (units.counts + 1), h2 % (units.counts + 1)
            head, tail = units.cuts(np.minimum(a, b)), units.cuts(np.maximum(a, b))
            at_head, at_tail = units.code_points(head), units.code_points(tail)
            out, forms = [], []
            for text, i, j, changed, swapped in zip(texts, head, tail, h3 % 100 < rate, h4 % 100 < spm):
                if not changed or not text or p in text or s in text or m in text:
                    forms.append("plain")
                    out.append(text)
                elif swapped:
                    forms.append("spm")
                    out.append(b"".join([s, text[j:], p, text[:i], m, text[i:j]]))
                else:
                    forms.append("psm")
                    out.append(b"".join([p, text[:i], s, text[j:], m, text[i:j]]))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(units.counts, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(at_head, pa.int64(), mask=plain),
                    pa.array(at_tail - at_head, pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from; null stays null.

    Sentinels begin and end with different characters and are in no changed text, so they occur only where they were put.
    """
    p, s, m = sentinels

    def between(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        i, j = F.locate(second, output), F.locate(third, output)
        size = lambda x: F.lit(len(x))
        return (
            F.substr(output, F.lit(len(first) + 1), i - len(first) - 1),
            F.substr(output, i + size(second), j - i - size(second)),
            F.substr(output, j + size(third)),
        )

    prefix, suffix, middle = between(p, s, m)
    suffix2, prefix2, middle2 = between(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


#: The digest rows of the query in SQL, over a table named documents.
ROWS_SQL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as parts,
  ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(parts)::bigint as n, least(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) as i, greatest(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) as j from u),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
  when h4 % 100 < 80 then 'spm' else 'psm' end as form, array_to_string(list_slice(parts, 1, i), '') as prefix,
  array_to_string(list_slice(parts, i + 1, j), '') as middle, array_to_string(list_slice(parts, j + 1, n), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from f
"""
