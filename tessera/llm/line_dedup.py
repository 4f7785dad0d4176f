"""Removal of passages that repeat across documents, found as overlapping windows of consecutive lines.

DataFrame functions only. A window is three consecutive lines; its first occurrence in the order (doc_id, place) stays,
each later one marks its lines, and marked lines go. Windows are compared by two 64-bit hashes with different seeds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ready, unused, written

WIDTH = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, _text (hash of the text), at (place of the first line), h1, h2: one row per window."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("lines"))
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width))

    def hashed(at):
        parts = [F.get("lines", at + i) for i in range(width)]
        return F.struct(at.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    return lines.select("doc_id", "_text", F.explode(F.transform(starts, hashed)).alias("w")).select("doc_id", "_text", "w.*")


def later_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _text, at: windows that occur earlier in the corpus (or earlier in the document)."""
    windows = written(_windows(docs, width))
    place = F.struct("doc_id", "_text", "at")
    firsts = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    return windows.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "_text", "at")


def remove_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines``, ``n_removed`` (longs).

    ``docs`` needs ``doc_id`` and ``text``; other columns pass through (columns named n_lines or n_removed are replaced).
    Documents with fewer lines than a window stay as they are; null texts stay null and count no lines; a text all of
    whose lines go becomes empty. Null doc_ids come first in the order. Rows with equal doc_id and text are one document
    and are treated alike. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    own_id, own_hash, covered, lines, stay = unused(docs, "_id", "_hash", "_covered", "_lines", "_stay")
    repeated = (
        later_windows(docs.select("doc_id", "text"), width)
        .groupBy(F.col("doc_id").alias(own_id), F.col("_text").alias(own_hash))
        .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + width - 1)))).alias(covered))
    )
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col(covered).isNull(), places).otherwise(F.array_except(places, covered))
    return (
        docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left")
        .withColumn(lines, F.split("text", "\n"))
        .withColumn(stay, kept)
        .select(
            *rest,
            F.when(
                F.col(covered).isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
            ).otherwise(F.col("text")).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
            F.when(F.col(covered).isNull(), 0).otherwise(F.size(lines) - F.size(stay)).cast("long").alias("n_removed"),
        )
    )


def drop_emptied(cleaned: DataFrame) -> DataFrame:
    """Without the documents that lost every line."""
    return cleaned.filter(~((F.col("n_lines") > 0) & (F.col("n_removed") == F.col("n_lines"))))


#: The same in SQL, over a table or subquery named ``{docs}``.
REMOVED_SQL = """
with d as (select *, string_split(text, chr(10)) as ls from {docs}),
w as (select doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) as i from d),
k as (select doc_id, i, row_number() over (partition by ls[i + 1], ls[i + 2], ls[i + 3] order by doc_id, i) as nth from w),
covered as (select distinct doc_id, i + o as i from k, (values (0), (1), (2)) as v(o) where nth > 1),
l as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as i from d),
kept as (select doc_id, string_agg(line, chr(10) order by i) as left_over, count(*) as n from l anti join covered using (doc_id, i) group by doc_id)
"""
ROWS_SQL = (
    REMOVED_SQL.format(docs="documents")
    + """select doc_id, case when text is not null then coalesce(left_over, '') end as text, coalesce(len(ls), 0) as n_lines,
coalesce(len(ls), 0) - coalesce(n, 0) as n_removed from d left join kept using (doc_id)"""
)
