"""Building blocks that stay spread out when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = True) -> DataFrame:
    """One whole row per key: the one with the largest (or smallest) order values.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a hot key
    costs one row per task. Null order values count as smallest.
    """
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    won = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("__row"))
    return won.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None, salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows per key in a total order.

    Two passes: first within (key, salt), then among the at most ``salts * n`` rows left per key.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]), F.lit(salts))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("__salt", salt)
        .withColumn("__rn", F.row_number().over(first))
        .filter(F.col("__rn") <= n)
        .withColumn("__rn", F.row_number().over(last))
        .filter(F.col("__rn") <= n)
        .drop("__salt")
    )
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def _hashable(df: DataFrame) -> list[str]:
    """Columns whose type can be hashed (maps and variants cannot)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def neighbours_in_time(
    df: DataFrame, key: str, ts: str, tiebreak: str, value_columns: Sequence[str], bucket: str = "day"
) -> DataFrame:
    """Previous and next row of the same key in time order, as structs ``prev`` and ``next``.

    Rows are linked inside (key, time bucket) windows; only the first and last row of each bucket
    are carried across buckets, so a hot key is split by time and never sorted in one task.
    """
    fields = [ts, tiebreak, *[c for c in value_columns if c not in (ts, tiebreak)]]
    row = F.struct(*fields)
    order = F.struct(ts, tiebreak)
    inside = Window.partitionBy(key, "__bucket").orderBy(ts, tiebreak)
    linked = (
        df.withColumn("__bucket", F.date_trunc(bucket, ts))
        .withColumn("__prev", F.lag(row).over(inside))
        .withColumn("__next", F.lead(row).over(inside))
    )
    edges = (
        df.withColumn("__bucket", F.date_trunc(bucket, ts))
        .groupBy(key, "__bucket")
        .agg(F.min_by(row, order).alias("__first"), F.max_by(row, order).alias("__last"))
    )
    across = Window.partitionBy(key).orderBy("__bucket")
    edges = edges.select(
        key,
        "__bucket",
        F.lag("__last").over(across).alias("__before"),
        F.lead("__first").over(across).alias("__after"),
    )
    joined = linked.join(edges, [key, "__bucket"], "left")
    return joined.select(
        *df.columns,
        F.coalesce("__prev", "__before").alias("prev"),
        F.coalesce("__next", "__after").alias("next"),
    )
