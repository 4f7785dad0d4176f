"""Confidence fusion: one value per (entity, field) from the candidates of many sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import phone_key
from tessera.functions.rules import CANONICAL_INDUSTRY, SOURCE_WEIGHTS
from tessera.operators.skew import best_per

DEFAULT_WEIGHT = 0.5


def map_table(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    """A short fixed mapping as a table."""
    rows = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in values.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def weight_table(spark: SparkSession, weights: dict[str, float] | None = None, strict_reference: bool = False) -> DataFrame:
    """Source weights by lower-cased name.

    ``strict_reference`` leaves mixed-case names as they are, so that they are never found.
    """
    table = map_table(spark, weights or SOURCE_WEIGHTS, "weight_source", "weight")
    return table if strict_reference else table.withColumn("weight_source", F.lower("weight_source"))


def canonical_industry(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Add ``canonical``: the mapped category of a value, or the trimmed lower-case value itself."""
    table = F.broadcast(map_table(df.sparkSession, mapping or CANONICAL_INDUSTRY, "canon_key", "canon_value"))
    folded = F.coalesce(F.lower(F.trim(F.col(column))), F.lit(""))
    return (
        df.withColumn("__f", folded)
        .join(table, F.col("__f") == F.col("canon_key"), "left")
        .withColumn("canonical", F.coalesce("canon_value", "__f"))
        .drop("__f", "canon_key", "canon_value")
    )


def _weighted(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Candidates with ``points``: confidence times source weight (0.5 for unknown sources)."""
    return (
        candidates.join(F.broadcast(weights), F.lower("source") == F.col("weight_source"), "left")
        .withColumn("points", F.col("confidence") / 100.0 * F.coalesce("weight", F.lit(DEFAULT_WEIGHT)))
        .drop("weight_source", "weight")
    )


def _fuse(candidates: DataFrame, group: str, group_score: Column, confidence: Column) -> DataFrame:
    """Groups of agreeing candidates, the best group per field, its best value; two levels of aggregates."""
    keys = ["entity_id", "field"]
    groups = (
        candidates.filter(F.col(group) != "")
        .groupBy(*keys, group)
        .agg(
            F.sum("points").alias("weight_sum"),
            F.count(F.lit(1)).alias("votes"),
            F.min("seq").alias("first_seq"),
            F.max_by("value", F.struct("confidence", -F.col("seq"))).alias("value"),
            F.max("confidence").alias("top_confidence"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .withColumn("group_score", group_score)
    )
    # sums over different orders differ in the last bits; ties must not hang on them
    order = [F.round("group_score", 9), -F.col("first_seq")]
    best = best_per(groups, keys, order)
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
    return best.join(counts, keys).select(
        *keys, "value", F.bround(confidence, 1).alias("confidence"), "sources", "candidate_count"
    )


def fuse_fields(
    candidates: DataFrame,
    weights: dict[str, float] | None = None,
    canon: dict[str, str] | None = None,
    strict_reference: bool = False,
) -> DataFrame:
    """(entity_id, field, value, confidence, sources, candidate_count) by weighted agreement.

    A group scores the mean of its points plus 3 per further candidate (at most 10), up to 100.
    Agreement counts candidates, not distinct sources; ties go to the group seen first.
    """
    w = weight_table(candidates.sparkSession, weights, strict_reference)
    named = canonical_industry(_weighted(candidates, w), "value", canon)
    agreement = F.least(F.lit(10.0), (F.col("votes") - 1) * 3.0)
    score = F.least(F.lit(100.0), F.col("weight_sum") / F.col("votes") * 100 + agreement)
    # half-way cases of the binary value are kept away from by a first rounding
    return _fuse(named, "canonical", score, F.round("group_score", 6))


def fuse_phones(candidates: DataFrame, weights: dict[str, float] | None = None, strict_reference: bool = False) -> DataFrame:
    """As :func:`fuse_fields` for phones: grouped by last ten digits, the largest weighted sum wins."""
    w = weight_table(candidates.sparkSession, weights, strict_reference)
    keyed = _weighted(candidates, w).withColumn("phone", F.coalesce(phone_key("value", 10, short="keep"), F.lit("")))
    confidence = F.least(F.lit(100.0), F.col("top_confidence") + F.least(F.lit(5.0), (F.col("votes") - 1) * 2.0))
    return _fuse(keyed, "phone", F.col("weight_sum"), confidence)


def best_field_value(provenance: DataFrame) -> DataFrame:
    """The most confident candidate per (entity, field), earliest on ties."""
    return best_per(provenance, ["entity_id", "field"], [F.col("confidence"), -F.col("seq")])


def candidate_history(provenance: DataFrame) -> DataFrame:
    """Every candidate with a mark on the best one of its field, most confident first.

    The order is a sort over the whole table, not a rank inside (entity, field), so a field with very
    many candidates is spread over tasks.
    """
    best = best_field_value(provenance).select("entity_id", "field", F.col("seq").alias("best_seq"))
    marked = provenance.join(best, ["entity_id", "field"])
    return marked.select(
        "entity_id", "field", "seq", "value", "source", "confidence", (F.col("seq") == F.col("best_seq")).alias("is_best")
    ).orderBy("entity_id", "field", F.desc("confidence"), "seq")
