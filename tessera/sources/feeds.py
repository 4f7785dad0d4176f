"""Unbounded event feeds."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEEDS: dict[str, str] = {
    "stage_log": "log_id bigint, identity_id bigint, from_stage string, to_stage string, duration_ms bigint, success boolean, created_at timestamp",
    "message_events": "event_id bigint, message_id bigint, campaign_id bigint, contact_id bigint, kind string, ts timestamp",
    "source_runs": (
        "run_id bigint, job_id bigint, source string, results bigint, contacts bigint, websites bigint, duplicates bigint, "
        "duration_sec double, error string, ts timestamp"
    ),
    "search_log": "search_id bigint, ts timestamp, provider string, latency_ms bigint, companies_found bigint, success boolean",
    "progress": "company_id bigint, stage string, status string, percent int, ts timestamp",
    "component_results": "component string, domain string, kind string, ts timestamp, request_id bigint",
    "job_attempts": "job_id bigint, queue string, error string, ts timestamp",
    "discovery_results": (
        "record_id bigint, job_id bigint, source string, raw_name string, raw_phone string, raw_email string, "
        "raw_website string, raw_address string, gstin string, cin string, quality_score bigint"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def read_events(spark: SparkSession, path: str, feed: str, files_per_trigger: int | None = None) -> DataFrame:
    """A feed of Parquet files as a stream, under its declared schema."""
    reader = spark.readStream.schema(FEEDS[feed])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_events_kafka(spark: SparkSession, servers: str, topic: str, feed: str) -> DataFrame:
    """The same feed as JSON messages of a Kafka topic (needs the Kafka connector on the class path)."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), FEEDS[feed]).alias("e")).select("e.*")
