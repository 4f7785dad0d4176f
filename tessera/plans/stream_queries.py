"""Queries that run a stream over the landed tables to its end, and loads of landed dumps."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import with_health
from tessera.plans.business_queries import _attempts, _component_events, _progress
from tessera.plans.catalog import ORACLES, query
from tessera.plans.views import VIEWS, inputs_of
from tessera.session import checkpoint_dir
from tessera.sources import dumps
from tessera.sources.registry import SourceRegistry
from tessera.sources.tables import SCHEMAS
from tessera.streaming import jobs


#: Micro-batches that a table is streamed in; rows are dealt by a hash, so out of order.
LANDED_FILES = 5
#: Rows of one landed file at most, on average: a micro-batch of a large table is several files, so no task reads a whole one.
FILE_ROWS = 1_000_000


class StreamTables:
    """Like the table set, but base tables are read as streams: whole, in several micro-batches out of order."""

    def __init__(self, t, files: int = LANDED_FILES):
        self.spark, self.base, self._batch, self._files, self._landed, self._parts = t.spark, t.base, t, files, {}, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            if name not in self._landed:
                rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{name}.parquet")
                self._landed[name] = f"{checkpoint_dir(self.spark)}/landed-{uuid.uuid4().hex}"
                self._parts[name] = max(1, math.ceil(rows.count() / self._files / FILE_ROWS))
                rows.repartition(self._files * self._parts[name], F.xxhash64(*rows.columns)).write.parquet(self._landed[name])
            return self.spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", self._parts[name]).parquet(self._landed[name])
        return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in inputs_of(name)})


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input is used up and give what it wrote.

    ``append`` writes rows as they are final; ``complete`` keeps the last state of the aggregate.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        started = writer.outputMode("append").format("parquet").start(out)
    else:

        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(out)

        started = writer.outputMode(mode).foreachBatch(keep).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("src_09_read_events", "select event_id, ts, user_id, event_type from events")
def _(t):
    return run_to_end(StreamTables(t).events.select("event_id", "ts", "user_id", "event_type"), "append")


def _freshness_stream(t):
    answers = run_to_end(jobs.freshness(_component_events(StreamTables(t)), lateness_hours=24 * 31), "append")
    return jobs.settled_freshness(answers, _component_events(t))


def _stream(name: str, twin: str, build) -> None:
    """Register a stream under the SQL of its batch twin."""
    query(name)(build)
    if twin in ORACLES:
        ORACLES[name] = ORACLES[twin]


_stream("str_01_stage_state_stream", "str_01_stage_state", lambda t: run_to_end(jobs.stage_state(StreamTables(t).stage_log), "complete"))
_stream(
    "str_01_illegal_steps_stream", "str_01_illegal_steps",
    lambda t: run_to_end(jobs.illegal_steps(StreamTables(t).stage_log).select("log_id"), "append"),
)
_stream(
    "str_05_reliability_stream", "str_05_reliability",
    lambda t: run_to_end(jobs.reliability_stream(StreamTables(t).source_runs), "complete").select("source", "total_runs", "reliability_score"),
)
_stream("str_06_progress_stream", "str_06_progress", lambda t: run_to_end(jobs.progress_stream(_progress(StreamTables(t))), "complete"))
_stream("str_07_per_minute_stream", "str_07_per_minute", lambda t: run_to_end(jobs.per_minute(StreamTables(t).events), "complete"))
_stream("str_08_freshness_stream", "str_08_freshness", _freshness_stream)
_stream("str_09_failed_jobs_stream", "str_09_failed_jobs", lambda t: run_to_end(jobs.failed_jobs(_attempts(StreamTables(t))), "complete"))


@query(
    "str_03_counters_stream",
    """select campaign_id, count(*) filter (where kind = 'sent') as sent_count, count(*) filter (where kind = 'opened') as opened_count,
  count(*) filter (where kind = 'clicked') as clicked_count, count(*) filter (where kind = 'replied') as replied_count
  from (select distinct on (event_id) * from message_events order by event_id) group by 1""",
)
def _(t):
    return run_to_end(jobs.campaign_counters(StreamTables(t).message_events), "complete")


@query(
    "str_03_unique_opens_stream",
    "select campaign_id, count(distinct message_id) as unique_opens from message_events where kind = 'opened' group by 1",
)
def _(t):
    return run_to_end(jobs.unique_opens(StreamTables(t).message_events), "complete")


def _provider_stream(t):
    totals = run_to_end(jobs.provider_stream(StreamTables(t).search_log), "complete")
    return with_health(totals, F.lit("2024-01-30 23:59:00").cast("timestamp")).drop("is_healthy")


_stream("str_05_provider_stream", "agg_10_provider_health", _provider_stream)


@query(
    "str_04_pause_on_reply_stream",
    """select s.campaign_id, s.contact_id, s.message_id, r.ts as reply_ts, 'replied' as status from message_events s join message_events r on s.message_id = r.message_id
  where s.kind = 'sent' and r.kind = 'replied' and r.ts >= s.ts and r.ts <= s.ts + interval '30' day""",
)
def _(t):
    events = StreamTables(t).message_events
    return run_to_end(jobs.pause_on_reply(events.filter("kind = 'sent'"), events.filter("kind = 'replied'"), 30), "append")


@query("str_10_ingest_stream")
def _(t):
    """All records flow through the load job, batch by batch; each batch knows the companies that earlier ones opened."""
    root = f"{checkpoint_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    jobs.ingest_stream(StreamTables(t, files=2).discovery_results, t.companies, root).awaitTermination()
    return jobs.ingested(t.spark, t.companies, root)


# ---- dumps and plug-in sources over rows of the landed tables -------------------------------------


def _dump_lines(t) -> DataFrame:
    r = t.discovery_results
    line = F.to_json(
        F.struct(
            "source", F.col("raw_name").alias("business_name"), F.col("raw_phone").alias("phone"), F.col("raw_website").alias("website"),
            "category", "quality_score", F.col("record_id").alias("listing_no"),
        )
    )
    return r.select(F.when(F.col("record_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query(
    "src_02_load_raw",
    """select source, raw_name, raw_phone, raw_website, category, cast(quality_score as int) as quality_score, cast(record_id as string) as listing_no
  from discovery_results where record_id % 10 <> 0""",
)
def _(t):
    good, _bad = dumps.parse_raw(_dump_lines(t))
    return good.select(
        "source", "raw_name", "raw_phone", "raw_website", "category", "quality_score",
        F.try_variant_get("extra", "$.listing_no", "string").alias("listing_no"),
    )


@query("src_02_rejected_lines", "select count(*) as lines from discovery_results where record_id % 10 = 0")
def _(t):
    return dumps.parse_raw(_dump_lines(t))[1].agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src_03_osm_records",
    """select company_id as osm_id, name as raw_name, 'overpass' as source, phone as raw_phone, website_url as raw_website, email as raw_email, city || ', ' || postal_code as raw_address
  from companies where company_id % 7 <> 0""",
)
def _(t):
    c = t.companies
    named = F.when(F.col("company_id") % 7 != 0, F.col("name"))
    odd = F.col("company_id") % 2 == 1
    tags = F.map_filter(
        F.create_map(
            F.when(odd, "name").otherwise("name:en"), named, F.when(odd, "phone").otherwise("contact:phone"), F.col("phone"),
            F.when(odd, "website").otherwise("contact:website"), F.col("website_url"), F.when(odd, "email").otherwise("contact:email"), F.col("email"),
            F.lit("addr:city"), F.col("city"), F.lit("addr:postcode"), F.col("postal_code"),
        ),
        lambda k, v: v.isNotNull(),
    )
    rows = dumps.osm_records(c.select(F.col("company_id").alias("id"), F.lit("node").alias("type"), tags.alias("tags")))
    return rows.select("osm_id", "raw_name", "source", "raw_phone", "raw_website", "raw_email", "raw_address")


@query(
    "udf_01_source_registry",
    "select 'registry' as source, count(*) as records from supplier union all select 'listing', count(*) from customer",
)
def _(t):
    registry = SourceRegistry()

    @registry.add("registry", tier=2)
    def _read_registry(spark, base):
        return t.supplier.select(F.col("s_name").alias("raw_name"))

    @registry.add("listing", tier=1)
    def _read_listing(spark, base):
        return t.customer.select(F.col("c_name").alias("raw_name"), F.col("c_mktsegment").alias("category"))

    return registry.load(t.spark, t.base).groupBy("source").agg(F.count(F.lit(1)).alias("records"))


@query("snk_04_append_history", "select activity_id, activity_type, created_at from activities")
def _(t):
    from tessera.sources.sinks import append_history

    path = f"{checkpoint_dir(t.spark)}/history-{uuid.uuid4().hex}"
    append_history(t.activities.filter("activity_id % 2 = 0"), path)
    append_history(t.activities.filter("activity_id % 2 = 1"), path)
    return t.spark.read.parquet(path).select("activity_id", "activity_type", "created_at")
