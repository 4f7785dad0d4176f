"""Queries that run jobs, log the runs and read the log back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.plans.stream_queries import StreamTables
from tessera.session import checkpoint_dir
from tessera.sources.sinks import read_runs, run_logged, stream_logged


@query(
    "snk_07_run_log",
    """select 'load_' || source as task, 'success' as status, count(*)::double as rows, count(raw_phone)::double as with_phone, cast(null as double) as batches, 0 as errors, 1 as warnings from discovery_results where source in ('justdial', 'mca') group by source
  union all select 'broken_load', 'failed', null, null, null, 1, 0
  union all select 'stream_events', 'success', count(*)::double, null, 5.0, 0, 0 from events""",
)
def _(t):
    """Two loads, one that fails on a bad number, and a stream; their counts come from the runs themselves."""
    root = f"{checkpoint_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    log = f"{root}/log"
    counts = {"rows": F.count(F.lit(1)), "with_phone": F.count("raw_phone")}
    for source in ("justdial", "mca"):
        rows = t.discovery_results.filter(F.col("source") == source)
        run_logged(rows, log, f"load_{source}", lambda df: df.write.parquet(f"{root}/{source}"), counts, warnings=["partial source"])
    bad = t.discovery_results.select(F.raise_error(F.lit("no number")).cast("string").alias("x"))
    run_logged(bad, log, "broken_load", lambda df: df.write.parquet(f"{root}/bad"), {"rows": F.count("x")})
    stream = StreamTables(t).events.select("event_id", "ts")
    stream_logged(stream, log, "stream_events", lambda df: df.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/events"), {"rows": F.count(F.lit(1))})
    return read_runs(t.spark, log).select(
        "task", "status", F.col("metrics")["rows"].alias("rows"), F.col("metrics")["with_phone"].alias("with_phone"), F.col("metrics")["batches"].alias("batches"),
        F.size("errors").alias("errors"), F.size("warnings").alias("warnings"),
    )
