"""Exports, appends, upserts on files and run records."""
from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.operators.sets import upsert

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def _text(*columns: str) -> Column:
    """First non-empty of the columns, else empty text."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def _yes_no(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit(False)), "Yes").otherwise("No")


def csv_frame(results: DataFrame) -> DataFrame:
    """The eight export columns of unique results joined to companies, company values first.

    ``results`` is the outcome of :func:`tessera.operators.joins.results_with_companies`. A lead score of 0 is
    written as empty text.
    """
    return results.select(
        _text("name", "raw_name").alias("Company Name"),
        _text("phone", "raw_phone").alias("Phone"),
        _text("raw_email").alias("Email"),
        _text("website_url", "raw_website").alias("Website"),
        _text("raw_address").alias("Address"),
        _text("source").alias("Source"),
        _text("lead_score").alias("Lead Score"),
        _text("stage").alias("Pipeline Stage"),
    )


def export_csv(frame: DataFrame, path: str) -> None:
    """Write an export as CSV with a header, also when it has no rows."""
    if frame.isEmpty():
        names = F.array(*[F.lit(c) for c in frame.columns])
        frame.sparkSession.range(1).select(F.array_join(names, ",").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    frame.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_frames(results: DataFrame, contacts: DataFrame, intelligence: DataFrame, signals: DataFrame) -> dict[str, DataFrame]:
    """The four sheets of the full export: Companies, Contacts, Intelligence, Signals."""
    names = results.filter("company_id is not null").select("company_id", F.col("name").alias("company_name")).distinct()
    sheets = {
        "Companies": results.select(
            _text("name", "raw_name").alias("Company Name"),
            _text("phone", "raw_phone").alias("Phone"),
            _text("raw_email").alias("Email"),
            _text("website_url", "raw_website").alias("Website"),
            _text("raw_address").alias("Address"),
            _text("industry").alias("Industry"),
            _text("source").alias("Source"),
            F.coalesce("lead_score", F.lit(0)).alias("Lead Score"),
            _text("stage").alias("Pipeline Stage"),
        ),
        "Contacts": contacts.join(names, "company_id").select(
            _text("company_name").alias("Company Name"),
            _text("first_name").alias("First Name"),
            _text("last_name").alias("Last Name"),
            _text("email").alias("Email"),
            _text("phone").alias("Phone"),
            _text("title").alias("Title"),
            _yes_no("is_decision_maker").alias("Is Decision Maker"),
            _text("linkedin_url").alias("LinkedIn"),
        ),
        "Intelligence": intelligence.join(names, "company_id").select(
            _text("company_name").alias("Company Name"),
            F.coalesce("digital_maturity_score", F.lit(0)).alias("Digital Maturity Score"),
            F.coalesce(F.array_join("services_needed", ", "), F.lit("")).alias("Services Needed"),
            _yes_no("crm_detected").alias("CRM Detected"),
            _yes_no("whatsapp_detected").alias("WhatsApp Detected"),
            _yes_no("booking_detected").alias("Booking Detected"),
        ),
        "Signals": signals.join(names, "company_id").select(
            _text("company_name").alias("Company Name"),
            F.coalesce("intent_score", F.lit(0)).alias("Intent Score"),
            _yes_no("no_website").alias("No Website"),
            _yes_no("no_crm").alias("No CRM"),
            _yes_no("no_whatsapp").alias("No WhatsApp"),
            _yes_no("poor_seo").alias("Poor SEO"),
            _yes_no("no_booking_system").alias("No Booking System"),
        ),
    }
    return sheets


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    for name, df in sheets.items():
        export_csv(df, f"{path}/{name}")


def append_history(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append events to a history partitioned by day."""
    df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def upsert_files(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: str) -> str:
    """Lay updates over a Parquet table and return the folder of the new version.

    The new version is written beside the old one, which stays readable: a failed write changes
    nothing, and the same updates give the same rows when written again.
    """
    target = spark.read.parquet(path)
    version = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    upsert(target, updates, keys, order).write.parquet(version)
    return version


RUN_SCHEMA = (
    "task string, status string, version string, duration_sec double, confidence double, warnings array<string>, "
    "errors array<string>, metrics map<string,double>, ts timestamp"
)


def log_run(spark: SparkSession, path: str, run: dict) -> None:
    """Append one run record (task, status, version, duration, confidence, warnings, errors, metrics)."""
    row = {"warnings": [], "errors": [], "metrics": {}, "confidence": None, "version": "1", **run}
    row.setdefault("ts", datetime.now(timezone.utc))
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run records of a log."""
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def _record(task: str, began: float, error: Exception | None, metrics: dict[str, object], warnings: list[str] | None) -> dict:
    numbers = {k: float(v) for k, v in metrics.items() if v is not None}
    status, errors = ("failed", [f"{type(error).__name__}: {error}"[:1000]]) if error else ("success", [])
    return {"task": task, "status": status, "duration_sec": time.time() - began, "metrics": numbers, "errors": errors, "warnings": warnings or []}


def run_logged(
    rows: DataFrame, path: str, task: str, action: Callable[[DataFrame], object], metrics: dict[str, Column], warnings: list[str] | None = None
) -> bool:
    """Run ``action`` on ``rows`` and append its run record; a failure is recorded, not raised. Whether it succeeded.

    The metrics are aggregates observed while the action runs, so nothing is computed twice; a failed run has none.
    """
    seen, began, error = Observation(task), time.time(), None
    watched = rows.observe(seen, *(c.alias(k) for k, c in metrics.items()))
    try:
        action(watched)
    except Exception as e:  # the record is where a failed run is looked for
        error = e
    log_run(rows.sparkSession, path, _record(task, began, error, {} if error else seen.get, warnings))
    return error is None


class _Progress(StreamingQueryListener):
    """Sums the metrics that micro-batches observe under one name, and knows which queries have ended."""

    def __init__(self, name: str, metrics: list[str]):
        self.name, self.batches, self.total = name, 0, dict.fromkeys(metrics, 0.0)
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        observed = event.progress.observedMetrics.get(self.name)
        if observed is not None and event.progress.numInputRows:
            self.batches += 1
            for k in self.total:
                self.total[k] += float(observed[k] or 0)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.id))
            self.changed.notify_all()


def stream_logged(rows: DataFrame, path: str, task: str, start: Callable[[DataFrame], object], metrics: dict[str, Column]) -> bool:
    """Run a stream to its end and append its run record: summed metrics of its micro-batches and their number.

    ``start`` starts the watched stream (with a trigger that ends) and returns the query; metrics are counts or sums. A listener
    hears of every micro-batch, however many there are, and of the end after the last of them.
    """
    spark, began, error = rows.sparkSession, time.time(), None
    heard = _Progress(f"{task}-{uuid.uuid4().hex}", list(metrics))
    spark.streams.addListener(heard)
    try:
        running = start(rows.observe(heard.name, *(c.alias(k) for k, c in metrics.items())))
        try:
            running.awaitTermination()
        except Exception as e:
            error = e
        with heard.changed:
            heard.changed.wait_for(lambda: str(running.id) in heard.ended, timeout=60)
    finally:
        spark.streams.removeListener(heard)
    log_run(spark, path, _record(task, began, error, heard.total | {"batches": heard.batches}, None))
    return error is None
