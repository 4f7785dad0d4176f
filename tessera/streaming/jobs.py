"""Structured Streaming jobs; each aggregate is the same function as its batch twin."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.aggregates import STAGES, provider_totals, source_totals, with_reliability
from tessera.operators.filters import COMPONENT_HOURS, DEFAULT_HOURS
from tessera.operators.resolution import ingest_results
from tessera.session import cut_lineage

# Next stage after each completed one; anything else ends at the last stage.
NEXT_STAGE = {
    "DISCOVERED": "IDENTITY_RESOLVED",
    "IDENTITY_RESOLVED": "WEBSITE_SELECTED",
    "WEBSITE_SELECTED": "WEBSITE_CRAWLED",
    "WEBSITE_CRAWLED": "CONFIDENCE_EVALUATED",
    "CONFIDENCE_EVALUATED": "ADAPTIVE_ENRICHMENT",
    "ADAPTIVE_ENRICHMENT": "CONTACTS_EXTRACTED",
}
# The stage that a resumed identity goes back to.
PREVIOUS_STAGE = {
    "IDENTITY_RESOLVED": "DISCOVERED",
    "WEBSITE_SELECTED": "IDENTITY_RESOLVED",
    "WEBSITE_CRAWLED": "WEBSITE_SELECTED",
    "CONFIDENCE_EVALUATED": "WEBSITE_CRAWLED",
    "ADAPTIVE_ENRICHMENT": "CONFIDENCE_EVALUATED",
    "AI_INTELLIGENCE": "ADAPTIVE_ENRICHMENT",
    "LEAD_SCORED": "AI_INTELLIGENCE",
    "COMPLETE": "LEAD_SCORED",
    "READY": "COMPLETE",
}
TERMINAL_STAGE = STAGES[-1]


def _case(column: Column, mapping: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def next_stage(completed: Column) -> Column:
    return _case(completed, NEXT_STAGE, TERMINAL_STAGE)


def resume_points(states: DataFrame) -> DataFrame:
    """Where each identity starts again: the stage before its current one, and the stage that re-runs."""
    before = _case(F.col("stage"), PREVIOUS_STAGE, "DISCOVERED")
    return states.select("identity_id", "stage", before.alias("resume_from"), next_stage(before).alias("next_stage"))


def is_legal(log: DataFrame) -> Column:
    """Is the step a known one, leading where the map says?"""
    return F.coalesce(F.col("from_stage").isin(*STAGES) & (F.col("to_stage") == next_stage(F.col("from_stage"))), F.lit(False))


def illegal_steps(log: DataFrame) -> DataFrame:
    """Side output: steps outside the map, as they arrive."""
    return log.filter(~is_legal(log))


def stage_state(log: DataFrame) -> DataFrame:
    """Current stage of every identity over its legal steps: the latest by event time, then log id.

    The same on a stream (update mode) and on a table. A maximum needs no order of arrival.
    """
    return (
        log.filter(is_legal(log))
        .groupBy("identity_id")
        .agg(F.max(F.struct("created_at", "log_id", "to_stage", "duration_ms")).alias("latest"), F.count(F.lit(1)).alias("steps"))
        .select("identity_id", F.col("latest.to_stage").alias("stage"), F.col("latest.created_at").alias("since"), "steps")
    )


def dedup_events(events: DataFrame, delay: str | None = None) -> DataFrame:
    """One row per event id, however late its copies come.

    On a stream the ids seen are kept in the state store; a ``delay`` bounds them, but then rows later than it are dropped.
    """
    if events.isStreaming and delay:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def campaign_counters(events: DataFrame) -> DataFrame:
    """Sent, opened, clicked and replied totals per campaign, every repeated hit counted."""
    return dedup_events(events).groupBy("campaign_id").agg(
        F.count_if(F.col("kind") == "sent").alias("sent_count"),
        F.count_if(F.col("kind") == "opened").alias("opened_count"),
        F.count_if(F.col("kind") == "clicked").alias("clicked_count"),
        F.count_if(F.col("kind") == "replied").alias("replied_count"),
    )


def unique_opens(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Messages opened at least once per campaign; late rows count unless a ``delay`` is set."""
    opens = events.filter("kind = 'opened'")
    if opens.isStreaming and delay:
        firsts = opens.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["campaign_id", "message_id"])
    else:
        firsts = opens.dropDuplicates(["campaign_id", "message_id"])
    return firsts.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("unique_opens"))


def replied_enrollments(enrollments: DataFrame, events: DataFrame) -> DataFrame:
    """Enrolments with status ``replied`` where their contact answered; the others stay as they are.

    ``events`` is the reply table kept by :func:`pause_on_reply`, or a table of message events.
    """
    replies = events.filter("kind = 'replied'").select("campaign_id", "contact_id").distinct().withColumn("answered", F.lit(True))
    return enrollments.join(replies, ["campaign_id", "contact_id"], "left").select(
        "enrollment_id", "campaign_id", "contact_id", F.when(F.col("answered"), "replied").otherwise(F.col("status")).alias("status")
    )


def pause_on_reply(sent: DataFrame, replies: DataFrame, days: int = 30, delay: str | None = None) -> DataFrame:
    """Replies joined to the messages they answer, stream to stream, within ``days`` of sending.

    No arrival is too late unless a ``delay`` is set, which bounds the state.
    """
    if delay:
        sent, replies = sent.withWatermark("ts", delay), replies.withWatermark("ts", delay)
    s = sent.select(F.col("message_id"), "campaign_id", "contact_id", F.col("ts").alias("sent_ts"))
    r = replies.select(F.col("message_id").alias("reply_to"), F.col("ts").alias("reply_ts"))
    on = F.expr(f"message_id = reply_to and reply_ts >= sent_ts and reply_ts <= sent_ts + interval '{days}' day")
    return s.join(r, on).select("campaign_id", "contact_id", "message_id", "reply_ts", F.lit("replied").alias("status"))


def reliability_stream(runs: DataFrame) -> DataFrame:
    """Running totals, rates and score per source."""
    return with_reliability(source_totals(runs))


def provider_stream(log: DataFrame) -> DataFrame:
    """Running totals per search provider."""
    return provider_totals(log)


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest stage, status and percent per company, with the seconds since its first event."""
    return (
        events.groupBy("company_id")
        .agg(F.max(F.struct("ts", "percent", "stage", "status")).alias("l"), F.min("ts").alias("started"))
        .select(
            "company_id", "l.stage", "l.status", "l.percent",
            F.when(
                F.col("l.status").isin("completed", "failed"),
                F.floor((F.unix_micros("l.ts") - F.unix_micros("started")) / 1000000),
            ).alias("duration_sec"),
        )
    )


def per_minute(events: DataFrame, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Events per minute and kind; late arrivals count unless a ``delay`` is set, which bounds the state."""
    e = events.withWatermark(ts, delay) if events.isStreaming and delay else events
    return e.groupBy(F.window(ts, "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("minute"), "event_type", "events"
    )


def failed_jobs(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Jobs with ``limit`` or more failed attempts, with their count and latest error."""
    return (
        attempts.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("attempts"), F.max(F.struct("ts", "error")).alias("l"))
        .filter(F.col("attempts") >= limit)
        .select("job_id", "attempts", F.col("l.error").alias("last_error"), F.col("l.ts").alias("failed_at"))
    )


DAY = 86_400_000_000  # microseconds
#: What a stream of requests gives: ``revision`` 1 corrects an earlier answer, outcome ``late`` is not an answer.
FRESHNESS = "component string, domain string, kind string, request_id long, at long, outcome string, revision int"


#: Rows of a key that are looked at together, and open misses in one value of its state.
CHUNK = 20_000
HOUR = DAY // 24


class _Freshness(StatefulProcessor):
    """What one (component, domain) still knows: the spans in which requests hit, and the open misses.

    A result stored at s answers requests in [s, s + limit); what is kept is the union of these spans, which is one span as long as
    results come within the limit of each other. Misses are kept by hour, in lists of bounded length; a moment becomes covered
    once, so they are read again only where a span grows.
    """

    def __init__(self, limits: dict[str, int], other: int, lateness: int):
        self.limits, self.other, self.lateness = limits, other, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # spans by the day they begin in, cut at the ends of days; misses by hour and number of the list
        self.spans = handle.getMapState("spans", "day long", "first array<long>, end array<long>")
        self.misses = handle.getMapState("misses", "hour long, part int", "at array<long>, request array<long>")
        self.parts = handle.getMapState("parts", "hour long", "parts int")

    def _limit(self, component: str | None) -> int:
        return self.limits.get(component, self.other)

    def _day(self, known: dict, day: int) -> list[tuple[int, int]]:
        if day not in known:
            known[day] = list(zip(*self.spans.getValue((day,)))) if self.spans.containsKey((day,)) else []
        return known[day]

    def _cover(self, known: dict, stored: list[int], limit: int) -> list[tuple[int, int]]:
        """Add the spans of stored results; the pieces that were not covered before."""
        wanted = _union((s, s + limit) for s in stored)
        fresh: list[tuple[int, int]] = []
        for first, end in wanted:
            for day in range(first // DAY, (end - 1) // DAY + 1):
                piece = (max(first, day * DAY), min(end, (day + 1) * DAY))
                old = self._day(known, day)
                gaps = _minus(piece, old)
                if gaps:
                    fresh += gaps
                    known[day] = _union([*old, *gaps])
                    self.spans.updateValue((day,), ([x for x, _ in known[day]], [y for _, y in known[day]]))
                    self._await((day + 1) * DAY)
        return _union(fresh)

    def _await(self, end: int) -> None:
        self.handle.registerTimer((end + self.lateness) // 1000 + 1)

    def _answered(self, fresh: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Open misses in newly covered pieces, which are open no longer."""
        hours: dict[int, list[tuple[int, int]]] = {}
        for first, end in fresh:
            for hour in range(first // HOUR, (end - 1) // HOUR + 1):
                hours.setdefault(hour, []).append((first, end))
        # few hours have open misses, so their list is read instead of asking for every covered hour
        waiting = [k[0] for k in self.parts.keys()] if hours else []
        for hour, pieces in ((h, hours[h]) for h in waiting if h in hours):
            left = []
            parts = self.parts.getValue((hour,))[0]
            for part in range(parts):
                for at, request in zip(*self.misses.getValue((hour, part))):
                    if _inside(pieces, at):
                        yield at, request
                    else:
                        left.append((at, request))
                self.misses.removeKey((hour, part))
            self.parts.removeKey((hour,))
            self._open({hour: left})

    def _open(self, by_hour: dict[int, list[tuple[int, int]]]) -> None:
        for hour, rows in by_hour.items():
            if not rows:
                continue
            part = self.parts.getValue((hour,))[0] if self.parts.containsKey((hour,)) else 0
            if part:
                # the last list is filled up first
                last = list(zip(*self.misses.getValue((hour, part - 1))))
                if len(last) < CHUNK:
                    part, rows = part - 1, last + rows
            for i in range(0, len(rows), CHUNK):
                some = rows[i : i + CHUNK]
                self.misses.updateValue((hour, part), ([a for a, _ in some], [r for _, r in some]))
                part += 1
            self.parts.updateValue((hour,), (part,))
            self._await((hour + 1) * HOUR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        limit, oldest = self._limit(key[0]), timerValues.getCurrentWatermarkInMs() * 1000 - self.lateness
        make = Row("component", "domain", *FRESHNESS_FIELDS)
        give = lambda *x: make(key[0], key[1], *x)
        known: dict[int, list[tuple[int, int]]] = {}
        rows = iter(rows)
        while some := list(islice(rows, CHUNK)):
            stored, asked = [], []
            for row in some:
                at = row.at
                if at is None:  # without a time nothing is known to be stored before it
                    if row.kind != "stored":
                        yield give("request", row.request_id, None, "miss", 0)
                elif at < oldest:
                    yield give(row.kind, row.request_id, at, "late", 0)
                elif row.kind == "stored":
                    stored.append(at)
                else:
                    asked.append((at, row.request_id))
            for at, request in self._answered(self._cover(known, stored, limit)):
                yield give("request", request, at, "hit", 1)
            open_rows: dict[int, list[tuple[int, int]]] = {}
            for at, request in asked:
                hit = _inside(self._day(known, at // DAY), at)
                if not hit:
                    open_rows.setdefault(at // HOUR, []).append((at, request))
                yield give("request", request, at, "hit" if hit else "miss", 0)
            self._open(open_rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 - self.lateness
        for hour in range(-(-end // HOUR) - 2, -(-end // HOUR) + 1):
            # rows of hours that ended before it can't be met any more
            if (hour + 1) * HOUR <= end + 1000 and self.parts.containsKey((hour,)):
                for part in range(self.parts.getValue((hour,))[0]):
                    self.misses.removeKey((hour, part))
                self.parts.removeKey((hour,))
        for day in range(-(-end // DAY) - 2, -(-end // DAY) + 1):
            if (day + 1) * DAY <= end + 1000 and self.spans.containsKey((day,)):
                self.spans.removeKey((day,))
        return iter([])

    def close(self) -> None:
        pass


def _union(spans) -> list[tuple[int, int]]:
    """Disjoint spans [first, end) in order, over the same moments."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _minus(piece: tuple[int, int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a piece lies outside ordered disjoint spans."""
    first, end = piece
    out = []
    for a, b in spans:
        if b <= first or a >= end:
            continue
        if a > first:
            out.append((first, a))
        first = max(first, b)
    return out + [(first, end)] if first < end else out


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    place = bisect_right(spans, at, key=lambda x: x[0])
    return place > 0 and at < spans[place - 1][1]


FRESHNESS_FIELDS = ["kind", "request_id", "at", "outcome", "revision"]


def freshness(events: DataFrame, lateness_hours: int = 24 * 7) -> DataFrame:
    """Hit or miss of every request against the last stored result of its (component, domain), in any order of arrival.

    ``events`` has component, domain, kind (``stored`` or ``request``), ts and request_id. A request is answered when it arrives;
    a stored result that arrives after a request it precedes turns the miss into a hit, by a row of revision 1. State is the spans
    covered by stored results and the open misses, dropped by a timer when the watermark is ``lateness_hours`` past them. Rows
    older than that are not lost: they come out with outcome ``late``, and :func:`settled_freshness` judges them.
    """
    spark = events.sparkSession
    # maps and timers are kept by this store only
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    limits = {name: hours * HOUR for name, hours in COMPONENT_HOURS.items()}
    # the time goes on as a number: rows behind the watermark would be filtered out by their timestamp
    rows = events.withWatermark("ts", "1 hour").select("component", "domain", "kind", "request_id", F.unix_micros("ts").alias("at"))
    processor = _Freshness(limits, DEFAULT_HOURS * HOUR, lateness_hours * HOUR)
    return rows.groupBy("component", "domain").transformWithState(processor, FRESHNESS, "append", "EventTime")


def settled_freshness(answers: DataFrame, events: DataFrame) -> DataFrame:
    """(component, domain, request_id, outcome) from the rows of :func:`freshness` and the table of all events.

    The last revision of an answer counts. Keys with late rows are judged as a whole by :func:`batch_freshness`.
    """
    keys = answers.filter("outcome = 'late'").select(F.col("component").alias("c"), F.col("domain").alias("d")).distinct()
    same = F.col("component").eqNullSafe(F.col("c")) & F.col("domain").eqNullSafe(F.col("d"))
    last = answers.join(keys, same, "left_anti").groupBy("component", "domain", "request_id", "at").agg(
        F.max_by("outcome", "revision").alias("outcome"), F.count_if(F.col("revision") == 0).alias("n")
    )
    # repeated requests are answered once each
    given = last.select("component", "domain", "request_id", "outcome", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    return given.unionByName(batch_freshness(events.join(keys, same, "left_semi")))


def batch_freshness(events: DataFrame) -> DataFrame:
    """Table twin of :func:`freshness`: the newest result stored before each request, by an as-of maximum.

    Rows are split by (component, domain, day); the last result of earlier days is carried in, and
    only results of the same or the previous seven days can still be alive.
    """
    from pyspark.sql import Window

    from tessera.operators.filters import component_limit

    day = F.date_trunc("day", F.col("ts"))
    e = events.withColumns({"day": day, "stored_ts": F.when(F.col("kind") == "stored", F.col("ts"))})
    keys = ["component", "domain"]
    inside = Window.partitionBy(*keys, "day").orderBy(F.col("ts"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("today", F.max("stored_ts").over(inside))
    days = e.groupBy(*keys, "day").agg(F.max("stored_ts").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*(F.col(c).alias(f"_{c}") for c in [*keys, "day"]), F.max("last").over(earlier).alias("carried"))
    # null keys and times are groups like any other
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "day"]]
    joined = e.filter("kind = 'request'").join(days, same)
    stored = F.coalesce("today", "carried")
    hit = F.coalesce(F.col("ts") - stored < component_limit(), F.lit(False))
    return joined.select(*keys, "request_id", F.when(hit, "hit").otherwise("miss").alias("outcome"))


def ingest_batch(records: DataFrame, companies: DataFrame, root: str, batch: int, first_new_id: int) -> None:
    """Load one micro-batch into ``root``: its rows, and the companies that it opens, in folders named by the batch id.

    The batch meets the given companies and those that earlier batches opened, and nothing else: a batch that is run again, also
    after later ones, reads the same state and writes the same folders. A company opened for record r has the id
    ``first_new_id`` + r, so known companies come first among equals.
    """
    spark = records.sparkSession
    known = companies.select("company_id", "phone", "website_url", "name")
    if batch > 0:
        earlier = spark.read.schema(OPENED_SCHEMA + ", batch long").parquet(f"{root}/opened").filter(F.col("batch") < batch)
        known = known.unionByName(earlier.select(*known.columns))
    records = cut_lineage(records)
    load = cut_lineage(ingest_results(records, known))
    load.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    opened = records.join(load.filter("result_type = 'NEW'").select("record_id"), "record_id").select(
        (F.col("record_id") + first_new_id).alias("company_id"), F.col("raw_phone").alias("phone"), F.col("raw_website").alias("website_url"), F.col("raw_name").alias("name")
    )
    opened.write.mode("overwrite").parquet(f"{root}/opened/batch={batch}")


OPENED_SCHEMA = "company_id long, phone string, website_url string, name string"


def ingest_stream(stream: DataFrame, companies: DataFrame, root: str):
    """Load a stream of records, each micro-batch after the ones before it (see :func:`ingest_batch`). Returns the started query."""
    first_new_id = companies.agg(F.coalesce(F.max("company_id"), F.lit(-1)) + 1).first()[0]

    def apply(rows: DataFrame, batch: int) -> None:
        ingest_batch(rows, companies, root, batch, first_new_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def ingested(spark: SparkSession, companies: DataFrame, root: str) -> DataFrame:
    """All loaded records, shaped like :func:`ingest_results`: ``new_company_of`` names the record that opened a new company."""
    first_new_id = companies.agg(F.coalesce(F.max("company_id"), F.lit(-1)) + 1).first()[0]
    new = F.col("company_id") >= first_new_id
    rows = spark.read.parquet(f"{root}/rows")
    return rows.select(
        "record_id", F.when(~new, F.col("company_id")).alias("company_id"),
        F.when(new, F.col("company_id") - first_new_id).otherwise(F.col("new_company_of")).alias("new_company_of"), "result_type", "confidence", "reason",
    )
