"""Streams give what their batch twins give, in several batches and in any order of arrival."""
import random
from datetime import timedelta

from pyspark.sql import functions as F

from tessera.sources.feeds import read_events
from tessera.streaming import jobs


def ts(minute):
    return F.expr(f"timestamp '2024-01-01 00:00:00' + interval '{minute}' minute")


def feed(spark, path, rows, schema, parts, seed=1):
    """Write rows in random order as several files, one per micro-batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, schema)


def drain(stream, mode, path, spark):
    state = {}

    def keep(rows, batch):
        state["rows"] = rows.collect()
        state.setdefault("all", []).extend(state["rows"])

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return state["rows"] if mode == "complete" else state["all"]


STAGE = "log_id long, identity_id long, from_stage string, to_stage string, duration_ms long, success boolean, created_at timestamp"
MESSAGE = "event_id long, message_id long, campaign_id long, contact_id long, kind string, ts timestamp"


def stamp(spark, minute):
    return spark.range(1).select(ts(minute).alias("t")).first().t


def test_stage_state(spark, tmp_path):
    at = [stamp(spark, m) for m in range(6)]
    rows = [
        (1, 10, "DISCOVERED", "IDENTITY_RESOLVED", 5, True, at[0]), (2, 10, "IDENTITY_RESOLVED", "WEBSITE_SELECTED", 5, True, at[2]),
        (3, 20, "DISCOVERED", "IDENTITY_RESOLVED", 5, True, at[1]), (4, 20, "NOWHERE", "WEBSITE_CRAWLED", 5, True, at[3]),
        (5, 10, "WEBSITE_SELECTED", "LEAD_SCORED", 5, True, at[4]), (6, 20, "CONTACTS_EXTRACTED", "READY_FOR_ANALYSIS", 5, True, at[5]),
    ]
    batch = feed(spark, str(tmp_path / "in"), rows, STAGE, 3)
    want = {tuple(r) for r in jobs.stage_state(batch).collect()}
    assert {(r[0], r[1]) for r in want} == {(10, "WEBSITE_SELECTED"), (20, "READY_FOR_ANALYSIS")}
    stream = read_events(spark, str(tmp_path / "in"), "stage_log", files_per_trigger=1)
    assert {tuple(r) for r in drain(jobs.stage_state(stream), "complete", str(tmp_path / "s"), spark)} == want
    side = drain(jobs.illegal_steps(read_events(spark, str(tmp_path / "in"), "stage_log")), "append", str(tmp_path / "i"), spark)
    assert {r.log_id for r in side} == {4, 5}


def test_campaign_counters_and_replies(spark, tmp_path):
    at = [stamp(spark, m) for m in range(6)]
    rows = [
        (1, 100, 1, 7, "sent", at[0]), (2, 100, 1, 7, "opened", at[1]), (2, 100, 1, 7, "opened", at[1]), (3, 100, 1, 7, "opened", at[2]),
        (4, 100, 1, 7, "replied", at[3]), (5, 200, 1, 8, "sent", at[4]),
    ]
    batch = feed(spark, str(tmp_path / "in"), rows, MESSAGE, 3)
    got = [tuple(r) for r in jobs.campaign_counters(batch).collect()]
    assert got == [(1, 2, 2, 0, 1)]
    assert [tuple(r) for r in jobs.unique_opens(batch).collect()] == [(1, 1)]
    stream = read_events(spark, str(tmp_path / "in"), "message_events", files_per_trigger=1)
    assert [tuple(r) for r in drain(jobs.campaign_counters(stream), "complete", str(tmp_path / "c"), spark)] == got
    again = read_events(spark, str(tmp_path / "in"), "message_events", files_per_trigger=1)
    assert [tuple(r) for r in drain(jobs.unique_opens(again), "complete", str(tmp_path / "u"), spark)] == [(1, 1)]
    events = read_events(spark, str(tmp_path / "in"), "message_events")
    paused = drain(jobs.pause_on_reply(events.filter("kind = 'sent'"), events.filter("kind = 'replied'")), "append", str(tmp_path / "p"), spark)
    assert [(r.campaign_id, r.contact_id, r.status) for r in paused] == [(1, 7, "replied")]
    enrolled = spark.createDataFrame([(1, 1, 7, "active"), (2, 1, 8, "active")], "enrollment_id long, campaign_id long, contact_id long, status string")
    assert {r.enrollment_id: r.status for r in jobs.replied_enrollments(enrolled, batch).collect()} == {1: "replied", 2: "active"}


def test_freshness(spark, tmp_path):
    """Shuffled files over forty days: rows in time, corrected answers and late rows give what the table gives."""
    r = random.Random(2)
    rows = [
        (r.choice(["html", "ner", "other", None]), r.choice(["a.in", "b.in"]), r.choice(["stored", "request", "request"]), stamp(spark, 0) + timedelta(minutes=r.randrange(40 * 24 * 60)), i)
        for i in range(240)
    ]
    rows += [("html", "c.in", "stored", stamp(spark, 5), 900), ("html", "c.in", "request", stamp(spark, 5), 901), ("html", "c.in", "request", stamp(spark, 5 + 24 * 60), 902)]
    rows += [("html", "c.in", "request", None, 903), rows[0], rows[1], rows[2]]
    schema = "component string, domain string, kind string, ts timestamp, request_id long"
    batch = feed(spark, str(tmp_path / "in"), rows, schema, 4)
    want = sorted((tuple(x) for x in jobs.batch_freshness(batch).collect()), key=str)
    assert {(x[2], x[3]) for x in want} >= {(901, "hit"), (902, "miss"), (903, "miss")} and len(want) == sum(x[2] == "request" for x in rows)
    kinds = set()
    for hours in (24 * 60, 24):
        stream = jobs.freshness(read_events(spark, str(tmp_path / "in"), "component_results", files_per_trigger=1), hours)
        answers = spark.createDataFrame(drain(stream, "append", str(tmp_path / f"f{hours}"), spark), jobs.FRESHNESS)
        kinds |= {(hours, x.outcome, x.revision) for x in answers.collect()}
        assert sorted((tuple(x) for x in jobs.settled_freshness(answers, batch).collect()), key=str) == want
    assert (24 * 60, "hit", 1) in kinds and (24 * 60, "late", 0) not in kinds and (24, "late", 0) in kinds


def test_failed_jobs_need_three_attempts(spark):
    at = [stamp(spark, m) for m in range(3)]
    rows = [(1, "q", "x", at[0]), (1, "q", "y", at[1]), (1, "q", "z", at[2]), (2, "q", "x", at[0])]
    got = jobs.failed_jobs(spark.createDataFrame(rows, "job_id long, queue string, error string, ts timestamp")).collect()
    assert [(r.job_id, r.attempts, r.last_error) for r in got] == [(1, 3, "z")]


RECORD = "record_id long, source string, raw_name string, raw_phone string, raw_email string, raw_website string, raw_address string, gstin string, cin string, quality_score int"


def test_a_business_in_two_batches_opens_one_company(spark, tmp_path):
    """A batch sees what earlier ones opened; a batch that is run again changes nothing."""

    def record(i, name, phone=None, site=None):
        return (i, "justdial", name, phone, None, site, None, None, None, 50)

    first = [record(1, "Harbour Bookshop", "9000000001"), record(2, "Known Bakery", "9000000009"), record(3, "Lonely Cafe")]
    second = [record(11, "Harbor Books", "9000000001"), record(12, "Lonely Cafe"), record(13, "Third Shop", None, "https://third.in"), record(14, "Lonely Caffe"), record(22, "Harbour Bookshopp")]
    companies = spark.createDataFrame([(5, "Known Bakery", "9000000009", None)], "company_id long, name string, phone string, website_url string")
    root = str(tmp_path)
    for batch, rows in enumerate((first, second)):
        jobs.ingest_batch(spark.createDataFrame(rows, RECORD), companies, root, batch, 6)
    want = {
        (1, None, 1, "NEW"), (2, 5, None, "EXISTING"), (3, None, 3, "NEW"), (11, None, 1, "EXISTING"), (12, None, 3, "EXISTING"), (13, None, 13, "NEW"),
        (22, None, 1, "EXISTING"),
    }
    got = {(r.record_id, r.company_id, r.new_company_of, r.result_type) for r in jobs.ingested(spark, companies, root).collect()}
    # 14 is a near copy of 12 in its own batch: set aside as a duplicate
    assert got == want
    jobs.ingest_batch(spark.createDataFrame(second, RECORD), companies, root, 1, 6)
    assert {(r.record_id, r.company_id, r.new_company_of, r.result_type) for r in jobs.ingested(spark, companies, root).collect()} == want


class _Held:
    """Maps of a processor's state in memory; counts the values written to them."""

    def __init__(self):
        self.maps, self.written, self.watermark = {}, 0, 0

    def getMapState(self, name, key, value):
        held, own = self, self.maps.setdefault(name, {})

        class Map:
            getValue = staticmethod(lambda k: own[k])
            containsKey = staticmethod(lambda k: k in own)
            removeKey = staticmethod(lambda k: own.pop(k))
            keys = staticmethod(lambda: iter(list(own)))

            @staticmethod
            def updateValue(k, v):
                own[k] = v
                held.written += sum(len(x) if isinstance(x, list) else 1 for x in v)

        return Map

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_busy_freshness_key_writes_in_proportion(spark, monkeypatch):
    """Thousands of results of one key and day are a few spans; with any size of chunk the last answers are the table's."""
    from pyspark.sql import Row

    hour, rng = jobs.DAY // 24, random.Random(5)
    rows = [Row(kind=rng.choice(["stored", "request"]), request_id=i, at=20_000 * jobs.DAY + rng.randrange(jobs.DAY)) for i in range(6000)]
    rows += [Row(kind=rng.choice(["stored"] + ["request"] * 20), request_id=i, at=rng.randrange(20_010, 20_060) * jobs.DAY + rng.randrange(24) * hour) for i in range(6000, 6400)]
    rng.shuffle(rows)
    stored = sorted(r.at for r in rows if r.kind == "stored")
    want = {r.request_id: "hit" if any(s <= r.at < s + 24 * hour for s in stored) else "miss" for r in rows if r.kind == "request"}
    assert set(want.values()) == {"hit", "miss"}
    for chunk in (7, 20_000):
        monkeypatch.setattr(jobs, "CHUNK", chunk)
        held, job, got = _Held(), jobs._Freshness({}, 24 * hour, 31 * jobs.DAY), {}
        job.init(held)
        for i in range(4):
            for a in job.handleInputRows(("html", "a.in"), iter(rows[i::4]), held):
                assert a.revision == (a.request_id in got)
                got[a.request_id] = a.outcome
        assert got == want
        assert held.written < 20 * len(rows)
        assert sum(len(v[0]) for v in held.maps["spans"].values()) < 200


def test_a_large_table_lands_in_files_of_bounded_size(spark, monkeypatch):
    from tessera.plans import stream_queries
    from tessera.plans.views import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    small = stream_queries.StreamTables(tables)
    small.lineitem
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 300)
    large = stream_queries.StreamTables(tables)
    batches = []
    q = large.lineitem.writeStream.foreachBatch(lambda rows, i: batches.append(rows.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    landed = lambda s: [r["count"] for r in spark.read.parquet(s._landed["lineitem"]).groupBy(F.input_file_name()).count().collect()]
    assert len(landed(small)) == 5 and max(landed(large)) < 600
    assert len(batches) == 5 and sum(batches) == sum(landed(large)) == tables.lineitem.count()
