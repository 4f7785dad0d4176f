"""Metrics over whole tables: dashboards, job and source statistics, campaigns, coverage, health."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import clamp, points, present, round_half_up, truthy
from tessera.operators.skew import best_per

# Stages in processing order, and the stages that count as hot.
STAGES = (
    "DISCOVERED",
    "IDENTITY_RESOLVED",
    "WEBSITE_SELECTED",
    "WEBSITE_CRAWLED",
    "CONFIDENCE_EVALUATED",
    "ADAPTIVE_ENRICHMENT",
    "CONTACTS_EXTRACTED",
    "READY_FOR_ANALYSIS",
)
HOT_STAGES = ("Qualified", "Contacted", "Meeting Scheduled", "Proposal Sent")
WON_STAGE = "Won"
HOT_VALUE = 5000


def stage_dimension(df: DataFrame) -> DataFrame:
    """The eight stages with their order, as a small table."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.ordinal", "r.stage")


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """top / bottom, and a default where bottom is 0."""
    return F.when(bottom == 0, F.lit(default)).otherwise(top / bottom)


def dashboard_kpis(companies: DataFrame, signals: DataFrame, hot=HOT_STAGES, won: str = WON_STAGE) -> DataFrame:
    """Total, hot, value of hot, conversion percent (one decimal) and mean intent, one row."""
    c = companies.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(F.col("stage").isin(*hot)).alias("hot_leads"),
        F.count_if(F.col("stage") == won).alias("won"),
    )
    s = signals.agg(
        F.coalesce(round_half_up(F.sum(F.coalesce("intent_score", F.lit(0))) / F.count(F.lit(1))), F.lit(0)).alias("avg_intent")
    )
    # two one-row frames meet on a constant key
    both = c.withColumn("k", F.lit(1)).join(s.withColumn("k", F.lit(1)), "k")
    conversion = F.round(ratio(F.col("won") * 100, F.col("total_leads")), 1)
    return both.select(
        "total_leads", "hot_leads", (F.col("hot_leads") * HOT_VALUE).alias("stage_value"),
        conversion.alias("conversion_pct"), "avg_intent",
    )


def leads_by_industry(companies: DataFrame) -> DataFrame:
    return companies.groupBy(F.coalesce(F.nullif("industry", F.lit("")), F.lit("Unknown")).alias("industry")).agg(
        F.count(F.lit(1)).alias("leads")
    )


def job_stats(jobs: DataFrame, user: str | None = None) -> DataFrame:
    """Job counts by status and result totals; a new-count of 0 or null falls back to the created count."""
    mine = jobs.filter(F.col("user_id") == user) if user else jobs

    def status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    new = F.coalesce(F.nullif("total_new", F.lit(0)), "total_companies_created", F.lit(0))
    return mine.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        status("completed").alias("completed_jobs"),
        status("failed").alias("failed_jobs"),
        status("running").alias("running_jobs"),
        F.coalesce(F.sum("total_raw_results"), F.lit(0)).alias("total_discovered"),
        F.coalesce(F.sum("total_after_dedup"), F.lit(0)).alias("total_after_dedup"),
        F.coalesce(F.sum(new), F.lit(0)).alias("total_new"),
        F.coalesce(F.sum("total_existing"), F.lit(0)).alias("total_existing"),
    )


def dedup_summary(marked: DataFrame) -> DataFrame:
    """Duplicate volume and known/new split per job of a marked load."""
    return marked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(~F.col("is_duplicate")).alias("unique_records"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("result_type") == "NEW").alias("new_records"),
        F.count_if(F.col("result_type") == "EXISTING").alias("existing_records"),
    )


def per_source_counts(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results per source of each job as a map, with the job's status.

    Sources are a small registered set, so the map has a bounded number of entries.
    """
    counts = results.groupBy("job_id", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~truthy("is_duplicate")).alias("kept")
    )
    failed = errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("error_count"))
    jobs = counts.groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("per_source"),
        F.sum("n").alias("total_raw"),
        F.sum("kept").alias("unique_results"),
    )
    joined = jobs.join(failed, "job_id", "full_outer")
    status = (
        F.when(F.coalesce("unique_results", F.lit(0)) == 0, "failed")
        .when(F.coalesce("error_count", F.lit(0)) > 0, "partial")
        .otherwise("completed")
    )
    return joined.select("job_id", "per_source", F.coalesce("total_raw", F.lit(0)).alias("total_raw"), status.alias("status"))


def is_blocked(error: str = "error") -> Column:
    """Did the error text say that the source refused us?"""
    return F.coalesce(F.lower(error).rlike("block|captcha|403|429"), F.lit(False))


def classify_runs(runs: DataFrame) -> DataFrame:
    blocked = is_blocked()
    return runs.withColumns(
        {"blocked": blocked, "successful": F.col("error").isNull() & ~blocked & (F.col("results") > 0)}
    )


def source_totals(runs: DataFrame) -> DataFrame:
    """Running totals per source; also the aggregate of the streaming job."""
    r = classify_runs(runs)
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("successful").alias("successful_runs"),
        F.count_if(~F.col("successful")).alias("failed_runs"),
        F.count_if("blocked").alias("blocked_runs"),
        F.sum("results").alias("total_results"),
        F.sum("contacts").alias("total_contacts"),
        F.sum("websites").alias("total_websites"),
        F.sum("duplicates").alias("duplicate_count"),
        F.sum("duration_sec").alias("total_runtime_sec"),
        F.max(F.when(F.col("successful"), F.col("ts"))).alias("last_success_at"),
        F.max(F.when(~F.col("successful"), F.col("ts"))).alias("last_failure_at"),
    )


def with_reliability(totals: DataFrame) -> DataFrame:
    """Nine rates and the 0-100 reliability score of source totals."""
    c = F.col
    rated = totals.withColumns(
        {
            "success_rate": ratio(c("successful_runs"), c("total_runs"), 0.5),
            "blocked_rate": ratio(c("blocked_runs"), c("total_runs")),
            "duplicate_rate": ratio(c("duplicate_count"), c("total_results")),
            "avg_contacts_per_run": ratio(c("total_contacts"), c("successful_runs")),
            "avg_websites_per_run": ratio(c("total_websites"), c("successful_runs")),
            "avg_runtime_sec": ratio(c("total_runtime_sec"), c("total_runs")),
            "avg_results_per_run": ratio(c("total_results"), c("successful_runs")),
            "website_rate": ratio(c("total_websites"), c("total_results")),
            "phone_rate": ratio(c("total_contacts"), c("total_results")),
        }
    )
    raw = (
        c("success_rate") * 40
        + F.least(F.lit(1.0), c("avg_contacts_per_run") / 5) * 20
        + F.least(F.lit(1.0), c("avg_websites_per_run") / 5) * 20
        - c("duplicate_rate") * 20
        - c("blocked_rate") * 20
    )
    return rated.withColumn("reliability_score", F.bround(clamp(raw, 0.0, 100.0), 2))


def source_reliability(runs: DataFrame) -> DataFrame:
    return with_reliability(source_totals(runs))


def source_status(reliability: DataFrame) -> DataFrame:
    """ok / degraded / blocked / unknown; later rules override earlier ones."""
    rate = ratio(F.col("blocked_runs"), F.col("total_runs"))
    status = (
        F.when(F.col("total_runs") == 0, "unknown")
        .when(F.col("reliability_score") < 30, "degraded")
        .when(rate > 0.5, "blocked")
        .when(rate > 0.2, "degraded")
        .otherwise("ok")
    )
    return reliability.select("source", "reliability_score", "total_runs", "successful_runs", "blocked_runs", status.alias("status"))


def source_table(reliability: DataFrame) -> DataFrame:
    """League table by reliability with rates as percents."""
    return reliability.select(
        "source",
        "reliability_score",
        "total_runs",
        F.round(F.col("success_rate") * 100, 1).alias("success_pct"),
        F.round(F.col("blocked_rate") * 100, 1).alias("blocked_pct"),
        F.round("avg_results_per_run", 1).alias("avg_results"),
        F.round(F.col("website_rate") * 100, 1).alias("website_pct"),
        F.round(F.col("phone_rate") * 100, 1).alias("phone_pct"),
        F.round("avg_runtime_sec", 1).alias("avg_seconds"),
    ).orderBy(F.desc("reliability_score"), "source")


def run_telemetry(runs: DataFrame) -> DataFrame:
    """What every discovery run attempted and got, over its source runs."""
    r = classify_runs(runs)
    ok = F.col("error").isNull() & (F.col("results") > 0)
    return r.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if(ok).alias("sources_succeeded"),
        F.count_if(~ok).alias("sources_failed"),
        F.count_if("blocked").alias("sources_blocked"),
        F.sum("results").alias("total_raw_results"),
        F.sum("contacts").alias("total_contacts"),
        F.sum("websites").alias("total_websites"),
        F.round(F.sum("duration_sec"), 2).alias("total_duration_sec"),
    )


def provider_totals(log: DataFrame) -> DataFrame:
    ok = F.col("success")
    return log.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.sum(F.when(ok, F.col("latency_ms")).otherwise(0)).alias("total_latency"),
        F.sum(F.when(ok, F.col("companies_found")).otherwise(0)).alias("total_companies"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
    )


def with_health(totals: DataFrame, as_of: Column) -> DataFrame:
    """Success rate, means over successes, and whether a failure under five minutes old came last."""
    served = F.greatest(F.lit(1), F.col("successful_requests"))
    came_last = F.col("last_failure").isNotNull() & (
        F.col("last_success").isNull() | (F.col("last_failure") > F.col("last_success"))
    )
    recent = as_of - F.col("last_failure") < F.expr("interval '5' minute")
    failed = F.coalesce(came_last & recent, F.lit(False))
    return totals.select(
        "provider",
        (F.col("successful_requests") / F.greatest(F.lit(1), F.col("total_requests"))).alias("success_rate"),
        (F.col("total_latency") / served).alias("avg_latency"),
        (F.col("total_companies") / served).alias("avg_companies"),
        failed.alias("failed_recently"),
        (~failed).alias("is_healthy"),
    )


def provider_health(log: DataFrame, as_of: Column) -> DataFrame:
    return with_health(provider_totals(log), as_of)


def stage_counts(identities: DataFrame) -> DataFrame:
    """Identities per stage, zeros included."""
    n = identities.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return stage_dimension(identities).join(n, "stage", "left").select("ordinal", "stage", F.coalesce("n", F.lit(0)).alias("identities"))


def mean_time_to_ready(log: DataFrame, rows: int | None = None) -> DataFrame:
    """Mean duration in whole seconds over all arrivals at the last stage, or over the newest ``rows`` of them."""
    newest = log.filter((F.col("to_stage") == STAGES[-1]) & F.col("duration_ms").isNotNull())
    if rows is not None:
        newest = newest.orderBy(F.desc("created_at"), F.desc("log_id")).limit(rows)
    mean = F.coalesce(F.avg("duration_ms"), F.lit(0.0))
    return newest.agg(round_half_up(mean / 1000).alias("avg_discovery_time_sec"), F.count(F.lit(1)).alias("log_rows"))


def stage_board(companies: DataFrame) -> DataFrame:
    """Every company on the board with its stage's order and size.

    One row per company rather than one list per stage: stages are few, so lists would each hold a
    large share of the table. The counts come from an eight-row aggregate.
    """
    n = companies.groupBy("stage").agg(F.count(F.lit(1)).alias("companies_in_stage"))
    dim = stage_dimension(companies).join(n, "stage", "left")
    cards = companies.select("stage", "company_id", "name", "lead_score")
    return dim.join(cards, "stage", "left").select(
        "ordinal", "stage", F.coalesce("companies_in_stage", F.lit(0)).alias("companies_in_stage"), "company_id", "name", "lead_score"
    )


def campaign_stats(campaigns: DataFrame, messages: DataFrame) -> DataFrame:
    """Sent, opened, clicked and replied with two-decimal percents; null rates where nothing was sent."""
    m = messages.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if("opened").alias("opened"),
        F.count_if("clicked").alias("clicked"),
        F.count_if("replied").alias("replied"),
    )
    zero = F.lit(0).cast("long")
    j = campaigns.select("campaign_id", "name").join(m, "campaign_id", "left")
    j = j.withColumns({k: F.coalesce(k, zero) for k in ("sent", "opened", "clicked", "replied")})

    def rate(name: str) -> Column:
        return F.round(F.col(name) / F.nullif("sent", F.lit(0)) * 100, 2)

    return j.withColumns({"open_rate": rate("opened"), "click_rate": rate("clicked"), "reply_rate": rate("replied")})


def campaign_list(campaigns: DataFrame, steps: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Campaigns with their steps (a short list, keyed by step number) and enrolment counts."""
    s = steps.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step_number", "channel", "day_offset"))),
                lambda x: F.concat_ws(":", x["step_number"].cast("string"), x["channel"], x["day_offset"].cast("string")),
            ),
            ",",
        ).alias("steps"),
    )
    e = enrollments.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("enrolled"))
    return campaigns.join(s, "campaign_id", "left").join(e, "campaign_id", "left").select(
        "campaign_id", "name", "is_active",
        F.coalesce("step_count", F.lit(0)).alias("step_count"), "steps", F.coalesce("enrolled", F.lit(0)).alias("enrolled"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """Share of six facts present over a result set, in percent, with its record and website counts."""
    facts = [
        present("raw_website"),
        present("raw_phone"),
        present("raw_email"),
        present("raw_address"),
        present("platform"),
        F.coalesce(F.col("quality_score") >= 80, F.lit(False)),
    ]
    filled = points(*[(f, 1) for f in facts])
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(present("raw_website")).alias("websites"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("filled"),
    ).select("records", "websites", ratio(F.col("filled") * 100, F.col("records") * 6).alias("coverage_pct"))


# Weights of the result-set confidence.
CONFIDENCE_WEIGHTS = {
    "phone_found": 20,
    "website_exists": 18,
    "email_found": 15,
    "multi_source_confirmed": 12,
    "audit_completed": 10,
    "social_found": 8,
    "business_contacts_found": 7,
    "leadership_found": 5,
    "technology_detected": 3,
    "identity_resolved": 2,
}


def discovery_confidence(records: DataFrame, by: str = "job_id") -> DataFrame:
    """Ten yes/no facts of each result set and their weighted sum.

    Facts that later steps provide are read from optional boolean columns of the same name.
    """
    later = ("audit_completed", "business_contacts_found", "leadership_found", "technology_detected", "identity_resolved")
    facts = {
        "phone_found": F.max(present("raw_phone")),
        "website_exists": F.max(present("raw_website")),
        "email_found": F.max(present("raw_email")),
        "social_found": F.max(present("platform")),
        # two different names are enough, so a distinct count is not needed
        "multi_source_confirmed": F.min("source") < F.max("source"),
        **{n: F.max(truthy(n)) if n in records.columns else F.lit(False) for n in later},
    }
    rows = records.groupBy(by).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in facts.items()])
    score = points(*[(F.col(n), w) for n, w in CONFIDENCE_WEIGHTS.items()])
    return rows.withColumn("overall_confidence", F.least(F.lit(100), score).cast("double"))


def extraction_metrics(candidates: DataFrame) -> DataFrame:
    """Candidates, kept and rejected ones, and clamp events per section and reason."""
    reason = F.coalesce("reject_reason", F.lit("kept"))
    return candidates.groupBy("section_type", reason.alias("outcome")).agg(
        F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("clamp_events"), F.lit(0)).alias("clamps")
    )


def contact_summary(contacts: DataFrame) -> DataFrame:
    """Contacts, decision makers, e-mails and profile links per company."""
    return contacts.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("contacts"),
        F.count_if(truthy("is_decision_maker")).alias("decision_makers"),
        F.count_if(present("email")).alias("emails"),
        F.count_if(present("linkedin_url")).alias("linkedin_urls"),
    )


def stage_success(log: DataFrame) -> DataFrame:
    """Share of completed steps per stage in percent, 100 where none finished either way."""
    done = log.groupBy("to_stage").agg(
        F.count_if("success").alias("completed"), F.count_if(~F.col("success")).alias("failed")
    )
    total = F.col("completed") + F.col("failed")
    return done.withColumn("success_pct", F.round(ratio(F.col("completed") * 100, total, 100.0), 2))


def overall_status(statuses: DataFrame) -> DataFrame:
    """critical if anything is down, degraded if anything is degraded, else healthy."""
    any_down = F.max(F.col("status") == "down")
    any_degraded = F.max(F.col("status") == "degraded")
    return statuses.agg(
        F.when(any_down, "critical").when(any_degraded, "degraded").otherwise("healthy").alias("overall")
    )


def latest_per(df: DataFrame, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    """The newest row of every key; the larger tie-break value wins at equal times."""
    return best_per(df, keys, [F.col(ts), F.col(tiebreak)])
