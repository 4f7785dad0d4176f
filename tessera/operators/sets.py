"""Unions of feeds, novelty, list membership, upserts and deletes as set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import host_key
from tessera.operators.skew import best_per


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All feeds under one schema; columns a feed lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hybrid_results(local: DataFrame, external: DataFrame) -> DataFrame:
    """Known companies that fit the search (EXISTING), and results from outside."""
    place = F.when(F.col("city").isNotNull(), F.trim(F.concat("city", F.lit(", "), F.coalesce("state", F.lit("")))))
    mine = local.select(
        F.lit("database").alias("source"), "company_id", F.col("name").alias("raw_name"), F.col("phone").alias("raw_phone"),
        F.col("email").alias("raw_email"), F.col("website_url").alias("raw_website"), place.alias("raw_address"),
        F.lit("EXISTING").alias("result_type"), F.lit(False).alias("discovered_now"),
    )
    theirs = external.select(
        "source", F.lit(None).cast("long").alias("company_id"), "raw_name", "raw_phone", "raw_email", "raw_website", "raw_address",
        F.lit(None).cast("string").alias("result_type"), F.lit(True).alias("discovered_now"),
    )
    return mine.unionByName(theirs)


def novel_only(records: DataFrame, known: DataFrame, known_column: str = "website_url") -> DataFrame:
    """One record per host that is not known yet (the first by record id)."""
    keyed = records.withColumn("host", host_key("raw_website")).filter("host is not null")
    old = known.select(host_key(known_column).alias("host")).filter("host is not null").distinct()
    fresh = keyed.join(old, "host", "left_anti")
    return best_per(fresh, ["host"], [F.col("record_id")], largest=False)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target with the updates laid over it: the newest update per key replaces the row, new keys are added."""
    columns = target.columns
    newest = best_per(updates, keys, [F.col(order)])
    kept = target.join(newest.select(*keys), keys, "left_anti")
    return kept.select(*columns).unionByName(newest.select(*columns))


def list_add(members: DataFrame, additions: DataFrame) -> DataFrame:
    """Membership after adding; members already there keep the time they were first added."""
    both = members.unionByName(additions.select(*members.columns))
    keys = [c for c in members.columns if c != "added_at"]
    return both.groupBy(*keys).agg(F.min("added_at").alias("added_at")).select(*members.columns)


def list_remove(members: DataFrame, removals: DataFrame) -> DataFrame:
    keys = removals.columns
    return members.join(removals.distinct(), keys, "left_anti").select(*members.columns)


def cascade_delete(
    companies: DataFrame, children: dict[str, DataFrame], doomed: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the doomed companies and their children, and how many rows each table loses."""
    ids = doomed.select("company_id").distinct()
    tables, counts = {}, None
    for name, df in {"companies": companies, **children}.items():
        tables[name] = df.join(ids, "company_id", "left_anti")
        lost = df.join(ids, "company_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
        row = lost.select(F.lit(name).alias("table_name"), "deleted")
        counts = row if counts is None else counts.unionByName(row)
    return tables, counts


def companies_of_jobs(jobs: DataFrame, results: DataFrame, companies: DataFrame) -> DataFrame:
    """Ids of companies a job created, by the new-company flag of its results or by the job id."""
    ids = jobs.select("job_id").distinct()
    flagged = results.filter("is_new_company and company_id is not null").join(ids, "job_id", "left_semi").select("company_id")
    owned = companies.join(ids.withColumnRenamed("job_id", "discovery_job_id"), "discovery_job_id", "left_semi").select("company_id")
    return flagged.union(owned).distinct()


def delete_jobs(jobs: DataFrame, results: DataFrame, companies: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Jobs, results and companies after deleting some jobs and what they created."""
    gone = companies_of_jobs(doomed, results, companies)
    ids = doomed.select("job_id").distinct()
    return {
        "discovery_jobs": jobs.join(ids, "job_id", "left_anti"),
        "discovery_results": results.join(ids, "job_id", "left_anti"),
        "companies": companies.join(gone, "company_id", "left_anti"),
    }
