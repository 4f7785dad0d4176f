"""Joined views of companies and their children, and keyed checks of new rows against existing ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import present, truthy
from tessera.operators.skew import best_per, top_n_per


def company_360(companies: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(company_id, name, section, child_id, payload): each company with all its child rows.

    One row per child instead of nested lists: sections are united, never joined to each other, so they
    do not multiply, and a company with very many children is not gathered in one row. A company
    without children keeps one row with a null section. ``children`` maps a section name to its table
    and id column.
    """
    rows = None
    for section, (df, key) in children.items():
        rest = [c for c in df.columns if c not in ("company_id", key)]
        part = df.select(
            "company_id",
            F.lit(section).alias("section"),
            F.col(key).cast("string").alias("child_id"),
            F.to_json(F.struct(*rest)).alias("payload"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return companies.select("company_id", "name").join(rows, "company_id", "left")


def results_with_companies(marked: DataFrame, companies: DataFrame) -> DataFrame:
    """Unique results with their company's columns, oldest first."""
    c = companies.select("company_id", "name", "phone", "website_url", "lead_score", "stage", "industry")
    return (
        marked.filter(~truthy("is_duplicate"))
        .join(c, "company_id", "left")
        .orderBy("created_at", "record_id")
    )


def signal_inputs(companies: DataFrame, intelligence: DataFrame, audits: DataFrame) -> DataFrame:
    """Inputs of the buying signals: intelligence flags, and the newest audit with missing values as 0."""
    newest = best_per(
        audits.select("company_id", "seo_score", "page_speed_estimate", "has_whatsapp_widget", "created_at", "audit_id"),
        ["company_id"],
        [F.col("created_at"), F.col("audit_id")],
    ).drop("created_at", "audit_id")
    i = intelligence.select("company_id", "crm_detected", "booking_detected", "whatsapp_detected", "chatbot_detected")
    j = companies.select("company_id", "website_url").join(i, "company_id", "left").join(newest, "company_id", "left")
    return j.select(
        "company_id",
        present("website_url").alias("has_website"),
        truthy("crm_detected").alias("has_crm"),
        truthy("booking_detected").alias("has_booking_system"),
        truthy("chatbot_detected").alias("has_chatbot"),
        (truthy("has_whatsapp_widget") | truthy("whatsapp_detected")).alias("has_whatsapp_widget"),
        F.coalesce("seo_score", F.lit(0)).alias("seo_score"),
        F.coalesce("page_speed_estimate", F.lit(0)).alias("page_speed_estimate"),
    )


def split_new_existing(batch: DataFrame, companies: DataFrame) -> DataFrame:
    """The batch with ``existing_id`` and ``reason`` where a company has the same website or phone.

    The either-or condition is two equality joins; the website is checked first. Existing values are
    unique per key after the fold, so the batch is never multiplied.
    """
    sites = companies.filter(present("website_url")).groupBy("website_url").agg(F.min("company_id").alias("by_site"))
    phones = companies.filter(present("phone")).groupBy("phone").agg(F.min("company_id").alias("by_phone"))
    j = batch.join(sites, batch["raw_website"] == sites["website_url"], "left").join(
        phones, batch["raw_phone"] == phones["phone"], "left"
    )
    reason = F.when(F.col("by_site").isNotNull(), "DUPLICATE_WEBSITE").when(F.col("by_phone").isNotNull(), "DUPLICATE_PHONE")
    return j.select(*[batch[c] for c in batch.columns], F.coalesce("by_site", "by_phone").alias("existing_id"), reason.alias("reason"))


def contact_keys() -> Column:
    """All keys under which an existing contact can be found, tagged by kind."""
    return F.array_compact(
        F.array(
            F.when(present("email"), F.concat(F.lit("e:"), F.col("email"))),
            F.when(present("phone"), F.concat(F.lit("p:"), F.col("phone"))),
            F.when(
                present("first_name") & present("last_name"),
                F.concat(F.lit("n:"), F.col("first_name"), F.lit("|"), F.col("last_name")),
            ),
        )
    )


def split_new_contacts(batch: DataFrame, contacts: DataFrame) -> DataFrame:
    """The batch with ``is_new``: looked up in its company by e-mail, else phone, else full name."""
    held = contacts.select("company_id", F.explode(contact_keys()).alias("key")).distinct().withColumn("known", F.lit(True))
    keyed = batch.withColumn("key", F.get(contact_keys(), F.lit(0)))
    return keyed.join(held, ["company_id", "key"], "left").select(*batch.columns, F.col("known").isNull().alias("is_new"))


def due_steps(enrollments: DataFrame, steps: DataFrame, contacts: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Active enrolments with their current step, due or completed.

    A step is due when its day offset has passed since the last one (at once for a new enrolment);
    an enrolment whose step does not exist is completed; the rest wait and are left out.
    """
    active = enrollments.filter("status = 'active'")
    j = active.join(
        steps.withColumnRenamed("step_number", "current_step_number"), ["campaign_id", "current_step_number"], "left"
    )
    missing = F.col("template_body").isNull()
    due_at = F.col("last_processed_at") + F.make_dt_interval(days=F.col("day_offset").cast("int"))
    due = F.col("last_processed_at").isNull() | (due_at <= as_of)
    action = F.when(missing, "completed").when(due, "due")
    people = contacts.select("contact_id", "first_name", "email")
    names = companies.select("company_id", F.col("name").alias("company_name"))
    return (
        j.withColumn("action", action)
        .filter("action is not null")
        .join(people, "contact_id", "left")
        .join(names, "company_id", "left")
        .select(
            "enrollment_id", "campaign_id", "contact_id", "company_id", "current_step_number", "action", "channel",
            "template_subject", "template_body", "first_name", "email", "company_name",
        )
    )


def timeline(activities: DataFrame, contacts: DataFrame, companies: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` activities with contact and company names; names are joined after the cut."""
    newest = activities.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(n)
    return (
        newest.join(contacts.select("contact_id", "first_name", "last_name"), "contact_id", "left")
        .join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")
        .select("activity_id", "activity_type", "subject", "first_name", "last_name", "company_name", "created_at")
    )


def list_members(
    list_companies: DataFrame, list_contacts: DataFrame, companies: DataFrame, contacts: DataFrame, list_id: int | None = None
) -> DataFrame:
    """Companies and contacts of saved lists with the time they were added."""
    a = list_companies.join(companies.select("company_id", "name"), "company_id").select(
        "list_id", F.lit("company").alias("kind"), F.col("company_id").alias("member_id"), "name", "added_at"
    )
    full = F.concat_ws(" ", "first_name", "last_name")
    b = list_contacts.join(contacts.select("contact_id", full.alias("name")), "contact_id").select(
        "list_id", F.lit("contact").alias("kind"), F.col("contact_id").alias("member_id"), "name", "added_at"
    )
    both = a.unionByName(b)
    return both.filter(F.col("list_id") == list_id) if list_id is not None else both


def task_board(tasks: DataFrame, companies: DataFrame, contacts: DataFrame, company_id: int | None = None) -> DataFrame:
    """Tasks with company and contact; earliest due date first, undated last, then newest."""
    t = tasks.filter(F.col("company_id") == company_id) if company_id is not None else tasks
    return (
        t.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")
        .join(contacts.select("contact_id", "first_name", "last_name"), "contact_id", "left")
        .select("task_id", "title", "status", "priority", "due_date", "created_at", "company_name", "first_name", "last_name")
        .orderBy(F.asc_nulls_last("due_date"), F.desc("created_at"), F.asc("task_id"))
    )


# Sources asked again for a missing fact.
GAP_ROUTES = (
    ("phone", ("justdial", "asklaila", "grotal", "yellowpages", "hotfrog")),
    ("website", ("duckduckgo", "google_dorks")),
)
GAP_RESULTS = 5


def enrichment_plan(gaps: DataFrame) -> DataFrame:
    """(company_id, keyword, city, missing, source, max_results): one row per source to ask again.

    ``gaps`` has company_id, name, city, state, missing_phone and missing_website.
    """
    wanted = F.flatten(
        F.array(
            *[
                F.when(
                    truthy(f"missing_{fact}"),
                    F.array(*[F.struct(F.lit(fact).alias("missing"), F.lit(s).alias("source")) for s in sources]),
                ).otherwise(F.array().cast("array<struct<missing:string,source:string>>"))
                for fact, sources in GAP_ROUTES
            ]
        )
    )
    place = F.coalesce(F.nullif("city", F.lit("")), "state", F.lit(""))
    return gaps.select("company_id", F.col("name").alias("keyword"), place.alias("city"), F.explode(wanted).alias("w")).select(
        "company_id", "keyword", "city", "w.missing", "w.source", F.lit(GAP_RESULTS).alias("max_results")
    )


def attach_site_contacts(contacts: DataFrame, site_contacts: DataFrame) -> DataFrame:
    """Give a site's only personal e-mail and only phone to its top contact where that one has none.

    ``contacts`` has company_id, contact_id, rank_order, email, phone; ``site_contacts`` has company_id,
    kind, value and class.
    """
    personal = (F.col("kind") == "email") & (F.col("class") == "personal")
    phone = F.col("kind") == "phone"
    lone = site_contacts.select("company_id", "kind", "value", "class").distinct().groupBy("company_id").agg(
        F.when(F.count_if(personal) == 1, F.max(F.when(personal, F.col("value")))).alias("lone_email"),
        F.when(F.count_if(phone) == 1, F.max(F.when(phone, F.col("value")))).alias("lone_phone"),
    )
    top = contacts.groupBy("company_id").agg(F.min_by("contact_id", F.struct("rank_order", "contact_id")).alias("top_id"))
    j = contacts.join(top, "company_id").join(lone, "company_id", "left")
    first = F.col("contact_id") == F.col("top_id")
    return j.select(
        "company_id",
        "contact_id",
        F.when(first & ~present("email"), F.col("lone_email")).otherwise(F.col("email")).alias("email"),
        F.when(first & ~present("phone"), F.col("lone_phone")).otherwise(F.col("phone")).alias("phone"),
    )


def stage_history(log: DataFrame) -> DataFrame:
    """Each stage entry with the stage before, the time spent, and whether it is the current one."""
    from tessera.operators.skew import neighbours_in_time

    linked = neighbours_in_time(log, "identity_id", "created_at", "log_id", ["to_stage"])
    # 1000 ms per second; cast of a timestamp to double gives seconds
    ms = F.unix_micros(F.col("next.created_at")) - F.unix_micros("created_at")
    return linked.select(
        "log_id", "identity_id", "to_stage", F.col("prev.to_stage").alias("previous_stage"),
        F.floor(ms / 1000).alias("ms_in_stage"), F.col("next").isNull().alias("is_current"), "created_at",
    )


def rank_providers(providers: DataFrame, health: DataFrame) -> DataFrame:
    """Search providers by weight, unhealthy ones at 0. Providers are a short configured list."""
    j = providers.join(health.select("provider", "is_healthy"), "provider", "left")
    weight = F.when(F.coalesce("is_healthy", F.lit(True)), F.col("weight")).otherwise(0)
    return j.select("provider", weight.alias("weight")).orderBy(F.desc("weight"), F.asc("provider"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of every feed."""
    return top_n_per(df, keys, order, n)


def top_scores(signals: DataFrame, companies: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest intent scores with company names, joined after the cut."""
    best = signals.select("company_id", F.coalesce("intent_score", F.lit(0)).alias("score")).orderBy(
        F.desc("score"), F.asc("company_id")
    ).limit(n)
    return best.join(companies.select("company_id", "name"), "company_id", "left").select(
        "company_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "score"
    )
