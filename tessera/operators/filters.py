"""Searches, exclusion lists, record checks, freshness and integrity filters."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.keys import digits, host_key, present
from tessera.operators.skew import top_n_per
from tessera.session import cut_lineage

# A query list is sent to every task only up to this many rows; a longer one is matched over pieces.
SMALL_QUERY_LIST = 10_000


def word_table(spark: SparkSession, words: Sequence[str], name: str = "host") -> DataFrame:
    """A short fixed list as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias(name))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Does the text contain any of the words? Plain substring tests, which are cheaper than one pattern."""
    found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return F.coalesce(found, F.lit(False))


def keyword_search(companies: DataFrame, queries: DataFrame, n: int = 50, small: int = SMALL_QUERY_LIST) -> DataFrame:
    """(query_id, rank, company_id): companies whose name, industry or description holds the keyword
    and whose city or state holds the place, the first ``n`` by id per query.

    Keywords and places are folded to distinct ones first. A short list (its size is checked) is sent
    to every task; a long one meets the companies over the three letters its keywords start with.
    """
    asked = queries.select(F.lower("keyword").alias("kw"), F.lower("location").alias("loc")).distinct()
    c = companies.select(
        "company_id",
        F.lower("name").alias("n"),
        F.lower("industry").alias("i"),
        F.lower("description").alias("d"),
        F.lower("city").alias("ci"),
        F.lower("state").alias("st"),
    )
    hit = F.expr(
        "(contains(n, kw) or coalesce(contains(i, kw), false) or coalesce(contains(d, kw), false)) "
        "and (loc is null or contains(ci, loc) or contains(st, loc))"
    )
    if asked.count() <= small:
        found = c.join(F.broadcast(asked), hit).select("kw", "loc", "company_id")
    else:
        found = _search_by_pieces(c, asked, hit)
    best = top_n_per(found, ["kw", "loc"], [F.asc("company_id")], n, rank="rank")
    q = queries.select("query_id", F.lower("keyword").alias("kw"), F.lower("location").alias("loc"))
    return q.join(best, q["kw"].eqNullSafe(best["kw"]) & q["loc"].eqNullSafe(best["loc"])).select(
        "query_id", "rank", "company_id"
    )


def _search_by_pieces(c: DataFrame, asked: DataFrame, hit: Column) -> DataFrame:
    """Keywords of three letters or more are found over equal pieces; the few shorter ones are sent everywhere."""
    text = F.concat_ws(" ", "n", "i", "d")
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda p: F.substr(text, p, F.lit(3))))
    cut = c.withColumn("piece", F.explode(pieces))
    long = asked.filter(F.length("kw") >= 3).withColumn("piece", F.substring("kw", 1, 3))
    by_piece = cut.join(long, "piece").filter(hit).select("kw", "loc", "company_id")
    # at most a few thousand different texts have under three letters
    short = asked.filter(F.length("kw") < 3)
    return by_piece.unionByName(c.join(short, hit).select("kw", "loc", "company_id"))


def faceted_search(
    companies: DataFrame,
    intelligence: DataFrame,
    signals: DataFrame,
    *,
    industry: str | None = None,
    city: str | None = None,
    postal_code: str | None = None,
    size: str | None = None,
    min_lead_score: int | None = None,
    crm_detected: bool | None = None,
    whatsapp_detected: bool | None = None,
    min_intent_score: int | None = None,
) -> DataFrame:
    """Companies passing the given facets; a child table is joined inner only when a facet is set on it."""
    c = companies
    if industry is not None:
        c = c.filter(F.col("industry") == industry)
    if city is not None:
        c = c.filter(F.lower("city").contains(city.lower()))
    if postal_code is not None:
        c = c.filter(F.col("postal_code") == postal_code)
    if size is not None:
        c = c.filter(F.col("company_size") == size)
    i = intelligence.select(
        "company_id", F.col("lead_score").alias("intel_lead_score"), "crm_detected", "whatsapp_detected", "digital_maturity_score"
    )
    needs_intel = not (min_lead_score is None and crm_detected is None and whatsapp_detected is None)
    if min_lead_score is not None:
        i = i.filter(F.col("intel_lead_score") >= min_lead_score)
    if crm_detected is not None:
        i = i.filter(F.col("crm_detected") == crm_detected)
    if whatsapp_detected is not None:
        i = i.filter(F.col("whatsapp_detected") == whatsapp_detected)
    s = signals.select("company_id", F.col("intent_score").alias("signal_intent"))
    if min_intent_score is not None:
        s = s.filter(F.col("signal_intent") >= min_intent_score)
    return c.join(i, "company_id", "inner" if needs_intel else "left").join(
        s, "company_id", "left" if min_intent_score is None else "inner"
    )


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int, costly: bool = False) -> DataFrame:
    """One page of an ordered list, with the total and the page count on every row.

    The list is read twice, for the count and for the page. A ``costly`` one (several joins) should
    carry few columns; it is written once and read back.
    """
    df = cut_lineage(df) if costly else df
    total = df.count()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(math.ceil(total / size)).cast("long")})


def page_after(df: DataFrame, score: str, key: str, last: tuple[int, int] | None, size: int) -> DataFrame:
    """The next page of a list ordered by score descending, then key: no rows are skipped over."""
    if last is not None:
        df = df.filter((F.col(score) < last[0]) | ((F.col(score) == last[0]) & (F.col(key) > last[1])))
    return df.orderBy(F.desc(score), F.asc(key)).limit(size)


def lead_list(
    companies: DataFrame,
    text: str | None = None,
    status: str | None = None,
    low: int | None = None,
    high: int | None = None,
) -> DataFrame:
    """Leads by text in name or city, status and score range, best first."""
    df = companies
    if text:
        df = df.filter(F.lower("name").contains(text.lower()) | F.lower("city").contains(text.lower()))
    if status:
        df = df.filter(F.col("status") == status)
    if low is not None:
        df = df.filter(F.col("lead_score") >= low)
    if high is not None:
        df = df.filter(F.col("lead_score") <= high)
    return df.orderBy(F.desc("lead_score"), F.asc("company_id"))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` as ``[a.b.c, b.c, c]``: a suffix match becomes an equality."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def _listed(df: DataFrame, column: str, hosts: DataFrame, key: str) -> DataFrame:
    """Keys of rows whose host or a parent of it is on the list (a short table)."""
    exploded = df.select(key, F.explode(host_suffixes(host_key(column))).alias("host"))
    return exploded.join(hosts, "host", "left_semi").select(key).distinct()


def exclude_hosts(df: DataFrame, hosts: DataFrame, column: str = "raw_website", key: str = "record_id") -> DataFrame:
    """Rows whose site is not on a host list; government sites go too, rows without a site stay out."""
    host = host_key(column)
    public = host.rlike(r"\.gov$|\.gov\.in$|\.nic\.in$")
    kept = df.filter(host.isNotNull() & ~public)
    return kept.join(_listed(kept, column, hosts, key), key, "left_anti")


def official_site(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page_id, url): first outbound link of every directory page that leads to an own site.

    The link's host must differ from the page's, must not be on the list, and must not belong to an
    app store or analytics host.
    """
    listed = pages.join(_listed(pages, "url", hosts, "page_id"), "page_id", "left_semi")
    links = listed.select(
        "page_id",
        host_key("url").alias("own"),
        F.posexplode(F.regexp_extract_all("html", F.lit(r"""href=["'](https?://[^"']+)["']"""), 1)).alias("pos", "link"),
    ).withColumn("link_host", host_key("link"))
    outside = links.filter("link_host is not null and not contains(own, link_host)").filter(
        ~F.col("link_host").rlike("google|apple|android")
    )
    suffixed = outside.select("page_id", "pos", F.explode(host_suffixes(F.col("link_host"))).alias("host"))
    banned = suffixed.join(hosts, "host", "left_semi").select("page_id", "pos").distinct()
    free = outside.join(banned, ["page_id", "pos"], "left_anti")
    return free.groupBy("page_id").agg(F.min_by("link", "pos").alias("url"))


def verify_records(records: DataFrame, name: str = "raw_name", website: str = "raw_website", phone: str = "raw_phone") -> DataFrame:
    """Records with the first reason to reject them, null for valid ones."""
    host = F.lower(F.regexp_extract(website, "^[a-z]*://([^/?#]*)", 1))
    d = digits(phone)
    reason = (
        F.when(~present(name) | (F.lower(name) == "unknown"), "no name")
        .when(present(website) & ~F.col(website).startswith("http"), "website not http")
        .when(present(website) & ~host.contains("."), "website host")
        .when(present(website) & host.rlike("|".join(rules.VERIFY_BLACKLIST)), "website blacklisted")
        .when(present(phone) & F.length(d).between(1, 6), "phone too short")
        .when(present(phone) & d.isin(*rules.FAKE_PHONES), "fake phone")
        .when(~present(website) & ~present(phone), "no contact")
    )
    return records.withColumn("reject_reason", reason)


EXTRACTED_SCHEMA = (
    "companyName string, website string, phone string, email string, address string, city string, state string, "
    "confidence string, category string, whySelected string"
)


def validate_extracted(rows: DataFrame, json: str = "json") -> DataFrame:
    """Model output that names a company and an http site off the blacklist, with confidence of 80 or more."""
    parsed = rows.withColumns(
        {"v": F.from_json(json, EXTRACTED_SCHEMA), "keys": F.map_keys(F.from_json(json, "map<string,string>"))}
    )
    required = F.lit(True)
    for field in rules.EXTRACTED_REQUIRED:
        required = required & F.array_contains("keys", field)
    site = F.trim("v.website")
    confidence = F.coalesce(F.col("v.confidence").try_cast("double").cast("int"), F.lit(0))
    ok = required & site.startswith("http") & ~any_word(F.lower(site), rules.EXTRACTED_BLACKLIST) & (confidence >= 80)

    def text(name: str) -> Column:
        return F.coalesce(F.trim(f"v.{name}"), F.lit(""))

    return parsed.filter(ok).select(
        *[c for c in rows.columns if c != json],
        text("companyName").alias("business_name"),
        site.alias("website"),
        F.trim(F.regexp_replace(text("phone"), "[^0-9+() -]", "")).alias("phone"),
        *[text(n).alias(n) for n in ("email", "address", "city", "state", "category")],
        text("whySelected").alias("why_selected"),
        confidence.alias("confidence"),
    )


def human_name_reason(name: str = "name", website: str = "website") -> Column:
    """Why a text is not a person's name; null when it may be one. The first rule that fits decides."""
    n = F.col(name)
    lower = F.lower(n)
    words = F.filter(F.split(F.trim(n), r"\s+"), lambda w: w != "")
    bare = F.transform(F.split(lower, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    brand = F.lower(F.split_part(F.regexp_extract(website, r"^(?:https?://)?([^/:]*)", 1), F.lit("."), F.lit(1)))
    branded = (F.length(brand) > 2) & (brand != "www") & F.array_contains(F.split(lower, r"\s+"), brand)
    country = (F.size(words) >= 2) & F.lower(F.try_element_at(words, F.lit(-1))).isin(*rules.COUNTRY_SUFFIXES)

    def is_product(w: Column) -> Column:
        clean = F.regexp_replace(F.lower(w), "[^a-z]", "")
        return (F.length(clean) > 1) & clean.isin(*rules.PRODUCT_TERMS)

    def is_cased(w: Column) -> Column:
        return w.rlike("[a-z][A-Z]") & ~w.rlike("^(?i:mac|mc)[A-Z]")

    verdicts = F.filter(
        F.transform(words, lambda w: F.when(is_product(w), "PRODUCT_NAME_DETECTED").when(is_cased(w), "BRAND_CASING_DETECTED")),
        lambda v: v.isNotNull(),
    )
    keyword = F.get(F.array_intersect(F.array(*[F.lit(k) for k in rules.REJECT_KEYWORDS]), bare), F.lit(0))
    has_keyword = F.arrays_overlap(F.array(*[F.lit(k) for k in rules.REJECT_KEYWORDS]), bare)
    letters = F.filter(F.split(F.trim(F.regexp_replace(n, r"[0-9()+\-]", "")), r"\s+"), lambda w: w != "")
    shaped = F.size(letters).between(2, 4) & F.forall(letters, lambda w: w.rlike(r"^[A-Za-z.'-]+$"))
    reason = (
        F.when(n == "Business Contact", F.lit(None).cast("string"))
        .when(n.isNull() | (F.length(F.trim(n)) < 2), "Name too short or empty")
        .when(F.coalesce(branded, F.lit(False)), "NAME_CONTAINS_DOMAIN_BRAND")
        .when(country, "COMPANY_COUNTRY_SUFFIX_DETECTED")
        .when(F.size(verdicts) > 0, F.get(verdicts, F.lit(0)))
        .when(has_keyword, F.concat(F.lit("Contains rejected keyword: "), keyword))
        .when(any_word(lower, rules.MARKETING_PHRASES), "MARKETING_ITEM_DETECTED")
        .when(any_word(lower, rules.MENU_PHRASES), "MENU_ITEM_DETECTED")
        .when(~shaped, "Not a valid human name format")
        .when(n.contains("|"), "Contains pipe character")
    )
    return reason


def filter_human_names(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("reject_reason", human_name_reason())


def valid_title(title: Column) -> Column:
    """Missing titles pass; others must be short and must not read like a sentence."""
    t = F.lower(F.trim(title))
    long_ok = t.rlike("director of|head of|vice president of")
    ok = (
        (F.length(t) <= 80)
        & ~any_word(t, rules.DESCRIPTIVE_PHRASES)
        & ((F.size(F.split(t, r"\s+")) <= 8) | long_ok)
    )
    return F.coalesce(title == "", F.lit(True)) | ok


def filter_titles(candidates: DataFrame) -> DataFrame:
    return candidates.filter(valid_title(F.col("title")))


def evidence_gate(candidates: DataFrame) -> DataFrame:
    """Person candidates with the reason to drop them, null for kept ones.

    ``candidates`` carries section_type, name, title, website and the score columns of
    :func:`tessera.operators.scoring.contact_confidence`.
    """
    kind = F.coalesce("section_type", F.lit("UNKNOWN"))
    lower = F.lower("name")
    proven = kind.isin(*rules.PROVEN_SECTIONS) | any_word(F.lower("title"), rules.EXECUTIVE_TITLES)
    anonymous = F.col("name") == "Business Contact"
    reason = (
        F.when(kind.isin("SERVICE_SECTION", "FEATURE_SECTION"), "SERVICE_BLOCK")
        .when(kind.isin("CTA_SECTION", "FAQ_SECTION"), "MARKETING_CONTENT")
        .when(~valid_title(F.col("title")), "INVALID_TITLE_DETECTED")
        .when(any_word(lower, rules.BUSINESS_SECTION_PHRASES), "SERVICE_NAME")
        .when(any_word(lower, rules.CTA_PHRASES), "CTA")
        .when(any_word(lower, rules.MENU_PHRASES), "MENU_ITEM")
        .when(any_word(lower, rules.MARKETING_PHRASES), "MARKETING_PHRASE")
        .when(~anonymous & human_name_reason().isNotNull(), human_name_reason())
        .when(F.col("base_score") < 40, "LOW_CONFIDENCE")
        .when(~anonymous & ~proven, "UNKNOWN_PERSON_NO_EVIDENCE")
    )
    return candidates.withColumn("reject_reason", reason)


def stale_only(companies: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Companies not enriched within the last ``days`` days."""
    age = as_of - F.col("enriched_at")
    return companies.filter(F.col("enriched_at").isNull() | (age >= F.expr(f"interval '{days}' day")))


# Age limits in hours by component.
COMPONENT_HOURS = {
    "html": 24,
    "website_document": 24,
    "contacts": 24,
    "audit": 24,
    "ner": 168,
    "classification": 168,
}
DEFAULT_HOURS = 24


def component_limit(component: str = "component") -> Column:
    """Age limit of a component as an interval."""
    hours = F.lit(DEFAULT_HOURS)
    for name, value in COMPONENT_HOURS.items():
        hours = F.when(F.col(component) == name, value).otherwise(hours)
    return F.make_dt_interval(hours=hours)


def fresh_components(results: DataFrame, as_of: Column) -> DataFrame:
    """Whether each stored result is still within its component's age limit."""
    return results.withColumn("is_fresh", as_of - F.col("stored_at") < component_limit())


def violations(df: DataFrame, rule: str, key: str, bad: Column) -> DataFrame:
    return df.filter(bad).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_key"))


def repeated(df: DataFrame, rule: str, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("row_key"))


def orphans(child: DataFrame, rule: str, key: str, foreign: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows that point at a missing parent."""
    held = child.filter(F.col(foreign).isNotNull())
    lost = held.join(parent.select(F.col(parent_key).alias(foreign)), foreign, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_key"))


def check_constraints(companies: DataFrame, contacts: DataFrame, intelligence: DataFrame, campaigns_dates: DataFrame, enrollments: DataFrame) -> DataFrame:
    """(rule, row_key): rows that break a range, not-empty, either-or, order, uniqueness or reference rule."""
    score = F.col("digital_maturity_score")
    parts = [
        violations(companies, "company name is empty", "company_id", ~present("name")),
        violations(contacts, "contact has neither e-mail nor phone", "contact_id", ~present("email") & ~present("phone")),
        violations(intelligence, "maturity is outside 0-100", "company_id", ~score.between(0, 100)),
        violations(campaigns_dates, "campaign ends before it starts", "campaign_id", F.col("start_date") > F.col("end_date")),
        repeated(enrollments, "contact is enrolled twice", ["campaign_id", "contact_id"]),
        repeated(companies.filter(present("phone")), "phone is used twice", ["phone"]),
        orphans(contacts, "contact without company", "contact_id", "company_id", companies, "company_id"),
        orphans(enrollments, "enrolment without contact", "enrollment_id", "contact_id", contacts, "contact_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def smb_only(companies: DataFrame, hosts: Sequence[str] = rules.LARGE_COMPANY_HOSTS) -> DataFrame:
    """Companies whose site does not mention a large company's host."""
    return companies.filter(~any_word(F.lower(F.coalesce("website_url", F.lit(""))), hosts))


def pending_analysis(companies: DataFrame) -> DataFrame:
    """Companies never analysed, failed or flagged, with their current analysis state."""
    state = F.coalesce("analysis_status", F.lit("pending"))
    due = F.col("last_analyzed_at").isNull() | (state == "failed") | F.coalesce("needs_reanalysis", F.lit(False))
    return companies.filter(due).select("company_id", state.alias("analysis_status"), "last_analyzed_at", "needs_reanalysis")


def pending_audits(websites: DataFrame) -> DataFrame:
    """Websites waiting for an audit, newest first."""
    return websites.filter("status = 'pending'").orderBy(F.desc("created_at"), F.asc("website_id"))
