"""Business tables as views over the base tables.

Every view is one SQL text that Spark and an independent SQL engine both understand, so the same
rows feed a job and the query it is checked against. ``{name}`` stands for another table or view.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import SCHEMAS, read_table


def _stem(key: str) -> str:
    """Pronounceable ten-letter word from the hash of a key expression."""
    h = f"md5(cast({key} as string))"
    parts = []
    for i in range(1, 11):
        letters = "bcdfghjklmnprstv" if i % 2 else "aeiouaeiouaeioua"
        parts.append(f"translate(substr({h}, {i}, 1), '0123456789abcdef', '{letters}')")
    return f"upper({parts[0]}) || " + " || ".join(parts[1:])


def _pick(key: str, values: list[str]) -> str:
    """Case expression choosing a value by the remainder of a key expression."""
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case ({key}) % {len(values)} {whens} end)"


TRADES = ["Dental Clinic", "Law Firm", "Fitness Studio", "Hotel", "Software Solutions", "Books", "Cafe"]
CITIES = ["Mumbai", "Pune", "Delhi", "Chennai", "Kochi", "Jaipur", "Nagpur", "Surat", "Indore", "Mysore", "Goa"]
TITLES = [
    "CEO",
    "Co-Founder",
    "Director of Sales",
    "Marketing Manager",
    "Staff",
    "VP of Engineering",
    "Intern",
    "Chief Technology Officer",
    "Head of Operations",
]
STAGES = [
    "DISCOVERED",
    "IDENTITY_RESOLVED",
    "WEBSITE_SELECTED",
    "WEBSITE_CRAWLED",
    "CONFIDENCE_EVALUATED",
    "ADAPTIVE_ENRICHMENT",
    "CONTACTS_EXTRACTED",
    "READY_FOR_ANALYSIS",
]
RUN_SOURCES = ["google_maps", "duckduckgo", "justdial", "website", "grotal", "mca", "NER"]

VIEWS: dict[str, str] = {}

VIEWS["companies"] = f"""
select c_custkey as company_id,
       {_stem("c_custkey")} || ' ' || {_pick("c_custkey", TRADES)} as name,
       case when c_custkey % 17 = 0 then null else lower(c_mktsegment) end as industry,
       {_pick("c_custkey", ["1-10", "11-50", "51-200", "201+"])} as company_size,
       {_pick("c_custkey", CITIES)} as city,
       lower(r_name) as state,
       n_name as country,
       lpad(cast(400000 + c_custkey % 97 as string), 6, '0') as postal_code,
       case when c_custkey % 8 = 0 then null
            else '+91 ' || cast(9000000000 + (c_custkey * 7919) % 900000000 as string) end as phone,
       case when c_custkey % 3 = 0 then null
            else 'hello@' || lower({_stem("c_custkey")}) || '.in' end as email,
       case when c_custkey % 4 = 0 then null
            else 'https://www.' || lower({_stem("c_custkey")}) || '.in/home' end as website_url,
       case when c_custkey % 5 = 0 then null
            else 'Serving ' || {_pick("c_custkey", CITIES)} || ' since ' || cast(1950 + c_custkey % 70 as string) end
         as description,
       {_pick("c_custkey", ["prospect", "qualified", "engaged", "customer", "lost", "lead", "archived"])} as status,
       {_pick("c_custkey * 3", STAGES)} as stage,
       cast(floor(abs(c_acctbal)) as bigint) % 101 as lead_score,
       c_custkey * 31 % 101 as intent_score,
       {_pick("c_custkey", ["alice", "bob", "carol"])} as owner_id,
       c_custkey % 11 + 1 as discovery_job_id,
       c_custkey % 2 = 0 as is_new_company,
       case when c_custkey % 6 = 0 then null
            else cast('2024-01-01 00:00:00' as timestamp) + interval '1' day * (c_custkey % 90) end as enriched_at,
       cast('2023-06-01 00:00:00' as timestamp) + interval '1' minute * (c_custkey * 37 % 500000) as created_at,
       {_pick("c_custkey", ["completed", "failed", "running", "pending", "completed"])} as analysis_status,
       case when c_custkey % 4 = 1 then null
            else cast('2024-01-05 00:00:00' as timestamp) + interval '1' hour * (c_custkey % 400) end as last_analyzed_at,
       c_custkey % 19 = 0 as needs_reanalysis
from {{customer}} c
join {{nation}} n on c.c_nationkey = n.n_nationkey
join {{region}} r on n.n_regionkey = r.r_regionkey
"""

VIEWS["discovery_results"] = f"""
select c_custkey * 4 as record_id, c_custkey % 11 + 1 as job_id, 'google_maps' as source,
       {_stem("c_custkey")} || ' ' || {_pick("c_custkey", TRADES)} as raw_name,
       case when c_custkey % 8 = 0 then null
            else '+91 ' || cast(9000000000 + (c_custkey * 7919) % 900000000 as string) end as raw_phone,
       case when c_custkey % 3 = 0 then null else 'hello@' || lower({_stem("c_custkey")}) || '.in' end as raw_email,
       case when c_custkey % 4 = 0 then null
            else 'https://www.' || lower({_stem("c_custkey")}) || '.in/home' end as raw_website,
       cast(c_custkey % 300 as string) || ' Main Road, ' || {_pick("c_custkey", CITIES)} as raw_address,
       {_pick("c_custkey", TRADES)} as category,
       cast(null as string) as gstin, cast(null as string) as cin, cast(null as string) as platform,
       70 + c_custkey % 25 as quality_score,
       cast('2024-01-02 00:00:00' as timestamp) + interval '1' minute * (c_custkey * 4 % 30000) as created_at
from {{customer}}
union all
select c_custkey * 4 + 1, c_custkey % 11 + 1, 'justdial',
       substr({_stem("c_custkey")}, 1, 3) || substr({_stem("c_custkey")}, 5, 6) || ' '
         || {_pick("c_custkey", TRADES)},
       case when c_custkey % 2 = 0 then '0' || cast(9000000000 + (c_custkey * 7919) % 900000000 as string) end,
       cast(null as string), cast(null as string),
       cast(c_custkey % 300 as string) || '  main road, ' || lower({_pick("c_custkey", CITIES)}),
       {_pick("c_custkey", TRADES)}, cast(null as string), cast(null as string), cast(null as string),
       5 + c_custkey % 15,
       cast('2024-01-02 00:00:00' as timestamp) + interval '1' minute * (c_custkey * 4 % 30000 + 1)
from {{customer}} where c_custkey % 3 = 0
union all
select c_custkey * 4 + 2, c_custkey % 11 + 1, 'duckduckgo',
       'Visit ' || {_stem("c_custkey + 7")}, cast(null as string), 'team@' || lower({_stem("c_custkey")}) || '.in',
       lower({_stem("c_custkey")}) || '.in', cast(null as string), cast(null as string),
       cast(null as string), cast(null as string), 'facebook', 50,
       cast('2024-01-02 00:00:00' as timestamp) + interval '1' minute * (c_custkey * 4 % 30000 + 2)
from {{customer}} where c_custkey % 5 = 1
union all
select s_suppkey * 4 + 3, s_suppkey % 11 + 1, 'mca',
       {_stem("s_suppkey * 3")} || ' ' || {_pick("s_suppkey * 3", TRADES)} || ' Pvt Ltd',
       cast(null as string), cast(null as string), cast(null as string),
       cast((s_suppkey * 3) % 300 as string) || ' Main Road, ' || {_pick("s_suppkey * 3", CITIES)}, cast(null as string),
       '27' || upper(substr(translate(md5(cast(s_suppkey % 40 as string)), '0123456789', 'ghijklmnop'), 1, 5)) || '1234A1Z5',
       'U72200MH2000PTC' || lpad(cast(s_suppkey % 60 as string), 6, '0'), cast(null as string), 20,
       cast('2024-01-02 00:00:00' as timestamp) + interval '1' minute * (s_suppkey * 4 % 30000 + 3)
from {{supplier}}
"""

VIEWS["company_intelligence"] = f"""
select c_custkey as company_id,
       case when c_custkey % 10 = 1 then 0 else c_custkey * 37 % 101 end as digital_maturity_score,
       c_custkey * 53 % 101 as lead_score,
       {_pick("c_custkey", ["", "SEO", "SEO,CRM Development", "CRM Development,AI Chatbot,SEO"])} as services_needed,
       c_custkey % 2 = 0 as crm_detected, c_custkey % 3 = 0 as booking_detected,
       c_custkey % 5 = 0 as whatsapp_detected, c_custkey % 7 = 0 as chatbot_detected,
       case when c_custkey % 4 = 0 then null else c_custkey * 11 % 101 end as website_score,
       cast('2024-02-01 00:00:00' as timestamp) + interval '1' minute * (c_custkey % 5000) as updated_at
from {{customer}} where c_custkey % 6 <> 0
"""

VIEWS["company_signals"] = """
select c_custkey as company_id, c_custkey % 4 = 0 as no_website, c_custkey % 2 = 1 as no_crm,
       c_custkey % 5 <> 0 as no_whatsapp, c_custkey % 3 = 1 as poor_seo, c_custkey % 7 = 2 as slow_website,
       c_custkey % 3 <> 0 as no_booking_system, c_custkey % 7 <> 0 as no_chatbot,
       case when c_custkey % 9 = 0 then 95 when c_custkey % 9 = 1 then null else c_custkey % 60 end as intent_score
from {customer} where c_custkey % 7 <> 3
"""

VIEWS["website_audits"] = """
select o_orderkey as audit_id, o_custkey as company_id, o_orderkey * 13 % 101 as seo_score,
       40 + o_orderkey % 61 as page_speed_estimate, o_orderkey % 3 = 0 as has_whatsapp_widget,
       o_orderkey % 2 = 0 as has_contact_form, o_orderkey % 5 = 0 as has_booking_system,
       o_orderkey % 7 = 0 as has_crm, o_orderkey % 11 = 0 as has_chatbot, o_orderkey % 4 = 0 as has_analytics,
       o_orderkey % 9 <> 0 as ssl_enabled, o_orderkey % 8 <> 0 as mobile_friendly,
       case when o_orderkey % 6 = 0 then ' Pricing ,book demo' when o_orderkey % 6 = 1 then 'case studies,Awards,PRICING'
            when o_orderkey % 6 = 2 then 'newsletter' else '' end as audit_signals,
       o_orderdate as created_at
from {orders}
"""

VIEWS["contacts"] = f"""
select c_custkey * 2 as contact_id, c_custkey as company_id, {_stem("c_custkey + 11")} as first_name,
       {_stem("c_custkey + 13")} as last_name,
       case when c_custkey % 13 = 0 then null else {_pick("c_custkey", TITLES)} end as title,
       case when c_custkey % 4 = 1 then null else lower({_stem("c_custkey + 11")}) || '@' || lower({_stem("c_custkey")})
            || '.in' end as email,
       case when c_custkey % 5 = 2 then null
            else '+91 ' || cast(8000000000 + c_custkey % 5000 as string) end as phone,
       case when c_custkey % 3 = 0 then 'https://linkedin.com/in/' || lower({_stem("c_custkey + 11")}) end as linkedin_url,
       c_custkey % 3 = 1 as is_decision_maker, c_custkey % 4 = 2 as email_verified, c_custkey % 10 = 7 as phone_verified,
       40 + c_custkey % 60 as confidence_score,
       {_pick("c_custkey", ["leadership", "team", "footer", "faq"])} as section,
       cast('2024-01-10 00:00:00' as timestamp) + interval '1' hour * (c_custkey % 700) as created_at
from {{customer}} where c_custkey % 4 <> 3
union all
select c_custkey * 2 + 1, c_custkey, {_stem("c_custkey + 11")}, upper({_stem("c_custkey + 13")}),
       {_pick("c_custkey + 4", TITLES)},
       case when c_custkey % 2 = 0 then lower({_stem("c_custkey + 17")}) || '@' || lower({_stem("c_custkey")}) || '.in' end,
       cast(null as string), cast(null as string), c_custkey % 6 = 0, false, false,
       30 + c_custkey % 50, {_pick("c_custkey + 1", ["leadership", "team", "footer", "faq"])},
       cast('2024-01-12 00:00:00' as timestamp) + interval '1' hour * (c_custkey % 500)
from {{customer}} where c_custkey % 3 = 0
"""

VIEWS["discovery_jobs"] = f"""
select p_partkey as job_id, {_pick("p_partkey", ["alice", "bob", "carol"])} as user_id,
       {_pick("p_partkey", ["completed", "running", "failed", "completed", "pending"])} as status,
       p_name as keyword, {_pick("p_partkey", CITIES)} as city,
       p_partkey * 7 % 300 as total_raw_results, p_partkey * 5 % 200 as total_after_dedup,
       case when p_partkey % 3 = 0 then 0 when p_partkey % 3 = 1 then null else p_partkey % 40 end as total_new,
       p_partkey % 50 as total_companies_created, p_partkey % 25 as total_existing,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' hour * (p_partkey % 2000) as created_at
from {{part}}
"""

VIEWS["activities"] = """
select event_id as activity_id, user_id * 2 as contact_id, user_id as company_id, event_type as activity_type,
       'activity ' || cast(event_id as string) as subject, ts as created_at
from {events}
"""

VIEWS["stage_log"] = f"""
select event_id as log_id, user_id as identity_id,
       {_pick("event_id * 3 + 7", STAGES)} as from_stage, {_pick("event_id * 3", STAGES)} as to_stage,
       cast(floor(value * 1000) as bigint) as duration_ms, event_type <> 'error' as success, ts as created_at
from {{events}}
"""

VIEWS["source_runs"] = f"""
select event_id as run_id, user_id as job_id, {_pick("user_id", RUN_SOURCES)} as source,
       case when event_type = 'error' then 0
            else cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 12 end as results,
       case when event_type = 'error' then 0
            else cast(floor(cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 12 / 2.0) as bigint) end as contacts,
       case when event_type = 'error' then 0
            else cast(floor(cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 12 / 3.0) as bigint) end as websites,
       case when event_type = 'view' then 1 else 0 end as duplicates,
       cast(cast(floor(value * 4) as bigint) / 4.0 as double) as duration_sec,
       case when event_type = 'error' and event_id % 2 = 0 then 'HTTP 403 Blocked'
            when event_type = 'error' then 'Timeout after 30s' end as error,
       ts
from {{events}}
"""

VIEWS["search_log"] = f"""
select event_id as search_id, ts, {_pick("user_id", ["brave", "duckduckgo", "searx", "gemini"])} as provider,
       cast(floor(value) as bigint) as latency_ms, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as companies_found,
       event_type <> 'error' as success
from {{events}}
"""

VIEWS["field_candidates"] = f"""
select event_id as seq, user_id as entity_id,
       case event_type when 'click' then 'industry' when 'view' then 'industry' when 'signup' then 'phone'
            when 'purchase' then 'city' else 'industry' end as field,
       case event_type
            when 'signup' then case when event_id % 3 = 0 then '+91 98765 4321' || cast(event_id % 4 as string)
                                    else '98765-4321' || cast(event_id % 4 as string) end
            when 'purchase' then {_pick("event_id", CITIES)}
            else {_pick("event_id", ["Dentist", "Dental Clinic ", "Healthcare", "software", "IT Services", "Hotel", "cafe", "Shoes"])}
       end as value,
       {_pick("event_id * 5 + user_id", RUN_SOURCES)} as source,
       case when value > 100 then 100.0 else cast(floor(value) as double) end as confidence,
       ts as extracted_at
from {{events}}
"""

VIEWS["campaigns"] = """
select r_regionkey + 1 as campaign_id, 'Campaign ' || lower(r_name) as name, r_regionkey % 2 = 0 as is_active from {region}
"""

VIEWS["campaign_steps"] = """
select n_nationkey % 5 + 1 as campaign_id, cast(floor(n_nationkey / 5) as bigint) + 1 as step_number,
       n_nationkey % 4 + 1 as day_offset,
       case n_nationkey % 2 when 0 then 'email' else 'whatsapp' end as channel,
       case n_nationkey % 3 when 0 then null else 'Hello {{{{name}}}}' end as template_subject,
       'Hi {{{{name}}}}, a note about ' || lower(n_name) || '. Bye {{{{name}}}}' as template_body
from {nation}
"""

VIEWS["enrollments"] = """
select c_custkey as enrollment_id, c_custkey % 5 + 1 as campaign_id, c_custkey * 2 as contact_id, c_custkey as company_id,
       c_custkey % 7 + 1 as current_step_number,
       case when c_custkey % 9 = 0 then 'paused' when c_custkey % 9 = 1 then 'replied' else 'active' end as status,
       case when c_custkey % 10 = 0 then null
            else cast('2024-01-01 00:00:00' as timestamp) + interval '1' day * (c_custkey % 40) end as last_processed_at
from {customer}
"""

VIEWS["messages"] = """
select o_orderkey as message_id, cast(substr(o_orderpriority, 1, 1) as bigint) as campaign_id,
       o_custkey * 2 as contact_id, o_orderstatus as status, o_orderdate as sent_at,
       o_orderkey % 3 = 0 as opened, o_orderkey % 6 = 0 as clicked, o_orderkey % 15 = 0 as replied
from {orders}
"""

VIEWS["message_events"] = """
select l_orderkey * 10 + l_linenumber as event_id, l_orderkey as message_id, l_orderkey % 5 + 1 as campaign_id,
       l_suppkey as contact_id,
       case l_linenumber when 1 then 'sent' when 2 then 'opened' when 3 then 'opened' when 4 then 'clicked'
            when 5 then 'opened' else 'replied' end as kind,
       l_shipdate as ts
from {lineitem}
"""

VIEWS["tasks"] = f"""
select o_orderkey as task_id, o_custkey as company_id, o_custkey * 2 as contact_id,
       'task ' || cast(o_orderkey as string) as title, {_pick("o_orderkey", ["todo", "in_progress", "done"])} as status,
       {_pick("o_orderkey", ["low", "medium", "high", "urgent"])} as priority,
       case when o_orderkey % 5 = 0 then null else o_orderdate + interval '1' day * (o_orderkey % 30) end as due_date,
       o_orderdate as created_at
from {{orders}}
"""

VIEWS["saved_list_companies"] = """
select p_partkey % 7 + 1 as list_id, p_partkey * 3 % 1700 as company_id,
       cast('2024-03-01 00:00:00' as timestamp) + interval '1' minute * p_partkey as added_at
from {part}
"""

VIEWS["saved_list_contacts"] = """
select s_suppkey % 7 + 1 as list_id, s_suppkey * 6 as contact_id,
       cast('2024-03-02 00:00:00' as timestamp) + interval '1' minute * s_suppkey as added_at
from {supplier}
"""

VIEWS["websites"] = """
select page_id as website_id, url,
       regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) as host,
       case when page_id % 3 = 0 then 'pending' else 'audited' end as status,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' minute * (page_id * 17 % 1000) as created_at
from {pages}
"""

VIEWS["vectors"] = "select vec_id, embedding, label from {embeddings}"

VIEWS["classifier_scores"] = """
select doc_id, 'quality' as label, cast(0.25 + quality * 0.5 + (doc_id % 10) / 100.0 as double) as score from {labels}
union all
select doc_id, 'toxic', cast(0.2 + toxic * 0.7 + (doc_id % 7) / 100.0 as double) from {labels}
union all
select doc_id, 'neutral', cast(0.5 + (doc_id % 13) / 100.0 as double) from {labels}
"""

# A driver query over listings and dumps needs rows shaped like a dump: pages and documents give them.
VIEWS["serp_rows"] = """
select page_id as row_id,
       case when page_id % 2 = 0
            then '//r.example.org/l/?uddg=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&rut=1' else url end as href,
       regexp_extract(html, '<title>([^<]*)</title>', 1)
         || case page_id % 3 when 0 then ' - Home' when 1 then ' | Contact' else '' end as title,
       'Call ' || case when page_id % 4 = 0 then '+91 98765 ' || cast(40000 + page_id % 60000 as string)
                       else 'us today' end || ' GSTIN 27ABCDE' || cast(1000 + page_id % 9000 as string) || 'F1Z5' as snippet
from {pages}
"""

VIEWS["archive_rows"] = """
select page_id as row_id, url as original, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) as urlkey,
       20240100000000 + page_id * 7 % 5000 as snapshot,
       case when page_id % 11 = 0 then '404' else '200' end as status_code
from {pages}
"""

VIEWS["registry_rows"] = f"""
select s_suppkey as row_id,
       {_stem("s_suppkey * 3")} || ' Exports - Company Details' as title,
       'Reg U72200MH2000PTC' || lpad(cast(s_suppkey % 60 as string), 6, '0') || ' tax 27ABCDE'
         || lpad(cast(s_suppkey % 10000 as string), 4, '0') || 'F1Z5 and 29PQRST'
         || lpad(cast(s_suppkey % 10000 as string), 4, '0') || 'K2Z7' as snippet
from {{supplier}}
"""

VIEWS["social_rows"] = f"""
select c_custkey as row_id, {_pick("c_custkey", ["facebook", "instagram", "linkedin"])} as platform,
       case when c_custkey % 5 = 0 then 'https://example.org/' || lower({_stem("c_custkey")})
            else 'https://www.' || {_pick("c_custkey", ["facebook", "instagram", "linkedin"])} || '.com/'
                 || lower({_stem("c_custkey")}) end as href,
       case c_custkey % 4 when 0 then {_stem("c_custkey")} || ' Dental | Home'
            when 1 then {_stem("c_custkey")} || ' Care on Facebook' when 2 then 'X - About'
            else {_stem("c_custkey")} || ' @' || lower({_stem("c_custkey")}) end as title
from {{customer}}
"""

VIEWS["sitemap_rows"] = f"""
select c_custkey as row_id,
       'https://listing.example.org/' || lower({_stem("c_custkey")}) || '-dental-clinic'
         || case c_custkey % 3 when 0 then '-' || lower({_pick("c_custkey", CITIES)}) || '-contact-address'
                 when 1 then '-' || lower({_pick("c_custkey", CITIES)}) else '-' || cast(c_custkey as string) end as loc
from {{customer}}
"""

BASE_TABLES = tuple(SCHEMAS)
_NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def inputs_of(view: str) -> list[str]:
    return sorted(set(_NAME.findall(VIEWS[view])))


class Tables:
    """Base tables and views of one data folder, as lazily built DataFrames: ``t.companies``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in SCHEMAS:
                self._built[name] = read_table(self.spark, self.base, name)
            elif name in VIEWS:
                inputs = {n: getattr(self, n) for n in inputs_of(name)}
                self._built[name] = self.spark.sql(VIEWS[name], **inputs)
            else:
                raise AttributeError(name)
        return self._built[name]


def sql_with_views(query: str) -> str:
    """Prefix ``query`` with the views it mentions, written as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                needed.append(view)

    visit(query)
    ctes = ",\n".join(f"{v} as ({_NAME.sub(lambda m: m.group(1), VIEWS[v]).replace('{{{{', '{{').replace('}}}}', '}}')})"
                      for v in needed)
    if not ctes:
        return query
    body = query.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"
