"""Queries over companies: scores, joined views, metrics, sorted lists, exports, upserts."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import aggregates as agg
from tessera.operators import filters as flt
from tessera.operators import joins, scoring, sets
from tessera.plans.catalog import query, sql_any, sql_in, sql_values
from tessera.plans.record_queries import (
    SQL_CATEGORY,
    SQL_PEOPLE,
    SQL_RAW_SCORE,
    _marked,
    _MARKED,
    _person_rows,
    sql_dm,
    ts,
)
from tessera.sources import sinks
from tessera.streaming import jobs as streams

def _intel(t):
    services = F.when(F.col("services_needed") == "", F.array().cast("array<string>")).otherwise(F.split("services_needed", ","))
    return t.company_intelligence.withColumn("services_needed", services)


# ---- scores -------------------------------------------------------------------------------------

_LEAD = """
p as (select company_id, bool_or(is_decision_maker) as dm, bool_or(email_verified or phone_verified) as vf from contacts group by 1),
i as (select company_id, coalesce(nullif(digital_maturity_score, 0), 50) as m, case when services_needed = '' then 0 else len(string_split(services_needed, ',')) end as sv
      from company_intelligence),
s as (select company_id, greatest(case when no_website then 25 else 0 end + case when no_crm then 15 else 0 end + case when no_whatsapp then 15 else 0 end
   + case when poor_seo then 15 else 0 end + case when slow_website then 10 else 0 end + case when no_booking_system then 10 else 0 end, coalesce(intent_score, 0)) as it
   from company_signals),
x as (select c.company_id, c.name, cast(case when s.company_id is null then 50 else least(100, it) end as int) as intent_score,
   cast(case when i.company_id is null then 50 else least(100, greatest(0, floor((100 - m) * 0.7::double + least(30, sv * 6) + 0.5))) end as int) as opportunity_score,
   cast(least(100, case when phone <> '' then 20 else 0 end + case when email <> '' then 15 else 0 end + case when website_url <> '' then 15 else 0 end
     + case when p.company_id is not null then 15 else 0 end + case when dm then 20 else 0 end + case when vf then 10 else 0 end
     + case when city <> '' or country <> '' then 5 else 0 end) as int) as fit_score
   from companies c left join i using (company_id) left join s using (company_id) left join p using (company_id)),
y as (select *, cast(least(100, greatest(0, floor(intent_score * 0.35::double + opportunity_score * 0.35::double + fit_score * 0.30::double + 0.5))) as int) as lead_score from x)
"""


def _scores(t):
    return scoring.lead_scores(t.companies, _intel(t), t.company_signals, t.contacts)


@query("scr_01_lead_scores", f"with {_LEAD} select company_id, intent_score, opportunity_score, fit_score, lead_score from y")
def _(t):
    return _scores(t)


@query(
    "srt_01_ranked_leads",
    f"with {_LEAD} select company_id, name, lead_score, (select count(*) from y where lead_score > 0) as total, cast(ceil((select count(*) from y where lead_score > 0) / 50.0) as bigint) as pages from y where lead_score > 0 order by lead_score desc, company_id limit 50",
)
def _(t):
    ranked = _scores(t).filter("lead_score > 0").join(t.companies.select("company_id", "name"), "company_id")
    return flt.page_of(ranked.select("company_id", "name", "lead_score"), [F.desc("lead_score"), F.asc("company_id")], 1, 50, costly=True)


@query(
    "srt_02_paginate",
    """select job_id, created_at, (select count(*) from discovery_jobs where status = 'completed') as total,
  cast(ceil((select count(*) from discovery_jobs where status = 'completed') / 20.0) as bigint) as pages
  from discovery_jobs where status = 'completed' order by created_at desc, job_id limit 20 offset 40""",
)
def _(t):
    done = t.discovery_jobs.filter("status = 'completed'").select("job_id", "created_at")
    return flt.page_of(done, [F.desc("created_at"), F.asc("job_id")], 3, 20)


@query(
    "srt_02_page_after",
    "select company_id, lead_score from companies where lead_score < 60 or (lead_score = 60 and company_id > 100) order by lead_score desc, company_id limit 25",
)
def _(t):
    return flt.page_after(t.companies.select("company_id", "lead_score"), "lead_score", "company_id", (60, 100), 25)


_FEATURES = """(select company_id, company_id % 4 <> 0 as has_website, website_score, crm_detected as has_crm, booking_detected as has_booking_system,
  whatsapp_detected as has_whatsapp_widget, company_id % 3 = 2 as has_contact_form, company_id % 9 as socials from company_intelligence)"""


def _features(t):
    c = F.col("company_id")
    profiles = F.when(c % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return t.company_intelligence.select(
        "company_id", (c % 4 != 0).alias("has_website"), "website_score", F.col("crm_detected").alias("has_crm"),
        F.col("booking_detected").alias("has_booking_system"), F.col("whatsapp_detected").alias("has_whatsapp_widget"),
        (c % 3 == 2).alias("has_contact_form"), profiles.alias("social_profiles"),
    )


_MATURITY = """least(100, greatest(0, case when has_website then 30 else 0 end + case when has_website and coalesce(website_score, 0) > 0 then floor(website_score / 100.0::double * 20 + 0.5) else 0 end
  + case when has_whatsapp_widget then 15 else 0 end + case when has_booking_system then 15 else 0 end + case when has_crm then 10 else 0 end
  + case when has_contact_form then 5 else 0 end + case when socials > 0 then 5 else 0 end))"""


@query("scr_02_digital_maturity", f"select company_id, cast({_MATURITY} as int) as digital_maturity_score from {_FEATURES}")
def _(t):
    return scoring.company_features(_features(t)).select("company_id", "digital_maturity_score")


@query(
    "scr_03_services_needed",
    f"""select company_id, array_to_string(list_filter([case when not has_website or website_score < 50 then 'Website Development' end, case when not has_crm then 'CRM Development' end,
  case when not has_whatsapp_widget then 'WhatsApp Automation' end, case when not has_booking_system then 'Booking System Setup' end, case when website_score < 70 then 'SEO' end,
  case when not has_contact_form or not has_whatsapp_widget then 'AI Chatbot' end], lambda x: x is not null), ', ') as services from {_FEATURES}""",
)
def _(t):
    return scoring.company_features(_features(t)).select("company_id", F.array_join("services_needed", ", ").alias("services"))


@query(
    "scr_04_inverse_score",
    f"select company_id, cast(case when m = 0 then 50 else 100 - m end as int) as lead_score from (select company_id, {_MATURITY} as m from {_FEATURES})",
)
def _(t):
    return scoring.company_features(_features(t)).select("company_id", "lead_score")


_NEWEST = "(select * from (select *, row_number() over (partition by company_id order by created_at desc, audit_id desc) as rn from website_audits) where rn = 1)"
_SITES = """(select company_id, case company_id % 4 when 0 then 'pricing' when 1 then 'Certifications,faq' when 2 then '' else 'blog' end as doc_signals,
  company_id % 200 as about_length, case when company_id % 3 = 0 then 'Unknown' else company_size end as company_size, company_id % 90 as industry_confidence, description from companies)"""
_GAPS = [("has_whatsapp_widget", 18), ("has_booking_system", 15), ("has_crm", 15), ("seo", 15), ("ssl_enabled", 12), ("has_contact_form", 12), ("has_analytics", 8), ("has_chatbot", 5)]


def _gap(flag: str) -> str:
    return "seo_score < 50" if flag == "seo" else f"not {flag}"


_INTEL = f"""
pp as (select company_id, count(*) as contacts_found, count(*) filter (where is_decision_maker) as leadership_found, bool_or(email is not null) as pe, bool_or(phone is not null) as ph,
  bool_or(linkedin_url is not null) as li from contacts group by 1),
a as (select a.*, s.* exclude (company_id), p.* exclude (company_id),
  list_distinct(list_transform(list_filter(list_concat(string_split(doc_signals, ','), string_split(audit_signals, ',')), lambda z: z <> ''), lambda z: lower(trim(z)))) as sigs
  from {_NEWEST} a left join {_SITES} s using (company_id) left join pp p using (company_id)),
b as (select *, greatest(0, 100 - case when not ssl_enabled then 15 else 0 end - case when not mobile_friendly then 15 else 0 end - case when not has_contact_form then 10 else 0 end
  - case when not has_whatsapp_widget then 10 else 0 end - case when not has_booking_system then 10 else 0 end - case when not has_crm then 10 else 0 end
  - case when not has_chatbot then 10 else 0 end - case when not has_analytics then 8 else 0 end - case when seo_score < 50 then 12 else 0 end) as m,
  least(100, {" + ".join(f"case when {_gap(f)} then {p} else 0 end" for f, p in _GAPS)}) as it,
  {" + ".join(f"case when {_gap(f)} then 1 else 0 end" for f, p in _GAPS)} as n,
  least(100, case when contacts_found > 0 then 20 else 0 end + case when leadership_found > 0 then 20 else 0 end + case when pe then 15 else 0 end + case when ph then 10 else 0 end
   + case when li then 10 else 0 end + case when about_length > 100 then 5 else 0 end + case when company_size <> 'Unknown' then 5 else 0 end
   + case when industry_confidence > 60 then 10 else 0 end + case when length(description) > 30 then 5 else 0 end) as ft from a),
c as (select *, least(100, floor((100 - m) * 0.75::double + least(25, n * 5) + 0.5)) as op from b),
d as (select *, least(100, greatest(0, floor(it * 0.35::double + op * 0.35::double + ft * 0.30::double + 0.5))) as ls,
  len(list_filter(sigs, lambda z: regexp_matches(z, '{"|".join(scoring.HIGH_VALUE_SIGNALS)}'))) as hi from c)
"""


@query(
    "scr_05_lead_intelligence",
    f"""with {_INTEL}
select company_id, cast(m as int) as maturity_score, cast(it as int) as intent_score, cast(op as int) as opportunity_score, cast(ft as int) as fit_score, cast(ls as int) as lead_score,
  case when ls >= 80 then 'A' when ls >= 65 then 'B' when ls >= 45 then 'C' when ls >= 25 then 'D' else 'F' end as grade,
  case when ls >= 80 then 'hot' when ls >= 45 then 'warm' when ls >= 25 then 'cold' else 'skip' end as priority,
  case when hi >= 3 then 'strong' when hi >= 1 then 'moderate' when len(sigs) > 0 then 'weak' else 'none' end as signal_strength,
  array_to_string(list_filter([case when not has_whatsapp_widget then 'WhatsApp Automation' end, case when not ssl_enabled then 'Website Security (SSL)' end,
    case when not mobile_friendly then 'Mobile-Responsive Website' end, case when not has_booking_system then 'Online Booking System' end, case when not has_crm then 'CRM Integration' end,
    case when not has_chatbot then 'AI Chatbot' end, case when seo_score < 50 then 'SEO Optimization' end, case when not has_analytics then 'Analytics & Tracking Setup' end],
    lambda z: z is not null), '|') as services,
  coalesce(leadership_found, 0) > 0 as decision_maker_present from d""",
)
def _(t):
    out = _lead_intelligence(t)
    services = F.array_join(F.transform("recommendations", lambda r: r["service"]), "|")
    return out.select(
        "company_id", "maturity_score", "intent_score", "opportunity_score", "fit_score", "lead_score", "grade", "priority", "signal_strength",
        services.alias("services"), "decision_maker_present",
    )


def _signal_list(column):
    return F.filter(F.split(column, ","), lambda s: s != "")


def _newest_audits(t):
    return agg.latest_per(t.website_audits, ["company_id"], "created_at", "audit_id")


def _lead_intelligence(t):
    c = F.col("company_id")
    doc = F.when(c % 4 == 0, "pricing").when(c % 4 == 1, "Certifications,faq").when(c % 4 == 2, "").otherwise("blog")
    sites = t.companies.select(
        "company_id", _signal_list(doc).alias("document_signals"), (c % 200).alias("about_length"),
        F.when(c % 3 == 0, "Unknown").otherwise(F.col("company_size")).alias("company_size"), (c % 90).alias("industry_confidence"), "description",
    )
    people = t.contacts.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("contacts_found"), F.count_if("is_decision_maker").alias("leadership_found"),
        F.max(F.col("email").isNotNull()).alias("has_personal_email"), F.max(F.col("phone").isNotNull()).alias("has_phone"),
        F.max(F.col("linkedin_url").isNotNull()).alias("has_linkedin"),
    )
    audits = _newest_audits(t).withColumn("audit_signals", _signal_list(F.col("audit_signals")))
    return scoring.lead_intelligence(audits, sites, people)


@query(
    "srt_05_recommendations",
    f"""with {_INTEL}, r as (select company_id, unnest(['WhatsApp Automation', 'Online Booking System', 'CRM Integration', 'AI Chatbot', 'SEO Optimization', 'Analytics & Tracking Setup', 'Website Security (SSL)', 'Mobile-Responsive Website']) as service,
  unnest([not has_whatsapp_widget, not has_booking_system, not has_crm, not has_chatbot, seo_score < 50, not has_analytics, not ssl_enabled, not mobile_friendly]) as gap,
  unnest(['critical', 'high', 'high', 'high', 'high', 'medium', 'critical', 'critical']) as priority, unnest([0, 1, 1, 1, 1, 2, 0, 0]) as o, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as place from d)
select company_id, cast(row_number() over (partition by company_id order by o, place) - 1 as int) as pos, service, priority from r where gap""",
)
def _(t):
    return _lead_intelligence(t).select("company_id", F.posexplode("recommendations").alias("pos", "r")).select("company_id", "pos", "r.service", "r.priority")


@query(
    "set_05_distinct_signals",
    f"with {_INTEL} select company_id, unnest(sigs) as signal from d",
)
def _(t):
    return _lead_intelligence(t).select("company_id", F.explode("detected_signals").alias("signal"))


_INPUTS = f"""(select c.company_id, coalesce(website_url, '') <> '' as has_website, coalesce(crm_detected, false) as has_crm, coalesce(booking_detected, false) as has_booking_system,
  coalesce(chatbot_detected, false) as has_chatbot, coalesce(a.has_whatsapp_widget, false) or coalesce(whatsapp_detected, false) as has_whatsapp_widget,
  coalesce(a.seo_score, 0) as seo_score, coalesce(a.page_speed_estimate, 0) as page_speed_estimate
  from companies c left join company_intelligence i using (company_id) left join {_NEWEST} a using (company_id))"""


@query("jon_03_signal_inputs", f"select * from {_INPUTS}")
def _(t):
    return joins.signal_inputs(t.companies, t.company_intelligence, t.website_audits)


@query(
    "scr_06_buying_signals",
    f"""select company_id, not has_website as no_website, has_website and seo_score < 50 as poor_seo, has_website and page_speed_estimate < 80 as slow_website, not has_crm as no_crm,
  not has_whatsapp_widget as no_whatsapp, not has_booking_system as no_booking_system, not has_chatbot as no_chatbot,
  cast(least(100, case when not has_website then 30 else 0 end + case when has_website and seo_score < 50 then 15 else 0 end + case when has_website and page_speed_estimate < 80 then 15 else 0 end
  + case when not has_crm then 10 else 0 end + case when not has_whatsapp_widget then 10 else 0 end + case when not has_booking_system then 10 else 0 end
  + case when not has_chatbot then 10 else 0 end) as int) as intent_score from {_INPUTS}""",
)
def _(t):
    return scoring.buying_signals(joins.signal_inputs(t.companies, t.company_intelligence, t.website_audits))


def _people_flags(t):
    return t.contacts.groupBy("company_id").agg(
        F.lit(True).alias("has_contacts"), F.max("is_decision_maker").alias("has_decision_maker"),
        F.max(F.col("email").isNotNull()).alias("has_email"), F.max(F.col("phone").isNotNull()).alias("has_phone"),
    )


@query(
    "scr_07_stateless_scores",
    f"""
with p as (select company_id, bool_or(is_decision_maker) as dm, bool_or(email is not null) as em, bool_or(phone is not null) as ph from contacts group by 1),
a as (select a.*, least(100, greatest(0, 50 - case when not has_whatsapp_widget then 10 else 0 end - case when not has_crm then 15 else 0 end - case when not has_booking_system then 10 else 0 end
  - case when not has_chatbot then 10 else 0 end - case when seo_score < 50 then 15 else 0 end - case when not mobile_friendly then 20 else 0 end - case when page_speed_estimate < 80 then 10 else 0 end)) as m,
  case when not has_whatsapp_widget then 1 else 0 end + case when not has_crm then 1 else 0 end + case when not has_booking_system then 1 else 0 end + case when not has_chatbot then 1 else 0 end
  + case when seo_score < 50 then 1 else 0 end + case when not mobile_friendly or page_speed_estimate < 80 then 1 else 0 end as n,
  case when p.company_id is not null then 30 else 0 end + case when dm then 30 else 0 end + case when em then 20 else 0 end + case when ph then 20 else 0 end as ft
  from {_NEWEST} a left join p using (company_id)),
b as (select *, least(100, greatest(0, floor((100 - m) * 0.7::double + least(30, n * 6) + 0.5))) as op from a)
select company_id, cast(m as int) as digital_maturity_score, cast(100 - m as int) as intent_score, cast(op as int) as opportunity_score, cast(ft as int) as fit_score, cast(n as int) as services,
  cast(least(100, greatest(0, floor((100 - m) * 0.35::double + op * 0.35::double + ft * 0.30::double + 0.5))) as int) as lead_score from b
""",
)
def _(t):
    out = scoring.stateless_scores(_newest_audits(t), _people_flags(t))
    return out.select(
        "company_id", "digital_maturity_score", "intent_score", "opportunity_score", "fit_score", F.size("recommended_services").alias("services"), "lead_score"
    )


@query(
    "scr_11_audit_total",
    """select audit_id, cast(least(100, trunc(page_speed_estimate * 0.3::double + seo_score * 0.3::double + case when ssl_enabled then 10 else 0 end + case when mobile_friendly then 10 else 0 end
  + case when has_contact_form then 10 else 0 end + case when has_whatsapp_widget then 10 else 0 end)) as int) as overall_score,
  coalesce(nullif(array_to_string(list_filter([case when not ssl_enabled then 'ssl' end, case when page_speed_estimate < 50 then 'speed' end, case when seo_score < 100 then 'seo' end,
   case when not mobile_friendly then 'mobile' end, case when not has_contact_form then 'form' end, case when not has_whatsapp_widget then 'whatsapp' end], lambda z: z is not null), ','), ''), 'none') as advice
  from website_audits""",
)
def _(t):
    return scoring.audit_total(t.website_audits).select("audit_id", "overall_score", F.array_join("recommendations", ",").alias("advice"))


@query(
    "scr_12_identity_completeness",
    """select company_id, cast(s as int) as identity_confidence, s < 80 or not ph or not em as needs_enrichment from (
  select c.company_id, website_url is not null as ws, phone is not null as ph, email is not null as em, coalesce(li, false) as li, coalesce(dm, false) as dm,
   case when website_url is not null then 40 else 0 end + case when phone is not null then 20 else 0 end + case when email is not null then 20 else 0 end
   + case when dm then 10 else 0 end + case when li then 10 else 0 end as s
  from companies c left join (select company_id, bool_or(is_decision_maker) as dm, bool_or(linkedin_url is not null) as li from contacts group by 1) using (company_id))""",
)
def _(t):
    people = t.contacts.groupBy("company_id").agg(
        F.max("is_decision_maker").alias("has_leadership"), F.max(F.col("linkedin_url").isNotNull()).alias("has_social")
    )
    c = t.companies.select(
        "company_id", F.col("website_url").isNotNull().alias("has_website"), F.col("phone").isNotNull().alias("has_phone"), F.col("email").isNotNull().alias("has_email")
    )
    return scoring.identity_completeness(c.join(people, "company_id", "left")).select("company_id", "identity_confidence", "needs_enrichment")


@query(
    "scr_13_decision_maker",
    f"""select contact_id, cast({sql_dm("title")} as int) as discovery_score, cast({sql_dm("title", "contacts")} as int) as contact_score, {sql_dm("title")} >= 60 as is_decision_maker,
  {sql_dm("title", "contacts")} >= 70 as is_contact_decision_maker, {SQL_CATEGORY} as category from contacts""",
)
def _(t):
    return scoring.decision_makers(t.contacts).select(
        "contact_id", "discovery_score", "contact_score", "is_decision_maker", "is_contact_decision_maker", "category"
    )


@query(
    "scr_14_contact_confidence",
    f"""select contact_id, cast(least(100, {SQL_RAW_SCORE}) as int) as base_score,
  cast(case {SQL_CATEGORY} when 'LEADERSHIP_CONTACT' then greatest(70, least(100, {SQL_RAW_SCORE})) when 'TEAM_CONTACT' then greatest(50, least(100, {SQL_RAW_SCORE}))
   else least(100, {SQL_RAW_SCORE}) end as int) as confidence_score from {SQL_PEOPLE}""",
)
def _(t):
    return scoring.contact_confidence(_person_rows(t)).select("contact_id", "base_score", "confidence_score")


@query(
    "agg_15_coverage",
    """select count(*) as records, count(*) filter (where raw_website <> '') as websites,
  (count(*) filter (where raw_website <> '') + count(*) filter (where raw_phone <> '') + count(*) filter (where raw_email <> '') + count(*) filter (where raw_address <> '')
   + count(*) filter (where platform <> '') + count(*) filter (where quality_score >= 80)) * 100 / (count(*) * 6)::double as coverage_pct from discovery_results""",
)
def _(t):
    return agg.coverage(t.discovery_results)


@query(
    "scr_15_needs_more",
    """select count(*) as records, (count(*) filter (where raw_website <> '') + count(*) filter (where raw_phone <> '') + count(*) filter (where raw_email <> '')
   + count(*) filter (where raw_address <> '') + count(*) filter (where platform <> '') + count(*) filter (where quality_score >= 80)) * 100 / (count(*) * 6)::double as coverage_pct,
   count(*) filter (where raw_website <> '') = 0 as needs_fallback_tier, true as needs_adaptive_tier from discovery_results""",
)
def _(t):
    return scoring.needs_more(agg.coverage(t.discovery_results), 100)


# ---- joined views -------------------------------------------------------------------------------

_CHILD_KEYS = """select company_id, 'intelligence' as section, cast(company_id as string) as child_id from company_intelligence union all
 select company_id, 'signals', cast(company_id as string) from company_signals union all select company_id, 'audits', cast(audit_id as string) from website_audits union all
 select company_id, 'contacts', cast(contact_id as string) from contacts union all select company_id, 'activities', cast(activity_id as string) from activities"""


def _children(t):
    return {
        "intelligence": (t.company_intelligence.withColumn("row_id", F.col("company_id")), "row_id"),
        "signals": (t.company_signals.withColumn("row_id", F.col("company_id")), "row_id"),
        "audits": (t.website_audits, "audit_id"),
        "contacts": (t.contacts, "contact_id"),
        "activities": (t.activities, "activity_id"),
    }


@query(
    "jon_01_company_360",
    f"select company_id, name, section, child_id from companies left join ({_CHILD_KEYS}) using (company_id)",
)
def _(t):
    return joins.company_360(t.companies, _children(t)).select("company_id", "name", "section", "child_id")


def _linked(t):
    m = _marked(t)
    return m.withColumn("company_id", F.when(F.col("record_id") % 3 != 1, F.floor(F.col("record_id") / 4)))


_LINKED = _MARKED.rstrip() + """, ml as (select *, case when record_id % 3 <> 1 then cast(floor(record_id / 4) as bigint) end as company_id from m where not is_duplicate),
 rc as (select ml.*, c.name, c.phone, c.website_url, c.lead_score, c.stage, c.industry from ml left join companies c using (company_id))
"""


@query("jon_02_results_with_companies", _LINKED + " select record_id, source, raw_name, company_id, name, lead_score, created_at from rc")
def _(t):
    return joins.results_with_companies(_linked(t), t.companies).select(
        "record_id", "source", "raw_name", "company_id", "name", "lead_score", "created_at"
    )


_CSV = """select coalesce(nullif(name, ''), raw_name, '') as "Company Name", coalesce(nullif(phone, ''), raw_phone, '') as "Phone", coalesce(raw_email, '') as "Email",
  coalesce(nullif(website_url, ''), raw_website, '') as "Website", coalesce(raw_address, '') as "Address", source as "Source", coalesce(cast(lead_score as string), '') as "Lead Score",
  coalesce(stage, '') as "Pipeline Stage" from rc"""


@query("snk_01_export_csv", _LINKED + _CSV)
def _(t):
    return sinks.csv_frame(joins.results_with_companies(_linked(t), t.companies))


def _sheets(t):
    rc = joins.results_with_companies(_linked(t), t.companies)
    return sinks.export_frames(rc, t.contacts, _intel(t), t.company_signals)


_NAMES = ", nm as (select distinct company_id, name as cn from rc where company_id is not null)"


@query(
    "snk_02_export_companies",
    _LINKED
    + """select coalesce(nullif(name, ''), raw_name, '') as "Company Name", coalesce(industry, '') as "Industry", source as "Source", coalesce(lead_score, 0) as "Lead Score" from rc""",
)
def _(t):
    return _sheets(t)["Companies"].select("Company Name", "Industry", "Source", "Lead Score")


@query(
    "snk_02_export_contacts",
    _LINKED.rstrip()
    + _NAMES
    + """ select coalesce(cn, '') as "Company Name", first_name as "First Name", last_name as "Last Name", coalesce(email, '') as "Email", coalesce(phone, '') as "Phone", coalesce(title, '') as "Title",
  case when is_decision_maker then 'Yes' else 'No' end as "Is Decision Maker", coalesce(linkedin_url, '') as "LinkedIn" from contacts join nm using (company_id)""",
)
def _(t):
    return _sheets(t)["Contacts"]


@query(
    "snk_02_export_intelligence",
    _LINKED.rstrip()
    + _NAMES
    + """ select coalesce(cn, '') as "Company Name", digital_maturity_score as "Digital Maturity Score", replace(services_needed, ',', ', ') as "Services Needed",
  case when crm_detected then 'Yes' else 'No' end as "CRM Detected", case when whatsapp_detected then 'Yes' else 'No' end as "WhatsApp Detected",
  case when booking_detected then 'Yes' else 'No' end as "Booking Detected" from company_intelligence join nm using (company_id)""",
)
def _(t):
    return _sheets(t)["Intelligence"]


@query(
    "snk_02_export_signals",
    _LINKED.rstrip()
    + _NAMES
    + """ select coalesce(cn, '') as "Company Name", coalesce(intent_score, 0) as "Intent Score", case when no_website then 'Yes' else 'No' end as "No Website", case when no_crm then 'Yes' else 'No' end as "No CRM",
  case when no_whatsapp then 'Yes' else 'No' end as "No WhatsApp", case when poor_seo then 'Yes' else 'No' end as "Poor SEO",
  case when no_booking_system then 'Yes' else 'No' end as "No Booking System" from company_signals join nm using (company_id)""",
)
def _(t):
    return _sheets(t)["Signals"]


@query(
    "jon_07_split_new_existing",
    """
with s as (select website_url, min(company_id) as cs from companies where website_url <> '' group by 1), p as (select phone, min(company_id) as cp from companies where phone <> '' group by 1)
select record_id, coalesce(cs, cp) as existing_id, case when cs is not null then 'DUPLICATE_WEBSITE' when cp is not null then 'DUPLICATE_PHONE' end as reason
from discovery_results left join s on raw_website = website_url left join p on raw_phone = phone
""",
)
def _(t):
    return joins.split_new_existing(t.discovery_results, t.companies).select("record_id", "existing_id", "reason")


@query(
    "jon_08_split_new_contacts",
    """
select contact_id, case when email <> '' then not exists (select 1 from contacts k where k.contact_id % 4 <> 0 and k.company_id = b.company_id and k.email = b.email)
  when phone <> '' then not exists (select 1 from contacts k where k.contact_id % 4 <> 0 and k.company_id = b.company_id and k.phone = b.phone)
  else not exists (select 1 from contacts k where k.contact_id % 4 <> 0 and k.company_id = b.company_id and k.first_name = b.first_name and k.last_name = b.last_name) end as is_new
from contacts b where contact_id % 3 = 0
""",
)
def _(t):
    return joins.split_new_contacts(t.contacts.filter("contact_id % 3 = 0"), t.contacts.filter("contact_id % 4 <> 0")).select("contact_id", "is_new")


_DUE = f"""
e as (select e.*, s.day_offset, s.channel, s.template_subject, s.template_body,
  case when s.template_body is null then 'completed' when last_processed_at is null or last_processed_at + to_days(cast(day_offset as int)) <= timestamp '2024-01-25 00:00:00' then 'due' end as action
  from enrollments e left join campaign_steps s on e.campaign_id = s.campaign_id and e.current_step_number = s.step_number where e.status = 'active'),
d as (select e.*, k.first_name from e left join contacts k using (contact_id) where action is not null)
"""


def _due(t):
    return joins.due_steps(t.enrollments, t.campaign_steps, t.contacts, t.companies, ts("2024-01-25 00:00:00"))


@query("jon_09_due_steps", f"with {_DUE} select enrollment_id, campaign_id, current_step_number, action, channel, first_name from d")
def _(t):
    return _due(t).select("enrollment_id", "campaign_id", "current_step_number", "action", "channel", "first_name")


def _sql_fill(c: str) -> str:
    return (
        f"case when instr({c}, '{{{{name}}}}') > 0 then substr({c}, 1, instr({c}, '{{{{name}}}}') - 1) || coalesce(nullif(first_name, ''), 'there') "
        f"|| substr({c}, instr({c}, '{{{{name}}}}') + 8) else {c} end"
    )


@query(
    "prj_13_render_messages",
    f"with {_DUE} select enrollment_id, {_sql_fill('template_subject')} as subject, {_sql_fill('template_body')} as body from d where action = 'due'",
)
def _(t):
    from tessera.operators.projections import render_messages

    return render_messages(_due(t).filter("action = 'due'")).select("enrollment_id", "subject", "body")


@query(
    "jon_10_timeline",
    """select activity_id, activity_type, subject, first_name, last_name, c.name as company_name, a.created_at from (select * from activities order by created_at desc, activity_id desc limit 50) a
  left join contacts k using (contact_id) left join companies c on a.company_id = c.company_id""",
)
def _(t):
    return joins.timeline(t.activities, t.contacts, t.companies, 50)


@query(
    "jon_11_list_members",
    """select list_id, 'company' as kind, company_id as member_id, name, added_at from saved_list_companies join companies using (company_id) union all
  select list_id, 'contact', contact_id, first_name || ' ' || last_name, added_at from saved_list_contacts join contacts using (contact_id)""",
)
def _(t):
    return joins.list_members(t.saved_list_companies, t.saved_list_contacts, t.companies, t.contacts)


@query(
    "jon_12_task_board",
    """select task_id, t.title, t.status, priority, due_date, t.created_at, c.name as company_name, first_name, last_name from tasks t left join companies c on t.company_id = c.company_id
  left join contacts k on t.contact_id = k.contact_id""",
)
def _(t):
    return joins.task_board(t.tasks, t.companies, t.contacts)


@query(
    "jon_13_enrichment_plan",
    """select company_id, name as keyword, coalesce(nullif(city, ''), state, '') as city, missing, source, 5 as max_results from (
  select company_id, name, city, state, 'phone' as missing, unnest(['justdial', 'asklaila', 'grotal', 'yellowpages', 'hotfrog']) as source from companies where phone is null union all
  select company_id, name, city, state, 'website', unnest(['duckduckgo', 'google_dorks']) from companies where website_url is null)""",
)
def _(t):
    gaps = t.companies.select(
        "company_id", "name", "city", "state", F.col("phone").isNull().alias("missing_phone"), F.col("website_url").isNull().alias("missing_website")
    )
    return joins.enrichment_plan(gaps)


@query(
    "jon_14_attach_site_contacts",
    """
with s as (select company_id, 'email' as kind, email as value, case when split_part(email, '@', 1) like 'hello%' then 'generic' else 'personal' end as class from companies where email is not null
  union select company_id, 'email', email, 'personal' from contacts where email is not null and contact_id % 2 = 0 union select company_id, 'phone', phone, null from companies where phone is not null),
l as (select company_id, case when count(*) filter (where kind = 'email' and class = 'personal') = 1 then max(value) filter (where kind = 'email' and class = 'personal') end as le,
  case when count(*) filter (where kind = 'phone') = 1 then max(value) filter (where kind = 'phone') end as lp from s group by 1),
k as (select *, row_number() over (partition by company_id order by -confidence_score, contact_id) as rn from contacts)
select company_id, contact_id, case when rn = 1 and coalesce(email, '') = '' then le else email end as email, case when rn = 1 and coalesce(phone, '') = '' then lp else phone end as phone
from k left join l using (company_id)
""",
)
def _(t):
    generic = F.when(F.split_part("email", F.lit("@"), F.lit(1)).startswith("hello"), "generic").otherwise("personal")
    s = (
        t.companies.filter("email is not null").select("company_id", F.lit("email").alias("kind"), F.col("email").alias("value"), generic.alias("class"))
        .unionByName(t.contacts.filter("email is not null and contact_id % 2 = 0").select("company_id", F.lit("email").alias("kind"), F.col("email").alias("value"), F.lit("personal").alias("class")))
        .unionByName(t.companies.filter("phone is not null").select("company_id", F.lit("phone").alias("kind"), F.col("phone").alias("value"), F.lit(None).cast("string").alias("class")))
    )
    k = t.contacts.select("company_id", "contact_id", (-F.col("confidence_score")).alias("rank_order"), "email", "phone")
    return joins.attach_site_contacts(k, s)


# ---- metrics ------------------------------------------------------------------------------------


@query(
    "agg_01_dashboard_kpis",
    """select total_leads, hot_leads, hot_leads * 5000 as stage_value, round(won * 100 / total_leads::double, 1) as conversion_pct,
  cast((select floor(sum(coalesce(intent_score, 0)) / count(*)::double + 0.5) from company_signals) as int) as avg_intent from (
  select count(*) as total_leads, count(*) filter (where stage in ('DISCOVERED', 'WEBSITE_CRAWLED')) as hot_leads, count(*) filter (where stage = 'READY_FOR_ANALYSIS') as won from companies)""",
)
def _(t):
    return agg.dashboard_kpis(t.companies, t.company_signals, ("DISCOVERED", "WEBSITE_CRAWLED"), "READY_FOR_ANALYSIS")


@query("agg_02_leads_by_industry", "select coalesce(nullif(industry, ''), 'Unknown') as industry, count(*) as leads from companies group by 1")
def _(t):
    return agg.leads_by_industry(t.companies)


@query(
    "agg_03_job_stats",
    """select count(*) as total_jobs, count(*) filter (where status = 'completed') as completed_jobs, count(*) filter (where status = 'failed') as failed_jobs,
  count(*) filter (where status = 'running') as running_jobs, cast(sum(total_raw_results) as bigint) as total_discovered, cast(sum(total_after_dedup) as bigint) as total_after_dedup,
  cast(sum(coalesce(nullif(total_new, 0), total_companies_created, 0)) as bigint) as total_new, cast(sum(total_existing) as bigint) as total_existing from discovery_jobs where user_id = 'bob'""",
)
def _(t):
    return agg.job_stats(t.discovery_jobs, "bob")


@query(
    "agg_05_per_source_counts",
    _MARKED
    + """, s as (select job_id, source, count(*) as n, count(*) filter (where not is_duplicate) as kept from m group by 1, 2),
  e as (select job_id, count(*) as errors from source_runs where error is not null group by 1),
  j as (select job_id, string_agg(source || '=' || n, ',' order by source) as per_source, cast(sum(n) as bigint) as total_raw, sum(kept) as kept from s group by 1)
  select job_id, per_source, coalesce(total_raw, 0) as total_raw, case when coalesce(kept, 0) = 0 then 'failed' when coalesce(errors, 0) > 0 then 'partial' else 'completed' end as status
  from j full join e using (job_id)""",
)
def _(t):
    out = agg.per_source_counts(_marked(t), t.source_runs.filter("error is not null").select("job_id"))
    pairs = F.transform(F.map_entries("per_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("job_id", F.when(F.col("per_source").isNotNull(), F.array_join(pairs, ",")).alias("per_source"), "total_raw", "status")


_REL = """
r as (select *, coalesce(regexp_matches(lower(error), 'block|captcha|403|429'), false) as bl from source_runs),
q as (select *, error is null and not bl and results > 0 as ok from r),
g as (select source, count(*) as total_runs, count(*) filter (where ok) as successful_runs, count(*) filter (where not ok) as failed_runs, count(*) filter (where bl) as blocked_runs,
  cast(sum(results) as bigint) as total_results, cast(sum(contacts) as bigint) as total_contacts, cast(sum(websites) as bigint) as total_websites, cast(sum(duplicates) as bigint) as duplicate_count,
  sum(duration_sec) as total_runtime_sec, max(ts) filter (where ok) as last_success_at, max(ts) filter (where not ok) as last_failure_at from q group by 1),
z as (select *, successful_runs / total_runs::double as success_rate, blocked_runs / total_runs::double as blocked_rate, case when total_results = 0 then 0 else duplicate_count / total_results::double end as duplicate_rate,
  case when successful_runs = 0 then 0 else total_contacts / successful_runs::double end as acr, case when successful_runs = 0 then 0 else total_websites / successful_runs::double end as awr,
  case when successful_runs = 0 then 0 else total_results / successful_runs::double end as arr from g),
y as (select *, round_even(greatest(0.0, least(100.0, success_rate * 40 + least(1.0, acr / 5) * 20 + least(1.0, awr / 5) * 20 - duplicate_rate * 20 - blocked_rate * 20)), 2)::double as reliability_score from z)
"""


@query(
    "agg_06_source_reliability",
    f"with {_REL} select source, total_runs, successful_runs, failed_runs, blocked_runs, total_results, last_success_at, last_failure_at, reliability_score from y",
)
def _(t):
    return agg.source_reliability(t.source_runs).select(
        "source", "total_runs", "successful_runs", "failed_runs", "blocked_runs", "total_results", "last_success_at", "last_failure_at", "reliability_score"
    )


@query(
    "agg_07_classify_runs",
    "select run_id, coalesce(regexp_matches(lower(error), 'block|captcha|403|429'), false) as blocked, error is null and results > 0 as successful from source_runs",
)
def _(t):
    return agg.classify_runs(t.source_runs).select("run_id", "blocked", "successful")


@query(
    "agg_08_source_status",
    f"with {_REL} select source, case when reliability_score < 30 then 'degraded' when blocked_rate > 0.5 then 'blocked' when blocked_rate > 0.2 then 'degraded' else 'ok' end as status from y",
)
def _(t):
    return agg.source_status(agg.source_reliability(t.source_runs)).select("source", "status")


@query(
    "srt_06_source_table",
    f"""with {_REL} select source, reliability_score, total_runs, round(success_rate * 100, 1) as success_pct, round(blocked_rate * 100, 1) as blocked_pct, round(arr, 1) as avg_results from y""",
)
def _(t):
    return agg.source_table(agg.source_reliability(t.source_runs)).select(
        "source", "reliability_score", "total_runs", "success_pct", "blocked_pct", "avg_results"
    )


@query(
    "agg_09_run_telemetry",
    """select job_id, count(*) as sources_attempted, count(*) filter (where error is null and results > 0) as sources_succeeded,
  count(*) filter (where not (error is null and results > 0)) as sources_failed, count(*) filter (where regexp_matches(lower(error), 'block|captcha|403|429')) as sources_blocked,
  cast(sum(results) as bigint) as total_raw_results, cast(sum(contacts) as bigint) as total_contacts, cast(sum(websites) as bigint) as total_websites, round(sum(duration_sec), 2) as total_duration_sec
  from source_runs group by 1""",
)
def _(t):
    return agg.run_telemetry(t.source_runs)


_HEALTH = """h as (select provider, count(*) as n, count(*) filter (where success) as ok, sum(case when success then latency_ms else 0 end) as lat, sum(case when success then companies_found else 0 end) as comp,
  max(ts) filter (where success) as ls, max(ts) filter (where not success) as lf from search_log group by 1)"""


@query(
    "agg_10_provider_health",
    f"""with {_HEALTH} select provider, ok / greatest(1, n)::double as success_rate, lat / greatest(1, ok)::double as avg_latency, comp / greatest(1, ok)::double as avg_companies,
  coalesce(lf > ls and timestamp '2024-01-30 23:59:00' - lf < interval '5' minute, false) as failed_recently from {"h"}""",
)
def _(t):
    return agg.provider_health(t.search_log, ts("2024-01-30 23:59:00")).drop("is_healthy")


@query(
    "win_09_rank_providers",
    f"""with {_HEALTH}, w(provider, weight) as (values ('brave', 50), ('duckduckgo', 90), ('searx', 70), ('gemini', 40), ('bing', 60))
  select w.provider, case when coalesce(lf > ls and (select max(ts) from search_log) - lf < interval '5' minute, false) then 0 else weight end as weight from w left join h using (provider)""",
)
def _(t):
    newest = t.search_log.agg(F.max("ts").alias("now")).withColumn("k", F.lit(1))
    totals = agg.provider_totals(t.search_log).withColumn("k", F.lit(1)).join(newest, "k")
    health = totals.select("provider", "*")
    failed = (F.col("last_failure") > F.col("last_success")) & (F.col("now") - F.col("last_failure") < F.expr("interval '5' minute"))
    health = totals.select("provider", (~F.coalesce(failed, F.lit(False))).alias("is_healthy"))
    rows = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(w).alias("weight")) for p, w in (("brave", 50), ("duckduckgo", 90), ("searx", 70), ("gemini", 40), ("bing", 60))])
    providers = t.spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return joins.rank_providers(providers, health)


_STAGE_DIM = sql_values(list(enumerate(agg.STAGES)), "d(ordinal, stage)")


@query(
    "agg_11_stage_counts",
    f"select ordinal, d.stage, count(c.company_id) as identities from {_STAGE_DIM} left join companies c on d.stage = c.stage group by 1, 2",
)
def _(t):
    return agg.stage_counts(t.companies)


@query(
    "agg_11_mean_time_to_ready",
    """select cast(floor(avg(duration_ms) / 1000 + 0.5) as int) as avg_discovery_time_sec, count(*) as log_rows
  from stage_log where to_stage = 'READY_FOR_ANALYSIS' and duration_ms is not null""",
)
def _(t):
    return agg.mean_time_to_ready(t.stage_log)


@query(
    "agg_12_stage_board",
    f"""select ordinal, d.stage, coalesce(n, 0) as companies_in_stage, company_id, name, lead_score from {_STAGE_DIM} left join (select stage, count(*) as n from companies group by 1) g on d.stage = g.stage
  left join companies c on d.stage = c.stage""",
)
def _(t):
    return agg.stage_board(t.companies)


@query(
    "agg_13_campaign_stats",
    """select campaign_id, name, coalesce(sent, 0) as sent, coalesce(opened, 0) as opened, coalesce(clicked, 0) as clicked, coalesce(replied, 0) as replied, round(opened / nullif(sent, 0)::double * 100, 2) as open_rate,
  round(clicked / nullif(sent, 0)::double * 100, 2) as click_rate, round(replied / nullif(sent, 0)::double * 100, 2) as reply_rate from campaigns left join (
  select campaign_id, count(*) as sent, count(*) filter (where opened) as opened, count(*) filter (where clicked) as clicked, count(*) filter (where replied) as replied from messages group by 1) using (campaign_id)""",
)
def _(t):
    return agg.campaign_stats(t.campaigns.withColumn("campaign_id", F.col("campaign_id").cast("bigint")), t.messages)


@query(
    "agg_14_campaign_list",
    """select campaign_id, name, is_active, coalesce(step_count, 0) as step_count, steps, coalesce(enrolled, 0) as enrolled from campaigns left join (
  select campaign_id, count(*) as step_count, string_agg(step_number || ':' || channel || ':' || day_offset, ',' order by step_number, channel, day_offset) as steps from campaign_steps group by 1) using (campaign_id)
  left join (select campaign_id, count(*) as enrolled from enrollments group by 1) using (campaign_id)""",
)
def _(t):
    return agg.campaign_list(t.campaigns, t.campaign_steps, t.enrollments)


@query(
    "agg_16_discovery_confidence",
    """select job_id, p as phone_found, w as website_exists, e as email_found, s as social_found, m as multi_source_confirmed,
  cast(case when p then 20 else 0 end + case when w then 18 else 0 end + case when e then 15 else 0 end + case when m then 12 else 0 end + case when s then 8 else 0 end as double) as overall_confidence from (
  select job_id, bool_or(coalesce(raw_phone, '') <> '') as p, bool_or(coalesce(raw_website, '') <> '') as w, bool_or(coalesce(raw_email, '') <> '') as e,
  bool_or(coalesce(platform, '') <> '') as s, count(distinct source) > 1 as m from discovery_results group by 1)""",
)
def _(t):
    return agg.discovery_confidence(t.discovery_results).select(
        "job_id", "phone_found", "website_exists", "email_found", "social_found", "multi_source_confirmed", "overall_confidence"
    )


@query(
    "agg_17_extraction_metrics",
    f"""
with k as (select *, case when section_type = 'SERVICE_SECTION' then 'SERVICE_BLOCK' when section_type = 'FAQ_SECTION' then 'MARKETING_CONTENT' when least(100, {SQL_RAW_SCORE}) < 40 then 'LOW_CONFIDENCE'
  when section_type not in {sql_in(rules.PROVEN_SECTIONS)} and not coalesce({sql_any("lower(title)", rules.EXECUTIVE_TITLES)}, false) then 'UNKNOWN_PERSON_NO_EVIDENCE' else 'kept' end as outcome,
  case when {SQL_RAW_SCORE} > 100 then 1 else 0 end + case when {SQL_CATEGORY} = 'LEADERSHIP_CONTACT' and {SQL_RAW_SCORE} < 70 or {SQL_CATEGORY} = 'TEAM_CONTACT' and {SQL_RAW_SCORE} < 50 then 1 else 0 end as cl
  from {SQL_PEOPLE})
select section_type, outcome, count(*) as candidates, cast(sum(cl) as bigint) as clamps from k group by 1, 2
""",
)
def _(t):
    return agg.extraction_metrics(flt.evidence_gate(scoring.contact_confidence(_person_rows(t))))


@query(
    "agg_20_contact_summary",
    """select company_id, count(*) as contacts, count(*) filter (where is_decision_maker) as decision_makers, count(*) filter (where email <> '') as emails,
  count(*) filter (where linkedin_url <> '') as linkedin_urls from contacts group by 1""",
)
def _(t):
    return agg.contact_summary(t.contacts)


@query(
    "agg_21_stage_success",
    """select to_stage, count(*) filter (where success) as completed, count(*) filter (where not success) as failed,
  round(count(*) filter (where success) * 100 / count(*)::double, 2) as success_pct from stage_log group by 1""",
)
def _(t):
    return agg.stage_success(t.stage_log)


@query(
    "agg_22_overall_status",
    f"with {_REL} select case when bool_or(reliability_score < 30 or blocked_rate > 0.2) then 'degraded' else 'healthy' end as overall from y",
)
def _(t):
    return agg.overall_status(agg.source_status(agg.source_reliability(t.source_runs)))


# ---- windows and sorted lists -------------------------------------------------------------------


@query("win_01_latest_audit", f"select company_id, audit_id, seo_score, created_at from {_NEWEST}")
def _(t):
    return _newest_audits(t).select("company_id", "audit_id", "seo_score", "created_at")


@query(
    "win_06_stage_history",
    """select log_id, identity_id, to_stage, lag(to_stage) over w as previous_stage,
  cast(floor((epoch_us(lead(created_at) over w) - epoch_us(created_at)) / 1000.0) as bigint) as ms_in_stage, lead(log_id) over w is null as is_current, created_at
  from stage_log window w as (partition by identity_id order by created_at, log_id)""",
)
def _(t):
    return joins.stage_history(t.stage_log)


@query(
    "win_07_keep_last",
    "select search_id, provider, ts from (select *, row_number() over (partition by provider order by ts desc, search_id desc) as rn from search_log) where rn <= 1000",
)
def _(t):
    return joins.keep_last(t.search_log, ["provider"], [F.desc("ts"), F.desc("search_id")], 1000).select("search_id", "provider", "ts")


@query(
    "srt_03_top_scores",
    """select company_id, coalesce(name, 'Unknown') as name, score from (select company_id, coalesce(intent_score, 0) as score from company_signals order by 2 desc, 1 limit 10)
  left join companies using (company_id)""",
)
def _(t):
    return joins.top_scores(t.company_signals, t.companies, 10)


@query(
    "srt_03_top_decision_makers",
    f"select contact_id, first_name, last_name, cast({sql_dm('title')} as int) as score from contacts order by score desc, contact_id limit 10",
)
def _(t):
    scored = scoring.decision_makers(t.contacts).select("contact_id", "first_name", "last_name", F.col("discovery_score").alias("score"))
    return scored.orderBy(F.desc("score"), F.asc("contact_id")).limit(10)


@query("srt_04_company_contacts", "select company_id, contact_id, is_decision_maker, first_name from contacts")
def _(t):
    return t.contacts.select("company_id", "contact_id", "is_decision_maker", "first_name").orderBy(
        "company_id", F.desc("is_decision_maker"), "contact_id"
    )


# ---- writes as set operations -------------------------------------------------------------------


@query(
    "snk_03_upsert",
    """select company_id, lead_score from company_intelligence where company_id % 5 <> 0 union all
  select company_id, lead_score from companies where company_id % 5 = 0""",
)
def _(t):
    updates = t.companies.filter("company_id % 5 = 0").select("company_id", "lead_score", F.lit(1).alias("seq"))
    stale = updates.withColumns({"lead_score": F.lit(-1).cast("bigint"), "seq": F.lit(0)})
    return sets.upsert(t.company_intelligence.select("company_id", "lead_score"), updates.unionByName(stale), ["company_id"], "seq")


@query(
    "snk_05_cascade_delete",
    " union all ".join(
        f"select '{n}' as table_name, count(*) as deleted from {n} where company_id % 10 = 3"
        for n in ("companies", "contacts", "website_audits", "activities", "tasks")
    ),
)
def _(t):
    children = {n: getattr(t, n) for n in ("contacts", "website_audits", "activities", "tasks")}
    return sets.cascade_delete(t.companies, children, t.companies.filter("company_id % 10 = 3"))[1]


def _job_results(t):
    r = t.discovery_results
    return r.withColumns({"company_id": F.floor(F.col("record_id") / 4), "is_new_company": F.col("record_id") % 3 == 0})


@query(
    "snk_06_delete_jobs",
    """select company_id, name from companies where discovery_job_id not in (2, 5) and company_id not in (
  select cast(floor(record_id / 4) as bigint) from discovery_results where job_id in (2, 5) and record_id % 3 = 0)""",
)
def _(t):
    doomed = t.discovery_jobs.filter("job_id in (2, 5)")
    return sets.delete_jobs(t.discovery_jobs, _job_results(t), t.companies, doomed)["companies"].select("company_id", "name")


@query(
    "set_04_companies_of_jobs",
    """select company_id from companies where discovery_job_id in (2, 5) union
  select cast(floor(record_id / 4) as bigint) from discovery_results where job_id in (2, 5) and record_id % 3 = 0""",
)
def _(t):
    return sets.companies_of_jobs(t.discovery_jobs.filter("job_id in (2, 5)"), _job_results(t), t.companies)


@query(
    "set_06_list_members",
    """select list_id, company_id, min(added_at) as added_at from (select * from saved_list_companies union all
  select list_id, company_id, added_at + interval '1' day from saved_list_companies where company_id % 2 = 0 union all
  select list_id, company_id + 1, added_at from saved_list_companies) where company_id % 10 <> 7 group by 1, 2""",
)
def _(t):
    m = t.saved_list_companies
    more = m.filter("company_id % 2 = 0").withColumn("added_at", F.col("added_at") + F.expr("interval '1' day"))
    more = more.unionByName(m.withColumn("company_id", F.col("company_id") + 1))
    grown = sets.list_add(m, more)
    return sets.list_remove(grown, grown.filter("company_id % 10 = 7").select("list_id", "company_id"))


# ---- batch twins of the streaming jobs ----------------------------------------------------------

_NEXT = " ".join(f"when '{a}' then '{b}'" for a, b in streams.NEXT_STAGE.items())


@query(
    "str_01_stage_state",
    f"""select identity_id, arg_max(to_stage, row(created_at, log_id)) as stage, max(created_at) as since, count(*) as steps from stage_log
  where from_stage in {sql_in(agg.STAGES)} and to_stage = case from_stage {_NEXT} else 'READY_FOR_ANALYSIS' end group by 1""",
)
def _(t):
    return streams.stage_state(t.stage_log)


@query(
    "str_01_illegal_steps",
    f"select log_id from stage_log where not (to_stage = case from_stage {_NEXT} else 'READY_FOR_ANALYSIS' end)",
)
def _(t):
    return streams.illegal_steps(t.stage_log).select("log_id")


_PREV = " ".join(f"when '{a}' then '{b}'" for a, b in streams.PREVIOUS_STAGE.items())


@query(
    "str_02_resume_points",
    f"""select company_id as identity_id, stage, case stage {_PREV} else 'DISCOVERED' end as resume_from,
  case (case stage {_PREV} else 'DISCOVERED' end) {_NEXT} else 'READY_FOR_ANALYSIS' end as next_stage from companies""",
)
def _(t):
    return streams.resume_points(t.companies.select(F.col("company_id").alias("identity_id"), "stage"))


@query(
    "str_03_campaign_counters",
    """with e as (select distinct on (event_id) * from message_events order by event_id), c as (select campaign_id, count(*) filter (where kind = 'sent') as sent_count, count(*) filter (where kind = 'opened') as opened_count,
  count(*) filter (where kind = 'clicked') as clicked_count, count(*) filter (where kind = 'replied') as replied_count from e group by 1),
  u as (select campaign_id, count(distinct message_id) as unique_opens from message_events where kind = 'opened' group by 1) select * from c left join u using (campaign_id)""",
)
def _(t):
    # repeated event ids of one message carry the same kind, so which copy is kept does not matter
    return streams.campaign_counters(t.message_events).join(streams.unique_opens(t.message_events), "campaign_id", "left")


@query(
    "str_04_replied_enrollments",
    """select enrollment_id, campaign_id, contact_id, case when exists (select 1 from message_events m where m.kind = 'replied' and m.campaign_id = e.campaign_id and m.contact_id = e.contact_id)
  then 'replied' else status end as status from enrollments e""",
)
def _(t):
    return streams.replied_enrollments(t.enrollments, t.message_events)


@query(
    "str_05_reliability",
    f"with {_REL} select source, total_runs, reliability_score from y",
)
def _(t):
    return streams.reliability_stream(t.source_runs).select("source", "total_runs", "reliability_score")


def _progress(t):
    return t.stage_log.select(
        F.col("identity_id").alias("company_id"), F.col("to_stage").alias("stage"),
        F.when(F.col("success"), F.when(F.col("to_stage") == "READY_FOR_ANALYSIS", "completed").otherwise("running")).otherwise("failed").alias("status"),
        (F.col("log_id") % 101).cast("int").alias("percent"), F.col("created_at").alias("ts"),
    )


@query(
    "str_06_progress",
    """with p as (select identity_id as company_id, to_stage as stage, case when success then case when to_stage = 'READY_FOR_ANALYSIS' then 'completed' else 'running' end else 'failed' end as status,
   cast(log_id % 101 as int) as percent, created_at as ts from stage_log),
  l as (select company_id, max(row(ts, percent, stage, status)) as m, min(ts) as started, max(ts) as ended from p group by 1),
  k as (select *, row_number() over (partition by company_id order by ts desc, percent desc, stage desc, status desc) as rn from p)
  select k.company_id, stage, status, percent, case when status in ('completed', 'failed') then cast(floor((epoch_us(ended) - epoch_us(started)) / 1000000.0) as bigint) end as duration_sec
  from k join l using (company_id) where rn = 1""",
)
def _(t):
    return streams.progress_stream(_progress(t))


@query(
    "str_07_per_minute",
    "select date_trunc('minute', ts) as minute, event_type, count(*) as events from events group by 1, 2",
)
def _(t):
    return streams.per_minute(t.events)


def _component_events(t):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "stored").otherwise("request")
    return t.events.select(
        F.when(F.col("user_id") % 2 == 0, "ner").otherwise("html").alias("component"), (F.col("user_id") % 20).cast("string").alias("domain"),
        kind.alias("kind"), "ts", F.col("event_id").alias("request_id"),
    )


@query(
    "str_08_freshness",
    """with e as (select case when user_id % 2 = 0 then 'ner' else 'html' end as component, cast(user_id % 20 as string) as domain, case when event_type in ('signup', 'purchase') then 'stored' else 'request' end as kind, ts,
   event_id as request_id from events), x as (select *, max(case when kind = 'stored' then ts end) over (partition by component, domain order by ts, kind desc) as st from e)
  select component, domain, request_id, case when coalesce(ts - st < case component when 'ner' then interval '168' hour else interval '24' hour end, false) then 'hit' else 'miss' end as outcome
  from x where kind = 'request'""",
)
def _(t):
    return streams.batch_freshness(_component_events(t))


def _attempts(t):
    return t.source_runs.filter("error is not null").select(
        (F.col("job_id") * 10 + F.col("run_id") % 10).alias("job_id"), F.lit("discovery").alias("queue"), "error", "ts"
    )


@query(
    "str_09_failed_jobs",
    """select job_id, count(*) as attempts, arg_max(error, ts) as last_error, max(ts) as failed_at from (select job_id * 10 + run_id % 10 as job_id, error, ts from source_runs where error is not null)
  group by 1 having count(*) >= 3""",
)
def _(t):
    return streams.failed_jobs(_attempts(t))
