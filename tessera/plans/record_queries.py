"""Queries over records: sources, projections, filters, duplicates, identities."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.keys import clean_title, clean_url, host_key, trade_name, with_match_keys
from tessera.operators import aggregates as agg
from tessera.operators import filters as flt
from tessera.operators import fusion, joins, projections as prj, resolution as res, sets
from tessera.operators.skew import best_per
from tessera.plans.catalog import (
    query,
    sql_address,
    sql_any,
    sql_digits,
    sql_host,
    sql_in,
    sql_name,
    sql_phone,
    sql_values,
)
from tessera.session import cut_lineage
from tessera.sources import dumps
from tessera.sources.tables import read_table, visible_to

# ---- sources ------------------------------------------------------------------------------------


@query("src_01_read_table", "select c_custkey, c_name, c_acctbal from customer where c_acctbal > 1000")
def _(t):
    return read_table(t.spark, t.base, "customer", ["c_custkey", "c_name", "c_acctbal"], F.col("c_acctbal") > 1000)


CITY_ALIASES = ["mumbai", "pune", "delhi"]


@query(
    "src_04_sitemap_records",
    f"""
with u as (
  select row_id, loc, regexp_replace(regexp_replace(
           list_extract(string_split(regexp_replace(lower(loc), '/+$', ''), '/'), -1), '-contact-address$', ''), '-[0-9]+$', '') as slug
  from sitemap_rows where {sql_any("lower(loc)", CITY_ALIASES + ["kobabu"])}
), n as (
  select row_id, loc, replace(replace(replace(replace(slug, '-mumbai', ''), '-pune', ''), '-delhi', ''), '-', ' ') as nm from u
)
select row_id, array_to_string(list_transform(string_split(nm, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as raw_name,
       'sulekha_sitemap' as source, loc as listing_url, 15 as quality_score
from n where length(nm) >= 3
""",
)
def _(t):
    return dumps.sitemap_records(t.sitemap_rows, CITY_ALIASES, "Kobabu")


@query(
    "src_05_archive_records",
    f"""
with k as (
  select *, row_number() over (partition by urlkey order by snapshot desc, row_id desc) as rn from archive_rows where status_code = '200'
), h as (select *, {sql_host("original")} as host from k where rn = 1),
p as (select *, row_number() over (partition by host order by snapshot desc, row_id desc) as r2 from h where host is not null)
select host, array_to_string(list_transform(string_split(replace(split_part(host, '.', 1), '-', ' '), ' '),
         lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as raw_name,
       'wayback_machine' as source, original as raw_website, snapshot, 40 as quality_score
from p where r2 = 1
""",
)
def _(t):
    return dumps.archive_records(t.archive_rows)


def _listed(host: str, words) -> str:
    return " or ".join(f"{host} = '{w}' or {host} like '%.{w}'" for w in words)


@query(
    "src_06_serp_records",
    f"""
with r as (
  select row_id,
         case when trim(split_part(split_part(split_part(title, '|', 1), '–', 1), ' - ', 1)) <> ''
              then trim(split_part(split_part(split_part(title, '|', 1), '–', 1), ' - ', 1)) else trim(title) end as raw_name,
         case when regexp_extract(href, 'uddg=([^&]*)', 1) <> '' then url_decode(regexp_extract(href, 'uddg=([^&]*)', 1)) else href end
           as raw_website,
         nullif(regexp_replace(regexp_extract(snippet, '{rules.SNIPPET_PHONE_PATTERN}', 0), '[\\s-]', '', 'g'), '') as raw_phone
  from serp_rows
), h as (select *, {sql_host("raw_website")} as host from r)
select row_id, raw_name, raw_website, raw_phone, 'duckduckgo' as source,
       cast(50 + case when raw_phone is not null then 20 else 0 end as int) as quality_score
from h where host is not null and not regexp_matches(host, '\\.gov$|\\.gov\\.in$|\\.nic\\.in$') and not ({_listed("host", rules.SERP_EXCLUDED_HOSTS)})
""",
)
def _(t):
    return dumps.serp_records(t.serp_rows)


@query(
    "src_07_registry_records",
    f"""
with p as (
  select row_id, regexp_replace(title, '(?i)\\s+- Company Details.*$', '') as raw_name,
         nullif(regexp_extract(snippet, '{rules.GSTIN_PATTERN}', 0), '') as gstin,
         nullif(regexp_extract(snippet, '{rules.CIN_PATTERN}', 0), '') as cin
  from registry_rows
)
select row_id, raw_name, gstin, cin, 'mca' as source, cast(15 + case when cin is not null then 10 else 0 end as int) as quality_score
from (select *, row_number() over (partition by cin order by row_id) as rn from p) where rn = 1
""",
)
def _(t):
    return dumps.registry_records(t.registry_rows)


@query(
    "src_07_registry_numbers",
    f"""
select distinct row_id, kind, unnest(found) as number from (
  select row_id, 'gstin' as kind, regexp_extract_all(snippet, '{rules.GSTIN_PATTERN}') as found from registry_rows
  union all select row_id, 'cin', regexp_extract_all(snippet, '{rules.CIN_PATTERN}') from registry_rows)
""",
)
def _(t):
    return dumps.registry_numbers(t.registry_rows, "row_id", "snippet")


@query(
    "src_10_social_records",
    """
with r as (
  select row_id, platform, href as profile_url,
         trim(regexp_replace(trim(regexp_extract(title, '^([^|–@-]*)', 1)),
           '(?i)\\s*(?:on facebook|on instagram|on linkedin|facebook|instagram|linkedin)\\s*$', '')) as raw_name
  from social_rows
)
select row_id, platform, profile_url, raw_name, 'social_google_indexed' as source, 20 as quality_score
from r where contains(lower(profile_url), platform) and length(raw_name) >= 2
""",
)
def _(t):
    return dumps.social_records(t.social_rows)


@query(
    "set_01_union_sources",
    """
select source, count(*) as records, count(host) as with_host from (
  select 'wayback_machine' as source, url as host from websites union all
  select 'documents', null from documents union all
  select source, raw_website from discovery_results) group by source
""",
)
def _(t):
    feeds = [
        t.websites.select(F.lit("wayback_machine").alias("source"), F.col("url").alias("host")),
        t.documents.select(F.lit("documents").alias("source"), "doc_id"),
        t.discovery_results.select("source", F.col("raw_website").alias("host"), "raw_name"),
    ]
    return sets.union_sources(feeds).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("host").alias("with_host"))


# ---- projections --------------------------------------------------------------------------------

_STD_PHONE = "regexp_replace(trim(raw_phone), '[^0-9+]', '', 'g')"


@query(
    "prj_01_standardize",
    f"""
select record_id, coalesce(trim(raw_name), '') as raw_name, coalesce(trim(raw_website), '') as raw_website,
       coalesce(case when {_STD_PHONE} like '0%' then '+91' || substr({_STD_PHONE}, 2)
            when length({_STD_PHONE}) = 10 and {_STD_PHONE} not like '+%' then '+91' || {_STD_PHONE} else {_STD_PHONE} end, '') as raw_phone,
       coalesce(trim(raw_address), '') as raw_address, coalesce(trim(category), '') as category,
       coalesce(trim(raw_email), '') as raw_email, lower(trim(source)) as source
from discovery_results
""",
)
def _(t):
    return prj.standardize(t.discovery_results).select(
        "record_id", "raw_name", "raw_website", "raw_phone", "raw_address", "category", "raw_email", "source"
    )


@query(
    "prj_02_quality_score",
    f"""
select record_id, cast(case when raw_website <> '' then 40 else 0 end + case when raw_email <> '' then 30 else 0 end
   + case when raw_phone <> '' then 25 else 0 end + case when raw_address <> '' then 15 else 0 end
   + case when category <> '' then 10 else 0 end + coalesce(bonus, 0) as int) as quality_score
from discovery_results left join {sql_values(prj.SOURCE_BONUS.items(), "b(src, bonus)")} on lower(source) = src
""",
)
def _(t):
    return prj.quality_score(t.discovery_results).select("record_id", "quality_score")


def _rule_points(source: str) -> str:
    own = [(f, p) for s, f, p in prj.QUALITY_RULES if s == source]
    parts = [str(p) if f == "base" else f"case when {f} <> '' then {p} else 0 end" for f, p in own if f not in ("cap", "raw_rating")]
    return f"when '{source}' then least(100, {' + '.join(parts)})"


@query(
    "prj_03_quality_by_rules",
    f"""
select record_id, source, cast(case source {" ".join(_rule_points(s) for s in ("google_maps", "justdial", "duckduckgo", "mca"))} else 0 end as int)
  as rule_score from (select * replace (case when record_id % 7 = 3 then 'grotal' else source end as source) from discovery_results)
""",
)
def _(t):
    other = F.when(F.col("record_id") % 7 == 3, "grotal").otherwise(F.col("source"))  # a source without rules is in the feed too
    return prj.quality_by_rules(t.discovery_results.withColumn("source", other))


@query(
    "prj_04_match_keys",
    f"""
select record_id, {sql_phone("raw_phone", 10)} as phone_key, {sql_host("raw_website")} as host_key,
       {sql_name("raw_name")} as name_key, {sql_address("raw_address")} as address_key from discovery_results
""",
)
def _(t):
    return with_match_keys(t.discovery_results).select("record_id", "phone_key", "host_key", "name_key", "address_key")


@query(
    "prj_05_clean_urls",
    r"""
select page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') as clean_url from pages
""",
)
def _(t):
    return t.pages.select("page_id", clean_url("url").alias("clean_url"))


@query(
    "prj_06_clean_titles",
    """
select row_id, case when trim(split_part(split_part(split_part(title, '|', 1), '–', 1), ' - ', 1)) <> ''
   then trim(split_part(split_part(split_part(title, '|', 1), '–', 1), ' - ', 1)) else trim(title) end as title,
   trim(split_part(title, '|', 1)) as trade_name
from serp_rows
""",
)
def _(t):
    return t.serp_rows.select("row_id", clean_title("title").alias("title"), trade_name("title").alias("trade_name"))


@query(
    "prj_07_split_names",
    """
select contact_id, split_part(nm, ' ', 1) as first_name, coalesce(nullif(substr(nm, length(split_part(nm, ' ', 1)) + 2), ''), '-') as last_name
from (select contact_id, case when contact_id % 5 = 0 then first_name else first_name || ' ' || last_name end as nm from contacts)
""",
)
def _(t):
    nm = F.when(F.col("contact_id") % 5 == 0, F.col("first_name")).otherwise(F.concat_ws(" ", "first_name", "last_name"))
    return prj.split_names(t.contacts.select("contact_id", nm.alias("name"))).select("contact_id", "first_name", "last_name")


@query(
    "prj_08_name_from_email",
    f"""
select record_id, case when lower(split_part(raw_email, '@', 1)) not in {sql_in(prj.GENERIC_MAILBOXES)} and length(w) >= 2
   then array_to_string(list_transform(string_split(w, ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') end as person
from (select record_id, raw_email, trim(regexp_replace(translate(split_part(raw_email, '@', 1), '._-', '   '), '[0-9]+', '', 'g')) as w
      from discovery_results where raw_email is not null)
""",
)
def _(t):
    return t.discovery_results.filter("raw_email is not null").select("record_id", prj.name_from_email("raw_email").alias("person"))


@query(
    "prj_09_email_candidates",
    f"""
with c as (select contact_id, lower(first_name) as fn, lower(last_name) as ln, {sql_host("website_url")} as d
           from contacts join companies using (company_id)),
l as (select contact_id, unnest([fn || '@' || d, fn || '.' || ln || '@' || d, substr(fn, 1, 1) || ln || '@' || d, fn || substr(ln, 1, 1) || '@' || d,
        fn || ln || '@' || d, fn || '_' || ln || '@' || d, substr(fn, 1, 1) || '.' || ln || '@' || d, 'contact@' || d, 'info@' || d]) as email,
        generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1) - 1 as rank from c where d is not null)
select contact_id, cast(rank as int) as rank, email from l
""",
)
def _(t):
    c = t.contacts.join(t.companies.select("company_id", host_key("website_url").alias("host")), "company_id")
    return prj.email_candidates(c)


_Q = "(select job_id, case job_id % 3 when 0 then keyword || ' in ' || city when 1 then keyword || ' Near  ' || city else keyword end as q from discovery_jobs)"


@query(
    "prj_10_parse_queries",
    rf"""
select job_id, coalesce(nullif(trim(regexp_extract(q, '(?is)^(.+?)\s+in\s+(.+)$', 1)), ''), nullif(trim(regexp_extract(q, '(?is)^(.+?)\s+near\s+(.+)$', 1)), ''), q)
  as keyword, coalesce(nullif(trim(regexp_extract(q, '(?is)^(.+?)\s+in\s+(.+)$', 2)), ''), nullif(trim(regexp_extract(q, '(?is)^(.+?)\s+near\s+(.+)$', 2)), ''))
  as location from {_Q}
""",
)
def _(t):
    k, c = F.col("keyword"), F.col("city")
    q = (
        F.when(F.col("job_id") % 3 == 0, F.concat(k, F.lit(" in "), c))
        .when(F.col("job_id") % 3 == 1, F.concat(k, F.lit(" Near  "), c))
        .otherwise(k)
    )
    return prj.parse_queries(t.discovery_jobs.select("job_id", q.alias("query"))).select("job_id", "keyword", "location")


@query(
    "prj_11_expand_queries",
    """
with s as (select distinct category as keyword, substr(raw_address, instr(raw_address, ', ') + 2) as city from discovery_results
           where category is not null and source = 'google_maps'),
e as (
  select keyword, city, 'search' as kind, 0 as rank, keyword || ' ' || city as query from s union all
  select keyword, city, 'search', 1, case when contains(lower(keyword), 'dentist') or contains(lower(keyword), 'dental') then 'Dental Clinic ' || city
     when contains(lower(keyword), 'hotel') then 'Boutique Hotel ' || city
     when contains(lower(keyword), 'lawyer') or contains(lower(keyword), 'advocate') or contains(lower(keyword), 'law firm') then 'Law Firm ' || city
     when contains(lower(keyword), 'restaurant') or contains(lower(keyword), 'cafe') then 'Top rated restaurants ' || city
     when contains(lower(keyword), 'gym') or contains(lower(keyword), 'fitness') then 'Fitness Center ' || city
     when contains(lower(keyword), 'ca ') or contains(lower(keyword), 'chartered accountant') then 'Accounting Firm ' || city
     else 'Top ' || keyword || ' in ' || city end from s union all
  select keyword, city, 'site', 0, '"' || keyword || '" "' || city || '" site:*.in OR site:*.com' from s union all
  select keyword, city, 'site', 1, '"contact us" "' || keyword || '" "' || city || '"' from s union all
  select keyword, city, 'site', 2, '"about us" "' || keyword || '" "' || city || '"' from s union all
  select keyword, city, 'site', 3, '"services" "' || keyword || '" "' || city || '"' from s union all
  select keyword, city, 'site', 4, 'inurl:contact "' || keyword || '" "' || city || '"' from s)
select keyword, city, kind, rank, query from e
""",
)
def _(t):
    seeds = t.discovery_results.filter("category is not null and source = 'google_maps'").select(
        F.col("category").alias("keyword"), F.expr("substr(raw_address, instr(raw_address, ', ') + 2)").alias("city")
    )
    return prj.expand_queries(seeds.distinct())


# ---- filters ------------------------------------------------------------------------------------

_SEARCHES = "(select job_id as query_id, case job_id % 4 when 0 then 'hotel' when 1 then 'cafe' when 2 then 'furn' else 'law' end as kw, case when job_id % 2 = 0 then lower(city) end as loc from discovery_jobs)"


@query(
    "flt_01_keyword_search",
    f"""
with h as (
  select distinct kw, loc from {_SEARCHES}
), m as (
  select h.kw, h.loc, c.company_id, row_number() over (partition by h.kw, h.loc order by c.company_id) as rank
  from h join companies c on (contains(lower(c.name), kw) or coalesce(contains(lower(c.industry), kw), false) or coalesce(contains(lower(c.description), kw), false))
    and (loc is null or contains(lower(c.city), loc) or contains(lower(c.state), loc))
)
select q.query_id, cast(m.rank as int) as rank, m.company_id from {_SEARCHES} q join m
  on q.kw = m.kw and q.loc is not distinct from m.loc where m.rank <= 50
""",
)
def _(t):
    kw = F.element_at(F.array(*[F.lit(w) for w in ("hotel", "cafe", "furn", "law")]), (F.col("job_id") % 4 + 1).cast("int"))
    q = t.discovery_jobs.select(
        F.col("job_id").alias("query_id"), kw.alias("keyword"), F.when(F.col("job_id") % 2 == 0, F.col("city")).alias("location")
    )
    return flt.keyword_search(t.companies, q)


@query(
    "flt_02_faceted_search",
    """
with f as (
  select c.company_id, c.name, c.created_at, i.lead_score as intel_lead_score, s.intent_score as signal_intent
  from companies c join company_intelligence i using (company_id) join company_signals s using (company_id)
  where c.city ilike '%u%' and i.lead_score >= 20 and i.crm_detected and s.intent_score >= 10
)
select company_id, name, cast(intel_lead_score as bigint) as intel_lead_score, cast(signal_intent as bigint) as signal_intent,
       (select count(*) from f) as total, cast(ceil((select count(*) from f) / 50.0) as bigint) as pages
from f order by created_at desc, company_id limit 50
""",
)
def _(t):
    found = flt.faceted_search(
        t.companies, t.company_intelligence, t.company_signals, city="u", min_lead_score=20, crm_detected=True, min_intent_score=10
    )
    return flt.page_of(found, [F.desc("created_at"), F.asc("company_id")], 1, 50).select(
        "company_id", "name", "intel_lead_score", "signal_intent", "total", "pages"
    )


@query(
    "flt_03_lead_list",
    "select company_id, name, lead_score from companies where (contains(lower(name), 'ba') or contains(lower(city), 'ba')) and status in ('prospect') and lead_score between 10 and 90",
)
def _(t):
    return flt.lead_list(t.companies, "ba", "prospect", 10, 90).select("company_id", "name", "lead_score")


_OWN_EXCLUDED = ("spam-farm.example.org", "cheap-pills.example.com", "example.net")


@query(
    "flt_04_exclude_hosts",
    f"select page_id, host from (select page_id, {sql_host('url')} as host from pages) where host is not null and not ({_listed('host', _OWN_EXCLUDED)})",
)
def _(t):
    hosts = flt.word_table(t.spark, _OWN_EXCLUDED)
    return flt.exclude_hosts(t.pages, hosts, "url", "page_id").select("page_id", host_key("url").alias("host"))


_DIRECTORIES = ("spam-farm.example.org", "example.net")


#: Every third page as a directory's page that links its own host, a store, a known directory and the listed business.
_LISTINGS = """(select page_id, case when page_id % 3 = 0 then 'https://www.example.net/biz/' || page_id else url end as url,
  html || '<a href="https://www.example.net/top">top</a><a href="https://play.google.com/app">app</a><a href="http://spam-farm.example.org/x">more</a><a href="https://shop' || page_id || '.example.com/home">site</a>' as html from pages)"""


@query(
    "flt_05_official_site",
    f"""
with l as (
  select page_id, {sql_host("url")} as own, unnest(regexp_extract_all(html, 'href=["''](https?://[^"'']+)["'']', 1)) as link,
         generate_subscripts(regexp_extract_all(html, 'href=["''](https?://[^"'']+)["'']', 1), 1) as pos
  from {_LISTINGS} where {_listed(sql_host("url"), _DIRECTORIES)}
), h as (select *, {sql_host("link")} as lh from l)
select page_id, arg_min(link, pos) as url from h where lh is not null and not contains(own, lh)
  and not regexp_matches(lh, 'google|apple|android') and not ({_listed("lh", _DIRECTORIES)}) group by page_id
""",
)
def _(t):
    pages = t.pages.select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.example.net/biz/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.concat(
            "html", F.lit('<a href="https://www.example.net/top">top</a><a href="https://play.google.com/app">app</a><a href="http://spam-farm.example.org/x">more</a><a href="https://shop'),
            F.col("page_id").cast("string"), F.lit('.example.com/home">site</a>'),
        ).alias("html"),
    )
    return flt.official_site(pages, flt.word_table(t.spark, _DIRECTORIES))


_D = sql_digits("raw_phone")
_VH = "lower(regexp_extract(raw_website, '^[a-z]*://([^/?#]*)', 1))"


@query(
    "flt_06_verify_records",
    f"""
select record_id, case when coalesce(raw_name, '') = '' or lower(raw_name) = 'unknown' then 'no name'
   when raw_website <> '' and raw_website not like 'http%' then 'website not http'
   when raw_website <> '' and not contains({_VH}, '.') then 'website host'
   when raw_website <> '' and regexp_matches({_VH}, '{"|".join(rules.VERIFY_BLACKLIST)}') then 'website blacklisted'
   when raw_phone <> '' and length({_D}) between 1 and 6 then 'phone too short'
   when raw_phone <> '' and {_D} in {sql_in(rules.FAKE_PHONES)} then 'fake phone'
   when coalesce(raw_website, '') = '' and coalesce(raw_phone, '') = '' then 'no contact' end as reject_reason
from discovery_results
""",
)
def _(t):
    return flt.verify_records(t.discovery_results).select("record_id", "reject_reason")


@query(
    "flt_07_validate_extracted",
    """
select company_id, name as business_name, trim(website_url) as website, lead_score as confidence from companies
where website_url like 'http%' and lead_score >= 80
""",
)
def _(t):
    rows = t.companies.select(
        "company_id",
        F.to_json(
            F.struct(F.col("name").alias("companyName"), F.col("website_url").alias("website"), F.col("lead_score").alias("confidence"))
        ).alias("json"),
    )
    return flt.validate_extracted(rows).select("company_id", "business_name", "website", F.col("confidence").cast("bigint").alias("confidence"))


@query("flt_08_filter_human_names")
def _(t):
    names = t.contacts.join(t.companies.select("company_id", "website_url"), "company_id").select(
        "contact_id",
        F.when(F.col("contact_id") % 7 == 0, F.concat("first_name", F.lit(" Cloud"))).otherwise(F.concat_ws(" ", "first_name", "last_name")).alias("name"),
        F.col("website_url").alias("website"),
    )
    return flt.filter_human_names(names).select("contact_id", "name", "reject_reason")


_T = "lower(trim(title))"


@query(
    "flt_09_filter_titles",
    f"""
select row_id, title from serp_rows where title = '' or title is null or (length({_T}) <= 80 and not {sql_any(_T, rules.DESCRIPTIVE_PHRASES)}
  and (len(string_split_regex({_T}, '\\s+')) <= 8 or regexp_matches({_T}, 'director of|head of|vice president of')))
""",
)
def _(t):
    return flt.filter_titles(t.serp_rows).select("row_id", "title")


def _person_rows(t):
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("LEADERSHIP_SECTION", "TEAM_SECTION", "UNKNOWN", "SERVICE_SECTION", "FAQ_SECTION", "PROFILE_CARD")]),
        (F.col("contact_id") % 6 + 1).cast("int"),
    )
    return t.contacts.select(
        "contact_id", "company_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "title", "email", "phone",
        kind.alias("section_type"), F.lit(None).cast("string").alias("website"), F.col("linkedin_url").isNotNull().alias("has_linkedin"),
        F.col("email").isNotNull().alias("has_email"), F.col("phone").isNotNull().alias("has_phone"), (F.col("contact_id") % 2 == 0).alias("has_image"),
    )


# a title score twin used by several queries
def sql_dm(title: str, ruleset: str = "discovery") -> str:
    low = f"lower({title})"
    if ruleset == "discovery":
        return (
            f"(case when regexp_matches({low}, 'founder|ceo|owner|president|chairman|chief executive') then 95 "
            f"when regexp_matches({low}, 'director|partner|vp') then 80 when regexp_matches({low}, 'head|lead|manager|principal') then 65 "
            f"when regexp_matches({low}, 'staff|associate|executive|coordinator') then 40 else 20 end)"
        )
    return (
        f"(case when contains({low}, 'owner') then 100 when contains({low}, 'founder') then 95 "
        f"when regexp_matches({low}, 'ceo|chief executive') then 90 when regexp_matches({low}, 'chief|vp|vice president|director') then 80 "
        f"when regexp_matches({low}, 'manager|head|lead') then 70 else 30 end)"
    )


LEADING = "founder|ceo|coo|cto|cfo|cmo|director|president|vp|partner|owner|chairperson|managing"
SQL_CATEGORY = (
    f"(case when {sql_dm('title')} >= 60 or coalesce(regexp_matches(lower(title), '{LEADING}'), false) then 'LEADERSHIP_CONTACT' "
    f"when trim(title) <> '' then 'TEAM_CONTACT' else 'UNKNOWN_CONTACT' end)"
)
SQL_PEOPLE = """(select *, case contact_id % 6 when 0 then 'LEADERSHIP_SECTION' when 1 then 'TEAM_SECTION' when 2 then 'UNKNOWN' when 3 then 'SERVICE_SECTION'
  when 4 then 'FAQ_SECTION' else 'PROFILE_CARD' end as section_type from contacts)"""
SQL_RAW_SCORE = """(30 + case when trim(title) <> '' then 25 else 0 end + case when section_type in ('LEADERSHIP_SECTION', 'TEAM_SECTION') then 20 else 0 end
  + case when linkedin_url is not null then 20 else 0 end + case when email is not null then 20 else 0 end
  + case when section_type = 'PROFILE_CARD' then 15 else 0 end + case when contact_id % 2 = 0 then 15 else 0 end
  + case when phone is not null then 10 else 0 end)"""


@query(
    "flt_10_evidence_gate",
    f"""
select contact_id, case when section_type = 'SERVICE_SECTION' then 'SERVICE_BLOCK' when section_type = 'FAQ_SECTION' then 'MARKETING_CONTENT'
  when least(100, {SQL_RAW_SCORE}) < 40 then 'LOW_CONFIDENCE'
  when section_type not in {sql_in(rules.PROVEN_SECTIONS)} and not coalesce({sql_any("lower(title)", rules.EXECUTIVE_TITLES)}, false)
  then 'UNKNOWN_PERSON_NO_EVIDENCE' end as reject_reason
from {SQL_PEOPLE}
""",
)
def _(t):
    from tessera.operators.scoring import contact_confidence

    return flt.evidence_gate(contact_confidence(_person_rows(t))).select("contact_id", "reject_reason")


def ts(text: str):
    return F.lit(text).cast("timestamp")


@query(
    "flt_11_stale_only",
    "select company_id, enriched_at from companies where enriched_at is null or timestamp '2024-03-15 00:00:00' - enriched_at >= interval '30' day",
)
def _(t):
    return flt.stale_only(t.companies, ts("2024-03-15 00:00:00")).select("company_id", "enriched_at")


@query(
    "flt_11_fresh_components",
    """
select activity_id, component, timestamp '2024-01-31 00:00:00' - stored_at < (case component when 'ner' then interval '168' hour else interval '24' hour end) as is_fresh
from (select activity_id, case activity_id % 3 when 0 then 'html' when 1 then 'ner' else 'audit' end as component, created_at as stored_at from activities)
""",
)
def _(t):
    component = F.when(F.col("activity_id") % 3 == 0, "html").when(F.col("activity_id") % 3 == 1, "ner").otherwise("audit")
    stored = t.activities.select("activity_id", component.alias("component"), F.col("created_at").alias("stored_at"))
    return flt.fresh_components(stored, ts("2024-01-31 00:00:00")).select("activity_id", "component", "is_fresh")


@query(
    "flt_12_check_constraints",
    """
select 'contact has neither e-mail nor phone' as rule, cast(contact_id as string) as row_key from contacts where email is null and phone is null
union all select 'maturity is outside 0-100', cast(company_id as string) from company_intelligence where digital_maturity_score not between 0 and 100
union all select 'campaign ends before it starts', cast(job_id as string) from discovery_jobs where total_raw_results > total_after_dedup + 100
union all select 'contact is enrolled twice', cast(campaign_id as string) || '/' || cast(contact_id as string) from enrollments group by campaign_id, contact_id having count(*) > 1
union all select 'phone is used twice', phone from companies where phone <> '' group by phone having count(*) > 1
union all select 'contact without company', cast(contact_id as string) from contacts where company_id not in (select company_id from companies)
union all select 'enrolment without contact', cast(enrollment_id as string) from enrollments where contact_id not in (select contact_id from contacts)
""",
)
def _(t):
    spans = t.discovery_jobs.select(
        F.col("job_id").alias("campaign_id"), F.col("total_raw_results").alias("start_date"), (F.col("total_after_dedup") + 100).alias("end_date")
    )
    return flt.check_constraints(t.companies, t.contacts, t.company_intelligence, spans, t.enrollments)


@query("flt_13_visible_to", "select job_id, keyword from discovery_jobs where user_id = 'alice'")
def _(t):
    return visible_to(t.discovery_jobs, "alice").select("job_id", "keyword")


@query("flt_14_smb_only", "select page_id from pages where not regexp_matches(lower(url), 'spam-farm|example.net')")
def _(t):
    sites = t.pages.select("page_id", F.col("url").alias("website_url"))
    return flt.smb_only(sites, ("spam-farm", "example.net")).select("page_id")


@query(
    "flt_15_pending_analysis",
    "select company_id, analysis_status from companies where last_analyzed_at is null or analysis_status = 'failed' or needs_reanalysis",
)
def _(t):
    return flt.pending_analysis(t.companies).select("company_id", "analysis_status")


@query("flt_16_pending_audits", "select website_id, url, created_at from websites where status = 'pending'")
def _(t):
    return flt.pending_audits(t.websites).select("website_id", "url", "created_at")


# ---- duplicates and identities ------------------------------------------------------------------

_SCORE = """(coalesce(quality_score, 0) * 10 + case when raw_website <> '' then 4 else 0 end + case when raw_email <> '' then 3 else 0 end
   + case when raw_phone <> '' then 2 else 0 end)"""

_EXACT = f"""
k as (select *, {sql_phone("raw_phone")} as pk, {sql_host("raw_website")} as hk, {_SCORE} as sc from discovery_results),
p as (select *, count(*) over (partition by pk) as n, first_value(record_id) over (partition by pk order by sc desc, record_id) as canon from k where pk is not null),
pg as (select record_id, canon as duplicate_of, 'phone' as pass from p where n > 1),
h as (select *, count(*) over (partition by hk) as n, first_value(record_id) over (partition by hk order by sc desc, record_id) as canon
      from k where hk is not null and record_id not in (select record_id from pg)),
g as (select * from pg union all select record_id, canon, 'host' from h where n > 1)"""


@query("ent_01_dedup_exact", f"with {_EXACT} select record_id, duplicate_of, pass from g where record_id <> duplicate_of")
def _(t):
    return res.exact_dedup_pairs(t.discovery_results)


_NAME_PAIRS = """n as (select lower(trim(raw_name)) as nm, min(record_id) as id from discovery_results where raw_name is not null group by 1),
 f as (select x.id as a, y.id as b from n x join n y on x.id < y.id and abs(length(x.nm) - length(y.nm)) <= 6 where 20 * levenshtein(x.nm, y.nm) <= 3 * greatest(length(x.nm), length(y.nm)))"""
# one step a node of the pairs ``f``, carrying the leaders so far
_LEADER_SCAN = """e as (select b, list(a) as before from f group by b),
 o as (select row_number() over (order by node) as i, node, coalesce(before, []) as before from (select a as node from f union select b from f) left join e on b = node),
 s(i, node, leads, leaders) as (select 0::bigint, null::bigint, false, []::bigint[] union all
   select o.i, o.node, not list_has_any(leaders, before), case when list_has_any(leaders, before) then leaders else list_append(leaders, o.node) end from s join o on o.i = s.i + 1),
 led as (select s.node, coalesce(min(f.a) filter (where p.leads), s.node) as leader from s left join f on f.b = s.node left join s p on p.node = f.a where s.node is not null group by s.node)"""


@query(
    "ent_01_dedup_pairs",
    f"""with recursive {_EXACT}, rest as (select * from discovery_results where raw_name is not null and record_id not in (select record_id from g)),
 n as (select lower(trim(raw_name)) as nm, min(record_id) as id from rest group by 1),
 f as (select x.id as a, y.id as b from n x join n y on x.id < y.id and abs(length(x.nm) - length(y.nm)) <= 6 where 20 * levenshtein(x.nm, y.nm) <= 3 * greatest(length(x.nm), length(y.nm))), {_LEADER_SCAN},
 w as (select record_id, coalesce(leader, id) as leader, {_SCORE} as sc from rest join n on lower(trim(raw_name)) = nm left join led on led.node = id),
 c as (select record_id, first_value(record_id) over (partition by leader order by sc desc, record_id) as duplicate_of from w)
 select record_id, duplicate_of, pass from g where record_id <> duplicate_of union all select record_id, duplicate_of, 'name' from c where record_id <> duplicate_of""",
)
def _(t):
    return res.dedup_pairs(t.discovery_results)


@query(
    "ent_02_apply_dedup",
    f"with {_EXACT} select r.record_id, case when g.record_id <> g.duplicate_of then duplicate_of end as duplicate_of, coalesce(g.record_id <> g.duplicate_of, false) as is_duplicate from discovery_results r left join g using (record_id)",
)
def _(t):
    return res.apply_dedup(t.discovery_results, res.exact_dedup_pairs(t.discovery_results)).select("record_id", "duplicate_of", "is_duplicate")


@query(
    "win_02_elect_canonical",
    f"""
select pk as phone_key, canonical, n as members from (
  select pk, record_id as canonical, count(*) over (partition by pk) as n, row_number() over (partition by pk order by sc desc, record_id) as rn
  from (select record_id, {sql_phone("raw_phone")} as pk, {_SCORE} as sc from discovery_results) where pk is not null) where rn = 1
""",
)
def _(t):
    keyed = with_match_keys(t.discovery_results, min_digits=7).filter("phone_key is not null")
    return res.elect_canonical(keyed, "phone_key")


_MARKED = f"""
with {_EXACT}, m as (select r.*, coalesce(g.record_id <> g.duplicate_of, false) as is_duplicate,
  case when coalesce(g.record_id <> g.duplicate_of, false) then null when r.record_id % 3 = 0 then 'EXISTING' else 'NEW' end as result_type
  from discovery_results r left join g using (record_id))
"""


def _marked(t):
    m = res.apply_dedup(t.discovery_results, res.exact_dedup_pairs(t.discovery_results))
    kind = F.when(F.col("is_duplicate"), F.lit(None)).when(F.col("record_id") % 3 == 0, "EXISTING").otherwise("NEW")
    return m.withColumn("result_type", kind)


@query(
    "agg_04_dedup_summary",
    _MARKED
    + """select job_id, count(*) as raw, count(*) filter (where not is_duplicate) as unique_records, count(*) filter (where is_duplicate) as duplicates,
  count(*) filter (where result_type = 'NEW') as new_records, count(*) filter (where result_type = 'EXISTING') as existing_records from m group by job_id""",
)
def _(t):
    return agg.dedup_summary(_marked(t))


# the scan itself: one step a record, carrying the keys that leaders have taken
_MERGE_SCAN = f"""with recursive k as (select record_id as node, {sql_phone("raw_phone", 10)} as p, {sql_host("raw_website")} as h, {sql_name("raw_name")} as n from discovery_results),
 l as (select node, unnest([struct_pack(rank := 1, key := 'p:' || p), struct_pack(rank := 2, key := 'h:' || h), struct_pack(rank := 3, key := 'n:' || n)]) as x from k),
 d as (select node, x.rank as rank, dense_rank() over (order by x.key) as key from l where x.key is not null),
 o as (select row_number() over (order by node) as i, node, list(key) as keys from d group by node),
 s(i, node, leads, taken) as (select 0::bigint, null::bigint, false, []::bigint[] union all
   select o.i, o.node, not list_has_any(taken, keys), case when list_has_any(taken, keys) then taken else list_concat(taken, keys) end from s join o on o.i = s.i + 1),
 own as (select d.key, s.node as owner from s join d on d.node = s.node where s.leads),
 led as (select d.node, arg_min(owner, rank) as leader from d join own using (key) where owner <= d.node group by d.node)"""


@query(
    "ent_03_merge_sources",
    _MERGE_SCAN
    + """, r as (select x.*, coalesce(leader, record_id) as leader from discovery_results x left join led on x.record_id = led.node),
 m as (select leader, count(*) - 1 as duplicates, arg_min(raw_phone, record_id) filter (where raw_phone <> '') as raw_phone, arg_min(raw_website, record_id) filter (where raw_website <> '') as raw_website,
  arg_min(raw_email, record_id) filter (where raw_email <> '') as raw_email, max(quality_score) filter (where record_id = leader) as q from r group by leader)
 select leader as record_id, raw_phone, raw_website, raw_email, cast(case when duplicates = 0 then q else least(100, q + 5 * duplicates) end as int) as quality_score, duplicates from m""",
)
def _(t):
    return res.merge_sources(t.discovery_results).select("record_id", "raw_phone", "raw_website", "raw_email", "quality_score", "duplicates")


@query("ent_04_leaders", f"with recursive {_NAME_PAIRS}, {_LEADER_SCAN} select node, leader from led")
def _(t):
    from tessera.operators.graphs import leaders_by_pairs

    # read for the nodes and for the rounds, so the join runs once
    pairs = cut_lineage(_name_pairs(t).select("a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return leaders_by_pairs(nodes, pairs)


def _name_pairs(t):
    from tessera.functions.keys import fold_name
    from tessera.operators.fuzzy import fuzzy_name_pairs

    names = t.discovery_results.groupBy(fold_name("raw_name").alias("nm")).agg(F.min("record_id").alias("id"))
    return fuzzy_name_pairs(names.filter("nm is not null").select("id", "nm", F.lit(None).cast("long").alias("g")))


@query(
    "jon_05_fuzzy_pairs",
    """
with n as (select lower(trim(raw_name)) as nm, min(record_id) as id from discovery_results where raw_name is not null group by 1)
select x.id as a, y.id as b, cast(levenshtein(x.nm, y.nm) as int) as distance, cast(greatest(length(x.nm), length(y.nm)) as int) as longer
from n x join n y on x.id < y.id and abs(length(x.nm) - length(y.nm)) <= 6
where 20 * levenshtein(x.nm, y.nm) <= 3 * greatest(length(x.nm), length(y.nm))
""",
)
def _(t):
    return _name_pairs(t)


_KEYED = f"""k as (select *, {sql_phone("raw_phone", 10)} as phone_key, {sql_host("raw_website")} as host_key, {sql_name("raw_name")} as name_key,
   {sql_address("raw_address")} as address_key from discovery_results)"""
_LONG_KEYS = """l as (select record_id, 'p' || phone_key as key from k where phone_key is not null union select record_id, 'h' || host_key from k where host_key is not null
   union select record_id, 'n' || name_key from k where name_key is not null union select record_id, 'a' || address_key from k where address_key is not null
   union select record_id, 'g' || gstin from k where gstin is not null union select record_id, 'c' || cin from k where cin is not null)"""
# reachability over shared keys: union-distinct recursion over (record, reached record)
_COMPONENTS = f"""with recursive {_KEYED}, {_LONG_KEYS},
 s as (select record_id, min(record_id) over (partition by key) as low from l),
 e as (select distinct record_id as a, low as b from s where record_id <> low union select distinct low, record_id from s where record_id <> low),
 r(start, node) as (select record_id, record_id from discovery_results union select r.start, e.b from r join e on r.node = e.a),
 members as (select start as record_id, min(node) as identity_id from r group by start)"""


@query("ent_05_resolve_by_keys", _COMPONENTS + " select record_id, identity_id from members")
def _(t):
    return res.resolve_by_keys(t.discovery_results)


@query(
    "ent_05_resolve_identities",
    f"""with recursive {_KEYED}, {_LONG_KEYS},
 n as (select name_key as nm, min(record_id) as id from k where name_key is not null group by 1),
 f as (select x.id as a, y.id as b from n x join n y on x.id <> y.id and abs(length(x.nm) - length(y.nm)) <= 6
       where 20 * levenshtein(x.nm, y.nm) <= 3 * greatest(length(x.nm), length(y.nm))),
 s as (select record_id, min(record_id) over (partition by key) as low from l),
 e as (select distinct record_id as a, low as b from s where record_id <> low union select distinct low, record_id from s where record_id <> low union select a, b from f),
 r(start, node) as (select record_id, record_id from discovery_results union select r.start, e.b from r join e on r.node = e.a)
 select start as record_id, min(node) as identity_id from r group by start""",
)
def _(t):
    return res.resolve_identities(t.discovery_results)


_IDENTITIES = f"""{_COMPONENTS}, j as (select k.*, identity_id from k join members using (record_id)),
 i as (select identity_id, arg_max(name_key, quality_score * 1000000000 - record_id) as normalized_name, arg_min(phone_key, record_id) as phone_key,
   arg_min(host_key, record_id) as host_key, arg_min(gstin, record_id) as gstin, arg_min(cin, record_id) as cin,
   string_agg(distinct source, ',' order by source) as sources, count(distinct source) as source_count, count(*) as records from j group by identity_id)"""
_CONF = """cast(least(100, 50 + case when phone_key is not null then 30 else 0 end + case when host_key is not null then 15 else 0 end
   + case when source_count > 1 then 10 else 0 end + case when gstin is not null then 5 else 0 end + case when cin is not null then 5 else 0 end) as double)"""


@query(
    "ent_06_identities",
    _IDENTITIES
    + f" select identity_id, normalized_name, phone_key, host_key, gstin, cin, sources, cast(source_count as int) as source_count, records, {_CONF} as identity_confidence from i",
)
def _(t):
    records = cut_lineage(t.discovery_results)
    out = res.identities(records, res.resolve_by_keys(records))
    return out.select(
        "identity_id", "normalized_name", "phone_key", "host_key", "gstin", "cin", F.array_join("sources", ",").alias("sources"),
        "source_count", "records", "identity_confidence",
    )


@query(
    "win_03_best_record",
    _COMPONENTS
    + """ select identity_id, record_id, raw_name, quality_score from (select r.*, identity_id, row_number() over (partition by identity_id order by quality_score desc, record_id) as rn
   from discovery_results r join members using (record_id)) where rn = 1""",
)
def _(t):
    return res.best_record(t.discovery_results, res.resolve_by_keys(t.discovery_results)).select("identity_id", "record_id", "raw_name", "quality_score")


@query(
    "win_04_best_website",
    _COMPONENTS
    + """, j as (select k.*, identity_id from k join members using (record_id)),
 a as (select identity_id, phone_key as ap, address_key as aa from (select *, row_number() over (partition by identity_id order by record_id) as rn from j where source = 'google_maps') where rn = 1),
 w as (select j.*, case source when 'google_maps' then 20 when 'duckduckgo' then 15 when 'website_search' then 10 else 0 end
   + case when raw_website like 'https://%' then 10 else 0 end + case when phone_key = ap then 25 else 0 end + case when address_key = aa then 20 else 0 end as website_score
   from j left join a using (identity_id) where raw_website <> '')
 select identity_id, record_id, raw_website, cast(website_score as int) as website_score from (select *, row_number() over (partition by identity_id order by website_score desc, record_id) as rn from w) where rn = 1""",
)
def _(t):
    return res.best_website(t.discovery_results, res.resolve_by_keys(t.discovery_results)).select(
        "identity_id", "record_id", "raw_website", "website_score"
    )


def _split_batches(t):
    """Older two thirds of the companies' records as the known side, the rest as a new batch."""
    old = t.discovery_results.filter("source = 'google_maps' or source = 'mca'")
    return old, t.discovery_results.filter("source = 'justdial' or source = 'duckduckgo'")


_MATCHES = f"""
with r as (select record_id, {sql_phone("raw_phone")} as p, {sql_host("raw_website")} as h, lower(trim(raw_name)) as n from discovery_results),
c as (select company_id, {sql_phone("phone")} as p, {sql_host("website_url")} as h, lower(trim(name)) as n from companies),
m as (
  select r.record_id, c.company_id, 1.0::double as confidence, 'Exact Phone Match' as reason from r join c on r.p = c.p
  union all select r.record_id, c.company_id, 0.9::double, 'Exact Domain Match' from r join c on r.h = c.h where r.p is distinct from c.p or r.p is null
  union all select r.record_id, c.company_id, 1 - levenshtein(r.n, c.n) / greatest(length(r.n), length(c.n))::double, 'Fuzzy Name Match'
    from r join c on abs(length(r.n) - length(c.n)) <= 6 where (r.p is distinct from c.p or r.p is null) and (r.h is distinct from c.h or r.h is null)
      and 20 * levenshtein(r.n, c.n) <= 3 * greatest(length(r.n), length(c.n)))"""


@query(
    "jon_04_match_existing",
    f"""
{_MATCHES}
select record_id, company_id, confidence, reason from (select *, row_number() over (partition by record_id order by confidence desc, company_id) as rn from m) where rn = 1
""",
)
def _(t):
    return res.match_existing(t.discovery_results, t.companies)


def _known_identities(t):
    old, batch = _split_batches(t)
    return res.identities(old, res.resolve_by_keys(old)), batch


_OLD_NEW = f"""with recursive {_KEYED}, o as (select * from k where source in ('google_maps', 'mca')),
 l as (select record_id, 'p' || phone_key as key from o where phone_key is not null union select record_id, 'h' || host_key from o where host_key is not null
   union select record_id, 'n' || name_key from o where name_key is not null union select record_id, 'a' || address_key from o where address_key is not null
   union select record_id, 'g' || gstin from o where gstin is not null union select record_id, 'c' || cin from o where cin is not null),
 s as (select record_id, min(record_id) over (partition by key) as low from l),
 e as (select distinct record_id as a, low as b from s where record_id <> low union select distinct low, record_id from s where record_id <> low),
 r(start, node) as (select record_id, record_id from o union select r.start, e.b from r join e on r.node = e.a),
 members as (select start as record_id, min(node) as identity_id from r group by start),
 i as (select identity_id, arg_max(name_key, quality_score * 1000000000 - record_id) as normalized_name, arg_min(phone_key, record_id) as phone_key,
   arg_min(host_key, record_id) as host_key, arg_min(gstin, record_id) as gstin, arg_min(cin, record_id) as cin from o join members using (record_id) group by identity_id),
 b as (select * from k where source in ('justdial', 'duckduckgo')),
 hits as (select record_id, identity_id, 1 as pr from b join i on b.phone_key = i.phone_key
   union all select record_id, identity_id, 2 from b join i on b.host_key = i.host_key
   union all select record_id, identity_id, 3 from b join i on b.gstin = i.gstin
   union all select record_id, identity_id, 4 from b join i on b.cin = i.cin
   union all select record_id, identity_id, 5 from b join i on abs(length(name_key) - length(normalized_name)) <= 6 and contains(normalized_name, substr(name_key, 1, 10))
     where 20 * levenshtein(name_key, normalized_name) <= 3 * greatest(length(name_key), length(normalized_name))),
 best as (select * from (select *, row_number() over (partition by record_id order by pr, identity_id) as rn from hits) where rn = 1)"""


@query(
    "jon_06_lookup_identity",
    _OLD_NEW
    + " select record_id, identity_id, case pr when 1 then 'phone' when 2 then 'host' when 3 then 'gstin' when 4 then 'cin' else 'name' end as matched_on from best",
)
def _(t):
    known, batch = _known_identities(t)
    return res.lookup_identity(batch, known)


@query("ent_07_upsert_identities")
def _(t):
    known, batch = _known_identities(t)
    return res.upsert_identities(batch, known).select(
        "identity_id", "normalized_name", F.array_join("sources", ",").alias("sources"), "source_count", "records", "identity_confidence"
    )


@query("ent_08_ingest_results")
def _(t):
    return res.ingest_results(t.discovery_results, t.companies)


@query(
    "agg_19_skip_reasons",
    f"""
{_MATCHES}
select reason, count(*) as n from (select *, row_number() over (partition by record_id order by confidence desc, company_id) as rn from m) where rn = 1 group by reason
""",
)
def _(t):
    matched = res.match_existing(t.discovery_results, t.companies).withColumn("result_type", F.lit("EXISTING"))
    return res.skip_reasons(matched)


@query(
    "ent_09_link_companies",
    _COMPONENTS
    + """ select company_id, identity_id from (select cast(floor(r.record_id / 4) as bigint) as company_id, identity_id,
   row_number() over (partition by cast(floor(r.record_id / 4) as bigint) order by quality_score desc, r.record_id) as rn
   from discovery_results r join members using (record_id) where source <> 'mca') where rn = 1""",
)
def _(t):
    r = t.discovery_results.filter("source <> 'mca'").withColumn("company_id", F.floor(F.col("record_id") / 4))
    return res.link_companies(r, res.resolve_by_keys(t.discovery_results))


@query(
    "ent_10_merge_contacts",
    f"""
with c as (select contact_id as seq, company_id, first_name || ' ' || last_name as name, title, email, phone, linkedin_url, confidence_score, {sql_dm("title")} as dm from contacts)
select company_id, lower(name) as name_key, arg_max(name, length(name) * 1000000000 + seq) as name, arg_max(title, length(title) * 1000000000 + seq) as title,
  arg_min(email, seq) filter (where email <> '') as email, arg_min(phone, seq) filter (where phone <> '') as phone, max(confidence_score) as confidence_score,
  cast(max(dm) as int) as decision_maker_score, case when bool_or(email is not null) and bool_or(phone is not null) then case when arg_min(email is not null, seq) or arg_min(phone is null, seq) then 'e' else 'p' end else '?' end as first_kind
from c group by company_id, lower(name)
""",
)
def _(t):
    from tessera.operators.scoring import decision_maker_score

    reasons = F.array_compact(F.array(F.when(F.col("email").isNotNull(), F.lit("e")), F.when(F.col("phone").isNotNull(), F.lit("p"))))
    c = t.contacts.select(
        F.col("contact_id").alias("seq"), "company_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "title", "email", "phone",
        "linkedin_url", "confidence_score", decision_maker_score(F.col("title")).alias("decision_maker_score"), reasons.alias("reasons"),
    )
    m = res.merge_contacts(c)
    first = F.when(F.size("reasons") == 2, F.get("reasons", F.lit(0))).otherwise("?")
    return m.select("company_id", "name_key", "name", "title", "email", "phone", "confidence_score", "decision_maker_score", F.coalesce(first, F.lit("?")).alias("first_kind"))


@query(
    "ent_11_merge_profiles",
    """
with c as (select contact_id as seq, coalesce(nullif(linkedin_url, ''), lower(first_name)) as profile_key, first_name as full_name, title, confidence_score as confidence from contacts),
k as (select * from (select *, row_number() over (partition by profile_key order by confidence desc, seq) as rn from c) where rn = 1),
l as (select c.profile_key, arg_min(c.title, c.seq) as t from c join k using (profile_key) where c.seq > k.seq and c.title <> '' group by 1)
select profile_key, full_name, coalesce(nullif(title, ''), t) as title, confidence from k left join l using (profile_key)
""",
)
def _(t):
    c = t.contacts.select(
        F.col("contact_id").alias("seq"), F.col("first_name").alias("full_name"), "title", "linkedin_url", F.col("confidence_score").alias("confidence")
    )
    return res.merge_profiles(c)


_CAND = "(select * from field_candidates)"


def _weights_sql() -> str:
    return sql_values([(s.lower(), w) for s, w in rules.SOURCE_WEIGHTS.items()], "w(src, weight)")


def _canon_sql() -> str:
    return sql_values(rules.CANONICAL_INDUSTRY.items(), "m(k, v)")


@query(
    "ent_12_fuse_fields",
    f"""
with c as (select f.*, coalesce(m.v, lower(trim(value))) as canon, confidence / 100.0::double * coalesce(w.weight, 0.5)::double as pts
  from field_candidates f left join {_weights_sql()} on lower(source) = src left join {_canon_sql()} on lower(trim(value)) = m.k),
g as (select entity_id, field, canon, sum(pts) as ws, count(*) as votes, min(seq) as first_seq,
   arg_max(value, confidence * 1000000000.0 - seq) as value, string_agg(distinct source, ',' order by source) as sources from c where canon <> '' group by 1, 2, 3),
s as (select *, least(100.0, ws / votes * 100 + least(10.0, (votes - 1) * 3.0)) as score from g),
b as (select *, row_number() over (partition by entity_id, field order by round(score, 9) desc, first_seq) as rn from s),
n as (select entity_id, field, count(*) as candidate_count from c group by 1, 2)
select entity_id, field, value, round_even(round(score, 6), 1) as confidence, sources, candidate_count from b join n using (entity_id, field) where rn = 1
""",
)
def _(t):
    return fusion.fuse_fields(t.field_candidates).withColumn("sources", F.array_join("sources", ","))


@query(
    "ent_13_fuse_phones",
    f"""
with c as (select f.*, case when length({sql_digits("value")}) >= 10 then right({sql_digits("value")}, 10) else {sql_digits("value")} end as canon,
   confidence / 100.0::double * coalesce(w.weight, 0.5)::double as pts from field_candidates f left join {_weights_sql()} on lower(source) = src where field = 'phone'),
g as (select entity_id, field, canon, sum(pts) as ws, count(*) as votes, min(seq) as first_seq, max(confidence) as top,
   arg_max(value, confidence * 1000000000.0 - seq) as value, string_agg(distinct source, ',' order by source) as sources from c where canon <> '' group by 1, 2, 3),
b as (select *, row_number() over (partition by entity_id, field order by round(ws, 9) desc, first_seq) as rn from g),
n as (select entity_id, field, count(*) as candidate_count from c group by 1, 2)
select entity_id, field, value, round_even(least(100.0, top + least(5.0, (votes - 1) * 2.0)), 1)::double as confidence, sources, candidate_count
from b join n using (entity_id, field) where rn = 1
""",
)
def _(t):
    return fusion.fuse_phones(t.field_candidates.filter("field = 'phone'")).withColumn("sources", F.array_join("sources", ","))


@query(
    "scr_16_canonical_industry",
    f"select seq, coalesce(v, lower(trim(value))) as canonical from field_candidates left join {_canon_sql()} on lower(trim(value)) = k where field = 'industry'",
)
def _(t):
    return fusion.canonical_industry(t.field_candidates.filter("field = 'industry'"), "value").select("seq", "canonical")


@query(
    "udf_03_custom_rules",
    """
select entity_id, field, round_even(round(max(score), 6), 1) as confidence from (
  select entity_id, field, least(100.0, sum(confidence / 100.0::double * case when lower(source) = 'website' then 0.9 else 0.5 end::double) / count(*) * 100
     + least(10.0, (count(*) - 1) * 3.0)) as score from field_candidates where trim(value) <> '' group by entity_id, field, case when lower(trim(value)) = 'hotel' then 'stay' else lower(trim(value)) end)
group by 1, 2
""",
)
def _(t):
    out = fusion.fuse_fields(t.field_candidates, weights={"website": 0.9}, canon={"hotel": "stay"})
    return out.select("entity_id", "field", "confidence")


@query(
    "win_05_best_field_value",
    """select entity_id, field, seq, value, source, confidence from (select *, row_number() over (partition by entity_id, field order by confidence desc, seq) as rn
   from field_candidates) where rn = 1""",
)
def _(t):
    return fusion.best_field_value(t.field_candidates).select("entity_id", "field", "seq", "value", "source", "confidence")


@query(
    "win_05_candidate_history",
    """select entity_id, field, seq, value, source, confidence, row_number() over (partition by entity_id, field order by confidence desc, seq) = 1 as is_best from field_candidates""",
)
def _(t):
    return fusion.candidate_history(t.field_candidates)


def _linked_results(t):
    return t.discovery_results.withColumn("company_id", F.when(F.col("record_id") % 8 == 0, F.floor(F.col("record_id") / 4)))


@query(
    "ent_15_promote_results",
    """select case when record_id % 8 = 0 then cast(cast(floor(record_id / 4) as bigint) as string) else 'r' || cast(record_id as string) end as company_key
   from discovery_results where record_id % 5 < 3""",
)
def _(t):
    r = _linked_results(t)
    return res.promote_results(r, r.filter("record_id % 5 < 3").select("record_id"))["work_list"]


@query(
    "set_02_hybrid_results",
    """
select source, company_id, raw_name, raw_address, result_type, discovered_now from (
 select 'database' as source, company_id, name as raw_name, trim(city || ', ' || coalesce(state, '')) as raw_address, 'EXISTING' as result_type, false as discovered_now from companies where industry = 'furniture'
 union all select source, null, raw_name, raw_address, null, true from discovery_results)
""",
)
def _(t):
    return sets.hybrid_results(t.companies.filter("industry = 'furniture'"), t.discovery_results).select(
        "source", "company_id", "raw_name", "raw_address", "result_type", "discovered_now"
    )


@query(
    "set_03_novel_only",
    f"""
with k as (select record_id, {sql_host("raw_website")} as host from discovery_results),
c as (select {sql_host("website_url")} as host from companies where company_id % 2 = 0)
select host, min(record_id) as record_id from k where host is not null and host not in (select host from c where host is not null) group by host
""",
)
def _(t):
    return sets.novel_only(t.discovery_results, t.companies.filter("company_id % 2 = 0")).select("host", "record_id")
