"""Queries over pages, texts, vectors and model output."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import extraction as ext
from tessera.operators import projections as prj
from tessera.operators import scoring, vectors
from tessera.plans.catalog import query, sql_any, sql_host, sql_in
from tessera.sources.pages import page_nodes
from tessera.sources.registry import score_text


def sql_decode(c: str) -> str:
    for code, char in ext.ENTITIES:
        c = f"replace({c}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def sql_strip(c: str) -> str:
    return f"trim(regexp_replace({sql_decode(f'regexp_replace({c}, $$<[^>]*>$$, $$ $$, $$g$$)')}, '\\s+', ' ', 'g'))"


def sql_first(pattern: str, c: str = "html") -> str:
    return f"nullif({sql_strip(f'regexp_extract({c}, $${pattern}$$, 1)')}, '')"


TITLE, H1 = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"
DESCRIPTION = r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
HREF = r"""(?is)<a\s[^>]*?href=["']([^"']*)["']"""


#: Markup appended to the given pages, picked by page_id, so that the rules below meet something: addresses, profiles, products.
SNIPPETS = (
    "",
    '<p>12, Park Road near the market</p><p>7 Lake View Street, Pune</p><p>call 5</p>',
    '<a href="https://www.facebook.com/acme">f</a><a href="https://instagram.com/acme.co">i</a>',
    '<a href="https://facebook.com/sharer?u=1">share</a><a href="https://x.com/acme">x</a>',
    '<a href="https://www.linkedin.com/company/acme">l</a><a href="https://youtube.com/@acme">y</a>',
    '<link href="/wp-content/a.css"><script src="/jquery.min.js"></script>',
    '<div id="__next_data__" class="tw-flex"></div><script src="https://cdn.shopify.com/a.js"></script>',
    '<script type="application/ld+json">{"@type": "Organization", "name": "Acme"}</script>',
    '<a href="/about-us">About</a><a href="/our-services">Services</a><a href="/contact">Contact</a>',
)
_PICK = " ".join(f"when {i} then $${x}$$" for i, x in enumerate(SNIPPETS))
SNIPPED = f"(select * replace (html || case page_id % {len(SNIPPETS)} {_PICK} end as html) from pages)"


def _snipped(t):
    """The given pages, each with one snippet appended."""
    pick = F.get(F.array(*[F.lit(x) for x in SNIPPETS]), (F.col("page_id") % len(SNIPPETS)).cast("int"))
    return t.pages.withColumn("html", F.concat("html", pick))


@query(
    "src_08_page_json_ld",
    f"select page_id, 1 as pos from {SNIPPED} where regexp_matches(html, '(?is)<script[^>]*type=[\"'']application/ld\\+json') ",
)
def _(t):
    return ext.parse_json_ld(ext.page_meta(_snipped(t))).select("page_id", (F.col("pos") + 1).alias("pos"))


@query("ext_01_clean_pages")
def _(t):
    return ext.clean_pages(page_nodes(t.pages))


@query(
    "ext_02_page_meta",
    f"""select page_id, {sql_first(TITLE)} as title, {sql_first(H1)} as h1, nullif(regexp_extract(html, $${DESCRIPTION}$$, 1), '') as description,
  substr(regexp_extract(html, $$(?i)<html[^>]*\\slang=["']([^"']*)["']$$, 1), 1, 5) as language,
  len(list_filter(list_transform(regexp_extract_all(html, $$(?is)<h[123][^>]*>(.*?)</h[123]>$$, 1), lambda h: {sql_strip("h")}), lambda h: length(h) between 4 and 149)) as headings
  from pages""",
)
def _(t):
    return ext.page_meta(t.pages).select("page_id", "title", "h1", "description", "language", F.size("headings").cast("bigint").alias("headings"))


@query("ext_03_page_sections")
def _(t):
    return ext.page_sections(page_nodes(t.pages)).select("page_id", "title", "hero", "footer", "about", F.size("services").alias("services"))


def _sql_contacts(source: str, key: str, text: str) -> str:
    # a list with its first places, distinct: the smallest place per value
    return f"""
e as (select {key}, lower(unnest(regexp_extract_all({text}, $${rules.EMAIL_PATTERN}$$, 0))) as value, generate_subscripts(regexp_extract_all({text}, $${rules.EMAIL_PATTERN}$$, 0), 1) as i from {source}),
w as (select {key}, regexp_replace(unnest(regexp_extract_all({text}, $$(?i)wa\\.me/(\\+?[0-9][0-9\\s\\-]*)$$, 1)), '\\s', '', 'g') as value, generate_subscripts(regexp_extract_all({text}, $$(?i)wa\\.me/(\\+?[0-9][0-9\\s\\-]*)$$, 1), 1) as i from {source}),
p as (select {key}, trim(unnest(regexp_extract_all({text}, $${rules.PHONE_PATTERN}$$, 0))) as value, generate_subscripts(regexp_extract_all({text}, $${rules.PHONE_PATTERN}$$, 0), 1) as i from {source}),
f as (select {key}, 'email' as kind, value, min(i) as i from e group by 1, 3 union all
  select {key}, 'phone', value, min(i) from p where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 group by 1, 3 union all
  select {key}, 'whatsapp', value, min(i) from w group by 1, 3),
contacts_found as (select {key}, kind, value, case when kind = 'email' then case when split_part(value, '@', 1) in {sql_in(rules.GENERIC_EMAILS)} then 'generic' else 'personal' end end as class,
  cast(row_number() over (partition by {key}, kind order by i) - 1 as int) as pos from f)"""


@query("ext_04_document_contacts", f"with {_sql_contacts('documents', 'doc_id', 'text')} select doc_id, kind, value, class, pos from contacts_found")
def _(t):
    return ext.extract_contacts(t.documents)


#: Every fourth page with a WhatsApp link.
_WHATSAPPED = """(select page_id, url, html || case when page_id % 4 = 0 then '<a href="https://wa.me/9198' || (76543210 + page_id % 5) || '">chat</a>' else '' end as html from pages)"""


def _whatsapped(t):
    link = F.concat(F.lit('<a href="https://wa.me/9198'), (F.col("page_id") % 5 + 76543210).cast("string"), F.lit('">chat</a>'))
    return t.pages.withColumn("html", F.concat("html", F.when(F.col("page_id") % 4 == 0, link).otherwise("")))


@query(
    "agg_18_site_contacts",
    f"""with {_sql_contacts(_WHATSAPPED, 'page_id', 'html')} select site, kind, value, arg_min(class, page_id * 100000 + pos) as class, min(page_id) as first_page from contacts_found
  join (select page_id, {sql_host("url")} as site from pages) using (page_id) group by site, kind, value""",
)
def _(t):
    return ext.site_contacts(ext.extract_contacts(_whatsapped(t), "page_id", "html"), t.pages)


@query(
    "ext_05_addresses",
    f"""select page_id, cast(i - 1 as int) as pos, address from (select page_id, unnest(regexp_extract_all(html, $${rules.ADDRESS_PATTERN}$$, 0)) as address,
  generate_subscripts(regexp_extract_all(html, $${rules.ADDRESS_PATTERN}$$, 0), 1) as i from {SNIPPED})""",
)
def _(t):
    return ext.extract_addresses(_snipped(t), "page_id", "html")


@query(
    "ext_06_social_profiles",
    " union all ".join(
        # a share link of the one rule that excludes it is taken out of the markup first
        f"select page_id, '{n}' as network, regexp_extract(h, $${p.replace('(?!sharer)', '')}$$, 0) as link from (select page_id, replace(html, 'facebook.com/sharer', '') as h from {SNIPPED}) where regexp_matches(h, $${p.replace('(?!sharer)', '')}$$)"
        for n, p in rules.SOCIAL_PATTERNS.items()
    ),
)
def _(t):
    return ext.social_profiles(_snipped(t))


@query(
    "ext_07_detect_technology",
    f"select site, technology, 85 as confidence, count(*) as pages from (select {sql_host('url')} as site, html, unnest({list(rules.TECH_SIGNATURES)!r}) as technology from {SNIPPED}) where "
    + " or ".join(f"(technology = '{n}' and {sql_any('lower(html)', words)})" for n, words in rules.TECH_SIGNATURES.items())
    + " group by 1, 2",
)
def _(t):
    return ext.detect_technology(_snipped(t))


@query(
    "ext_08_detect_signals",
    f"select {sql_host('url')} as site, "
    + ", ".join(f"bool_or({sql_any('lower(html)', words)}) as {n}" for n, words in rules.SIGNAL_SIGNATURES.items())
    + " from pages group by 1",
)
def _(t):
    return ext.detect_signals(t.pages)


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1)"
_FOLDER = f"regexp_replace(case when {_PATH} = '' then '/' else {_PATH} end, '[^/]*$', '')"
_LINKS = f"""
h as (select page_id, url, trim({sql_decode("unnest(regexp_extract_all(html, $$" + HREF + "$$, 1))")}) as h, generate_subscripts(regexp_extract_all(html, $${HREF}$$, 1), 1) as i from pages),
a as (select page_id, url, i, case when regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then h when h like '//%' then regexp_extract(url, '^(https?:)', 1) || h when h like '/%' then {_ORIGIN} || h
  when h like '?%' then {_ORIGIN} || case when {_PATH} = '' then '/' else {_PATH} end || h else {_ORIGIN} || {_FOLDER} || regexp_replace(h, '^(?:\\./)+', '') end as link
  from h where not regexp_matches(h, '^(?:mailto:|tel:|javascript:|#)') and h <> ''),
d as (select page_id, url, link, min(i) as i from a group by 1, 2, 3),
links as (select page_id, url, link, cast(row_number() over (partition by page_id order by i) - 1 as int) as pos from d)"""
_INTERNAL = "regexp_extract(link, '^https?://([^/?#]+)', 1) = regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query("ext_09_page_links", f"with {_LINKS} select page_id, url, link, pos from links where {_INTERNAL}")
def _(t):
    return ext.page_links(t.pages)


_SUBPATH = "regexp_replace(regexp_extract(link, '^https?://[^/?#]+(/[^?#]*)?', 1), '/+$', '')"


@query(
    "win_08_rank_links",
    f"""with {_LINKS}, s as (select *, {sql_host("url")} as site, {_SUBPATH} as path, case when {_SUBPATH} = '' then 100 else greatest(10, {", ".join(f"case when contains(lower(link), '{w}') then {v} else 10 end" for w, v in rules.PAGE_PRIORITIES.items())}) end as pr
   from links where {_INTERNAL}),
  b as (select site, path, max(pr) as priority, min(page_id * 100000 + pos) as o, arg_min(link, page_id * 100000 + pos) as link from s where pr > 20 group by 1, 2)
  select site, cast(rank as int) as rank, path, link, priority from (select *, row_number() over (partition by site order by priority desc, o) as rank from b) where rank <= 4""",
)
def _(t):
    return ext.rank_links(ext.page_links(t.pages), 4)


@query(
    "ext_20_audit_pages_pick",
    f"""with {_LINKS} select page_id, link, cast(rank as int) as rank from (select page_id, link, row_number() over (partition by page_id order by length(link), link) as rank from links
  where {_INTERNAL} and regexp_matches(link, 'the|and|about|service')) where rank <= 2""",
)
def _(t):
    return ext.audit_pages_pick(ext.page_links(t.pages), 2, "the|and|about|service")


@query("ext_20_about_links", f"with {_LINKS.replace('from pages', 'from ' + SNIPPED)} select page_id, link, cast(rank as int) as rank from (select page_id, link, row_number() over (partition by page_id order by length(link), link) as rank from links where {_INTERNAL} and regexp_matches(link, 'about|service|solution|practice-areas')) where rank <= 2")
def _(t):
    return ext.audit_pages_pick(ext.page_links(_snipped(t)))


#: Blocks and footers appended to the given pages by page_id, each with what the rules make of it.
PEOPLE = (
    (
        """<section class="our-team"><div class="team-member"><img src="a.png"><h3>Anita Sharma</h3><p>Managing Director</p>"""
        """<a href="https://www.linkedin.com/in/anita">in</a><a href="mailto:anita@acme.in">mail</a></div><div class="team-member"><h3>Rahul Verma</h3></div></section>""",
        (("Anita Sharma", "Managing Director", "TEAM_SECTION", 150, None), ("Rahul Verma", None, "TEAM_SECTION", 65, None), ("Anita", "", "LINKEDIN_PROFILE", 20, "LOW_SCORE")),
    ),
    ("""<div class="leadership"><div class="director-box"><h4>Cloud Platform</h4><p>Chief Officer</p></div></div>""", (("Cloud Platform", "Chief Officer", "LEADERSHIP_SECTION", -100, "PRODUCT_NAME"),)),
    ("""<div class="services team"><h3>Anita Sharma</h3><p>Managing Director</p></div>""", (("Anita Sharma", "Managing Director", "FALLBACK_RELATIONSHIP_SCAN", 40, None),)),
    ("", ()),
)
FEET = (
    (
        """<footer><a href="mailto:info%40acme.in?subject=x">m</a><a href="tel:+91 2012345678">t</a><a href="https://wa.me/91">w</a><a href="/contact#map">c</a>"""
        """<address>12 Long Road, Pune</address><a href="https://www.linkedin.com/company/acme">l</a></footer><a href="https://www.facebook.com/sharer?u=1">s</a>""",
        (("EMAIL", "info@acme.in"), ("PHONE", "+91 2012345678"), ("WHATSAPP", "https://wa.me/91"), ("CONTACT_PAGE", "/contact"), ("ADDRESS", "12 Long Road, Pune"), ("LinkedIn", "https://www.linkedin.com/company/acme")),
    ),
    ("""<div class="site-footer"><a href="/get-in-touch">g</a><address>short</address></div><a href="mailto:outside@acme.in">o</a><a href="https://x.com/acme">x</a>""", (("CONTACT_PAGE", "/get-in-touch"), ("Twitter", "https://x.com/acme"))),
    ("", ()),
)


def _planted(t, kinds):
    """The given pages, each with one of the planted pieces of markup appended."""
    piece = F.get(F.array(*[F.lit(html) for html, _ in kinds]), (F.col("page_id") % len(kinds)).cast("int"))
    return t.pages.withColumn("html", F.concat("html", piece))


def _planted_sql(kinds, columns: str) -> str:
    """What the planted pieces give, for every page that got them."""
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(lit, row))})" for k, (_, found) in enumerate(kinds) for row in found)
    return f"select page_id, {columns} from pages join (values {rows}) v(k, {columns}) on page_id % {len(kinds)} = k"


@query("ext_10_person_candidates", _planted_sql(PEOPLE, "name, title, section_type, score, reject_reason"))
def _(t):
    return ext.person_candidates(page_nodes(_planted(t, PEOPLE))).select("page_id", "name", "title", "section_type", "score", "reject_reason")


@query("ext_11_footer_contacts", _planted_sql(FEET, "kind, value"))
def _(t):
    return ext.footer_contacts(page_nodes(_planted(t, FEET))).select("page_id", "kind", "value")


@query(
    "ext_17_dedup_lines",
    r"""
with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20) as ls from documents),
d as (select doc_id, trim(regexp_replace(array_to_string(list_transform(list_filter(list_zip(ls, range(1, len(ls) + 1)), lambda z: list_position(ls, z[1]) = z[2]), lambda z: z[1]), ' '), '\s+', ' ', 'g')) as c from l)
select doc_id, md5(coalesce(c, '')) as text_hash, length(coalesce(c, '')) < 300 or len(string_split(coalesce(c, ''), ' ')) < 50 as low_quality from d
""",
)
def _(t):
    return ext.dedup_lines(t.documents).select("doc_id", F.md5("clean_text").alias("text_hash"), "low_quality")


@query(
    "agg_18_site_documents",
    rf"""
with x as (select page_id, {sql_host("url")} as site, trim(regexp_replace(regexp_replace(html, $$(?s)<[^>]*>$$, ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages)
select site, count(*) as pages, cast(sum(case when text = '' then 0 else len(string_split(text, ' ')) end) as bigint) as words, string_agg(text, ' ' order by page_id) as raw_text
from x group by site
""",
)
def _(t):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return ext.site_documents(t.pages.select("page_id", "url", text.alias("text")))


def _documents(t):
    """Site documents of all crawled pages: the first title and hero that there is, all distinct titles and headings in page order.

    Each distinct text of a site is one row until the last step, whatever the number of pages it is on. Signals, footer, industry
    and business model are what other jobs give; here they are constants.
    """
    meta = ext.page_meta(t.pages)
    m = meta.select(ext.site_of().alias("site"), "page_id", "url", "title", F.col("h1").alias("hero"), "description", "headings")
    filled = lambda c: F.min_by(c, F.when(F.length(c) > 0, F.col("page_id"))).alias(c)
    first = m.groupBy("site").agg(F.min_by("url", "page_id").alias("url"), filled("title"), filled("hero"), filled("description"))

    def in_order(rows, text: str, place):
        once = rows.groupBy("site", text).agg(F.min(place).alias("place"))
        listed = F.array_sort(F.collect_list(F.struct("place", text)))
        return once.groupBy("site").agg(F.transform(listed, lambda x: x[text]).alias(f"{text}s"))

    titles = in_order(m.filter("title <> ''"), "title", F.col("page_id"))
    headings = in_order(m.select("site", "page_id", F.posexplode("headings").alias("pos", "heading")), "heading", F.struct("page_id", "pos"))
    tech = ext.detect_technology(t.pages).groupBy("site").agg(F.array_sort(F.collect_set("technology")).alias("technology"))
    d = first.join(titles, "site", "left").join(headings, "site", "left").join(tech, "site", "left")
    listed = F.coalesce("headings", F.array().cast("array<string>"))
    return d.select(
        "site", "url", "title", "description", "hero", F.array_join("titles", ". ").alias("about"), listed.alias("services"), listed.alias("products"),
        "technology", F.array(F.lit("WhatsApp"), F.lit("Book Demo")).alias("business_signals"), F.lit("contact form").alias("footer"),
        F.lit("Healthcare").alias("industry"), F.lit("Unknown").alias("business_model"),
    )


# the same documents in SQL
_DOCS = f"""
pg as (select page_id, {sql_host("url")} as site, url, {sql_first(TITLE)} as title, {sql_first(H1)} as hero,
   list_filter(list_transform(regexp_extract_all(html, $$(?is)<h[123][^>]*>(.*?)</h[123]>$$, 1), lambda h: {sql_strip("h")}), lambda h: length(h) between 4 and 149) as hs from pages),
hd as (select site, h, min(page_id * 100000 + i) as o from (select site, page_id, unnest(hs) as h, generate_subscripts(hs, 1) as i from pg) group by site, h),
hl as (select site, list(h order by o) as hs from hd group by site),
tl as (select site, string_agg(title, '. ' order by o) as about from (select site, title, min(page_id) as o from pg where title <> '' group by 1, 2) group by site),
tc as (select {sql_host("url")} as site, {", ".join(f"bool_or({sql_any('lower(html)', words)}) as t{i}" for i, words in enumerate(rules.TECH_SIGNATURES.values()))} from pages group by 1),
fp as (select site, arg_min(url, page_id) as url, arg_min(title, page_id) filter (where title <> '') as title, arg_min(hero, page_id) filter (where hero <> '') as hero from pg group by site),
docs as (select fp.*, about, coalesce(hs, []) as hs, tc.* exclude (site) from fp left join hl using (site) left join tl using (site) join tc using (site))
"""


def _uses(*names: str) -> str:
    known = list(rules.TECH_SIGNATURES)
    return "(" + " or ".join([f"t{known.index(n)}" for n in names if n in known] or ["false"]) + ")"


@query(
    "prj_12_profile_text",
    f"""with {_DOCS} select site, trim(concat_ws('. ', title, hero, about, case when len(hs) > 0 then array_to_string(hs, '. ') end)) as classification_text,
  concat_ws('. ', title, hero, about, 'Industry: Healthcare') as profile_text,
  concat_ws('. ', case when len(hs) > 0 then array_to_string(hs, '. ') end, case when len(hs) > 0 then array_to_string(hs, '. ') end) as services_text from docs""",
)
def _(t):
    return prj.profile_text(_documents(t))


_SIZE_TEXT = "lower(concat_ws(' ', about, hero, array_to_string(hs, ' ')))"


@query(
    "ext_16_company_profile",
    f"""with {_DOCS} select site, case {" ".join(f"when {sql_any(_SIZE_TEXT, words)} then '{tier}'" for tier, _, words in rules.SIZE_TIERS)} when {_uses("HubSpot", "Salesforce")} then 'Mid-Market'
  when {_uses("Shopify", "WooCommerce", "WordPress")} then 'Small Business' else 'Unknown' end as company_size,
  case when length(about) > 30 then about when hero <> '' then hero else '' end as description,
  case when regexp_matches(lower(concat_ws(' ', about, hero)), 'enterprise|corporate') then 'Enterprise clients' when regexp_matches(lower(concat_ws(' ', about, hero)), 'small business|smb') then 'Small and medium businesses'
   when regexp_matches(lower(concat_ws(' ', about, hero)), 'student|learner') then 'Students and learners' when regexp_matches(lower(concat_ws(' ', about, hero)), 'patient|healthcare') then 'Patients and healthcare seekers'
   else 'General consumers and businesses' end as target_audience from docs""",
)
def _(t):
    return ext.company_profile(_documents(t)).select("site", "company_size", "description", "target_audience")


@query(
    "scr_08_document_scores",
    f"""with {_DOCS}, x as (select site, 20 + case when t0 then 15 else 0 end + least(10, 2 * ({" + ".join(f"case when t{i} then 1 else 0 end" for i in range(len(rules.TECH_SIGNATURES)))})) as m,
   case when site like 'b%' then 30 else 0 end + case when len(hs) > 0 then 20 else 0 end + 20 as ft from docs)
 select site, cast(least(100, m) as int) as digital_maturity, 0 as intent_score, cast(100 - m as int) as opportunity_score, cast(ft as int) as fit_score,
  cast(least(100, greatest(0, round_even((100 - m) * 0.35::double + ft * 0.30::double, 0))) as int) as lead_score from x""",
)
def _(t):
    first = list(rules.TECH_SIGNATURES)[0]
    d = _documents(t).select(
        "site", "url", F.coalesce(F.array_contains("technology", first), F.lit(False)).alias("has_crm_integration"),
        F.coalesce(F.size("technology"), F.lit(0)).alias("technology_count"), F.col("site").startswith("b").cast("int").alias("phone_count"),
        F.size("services").alias("email_count"), "industry",
        *[F.lit(False).alias(c) for c in ("has_contact_form", "has_whatsapp_widget", "has_booking_system", "has_ecommerce")],
        F.lit(0).alias("address_count"), F.lit(0).alias("leadership_count"),
    )
    d = d.withColumn("technology_count", F.greatest("technology_count", F.lit(0)))
    return scoring.document_scores(d)


_LOW = "lower(html)"


@query(
    "scr_09_audit_pages",
    f"""
with a as (select page_id, url like 'https%' as ssl_enabled, {sql_first(TITLE)} is not null as ti, trim(regexp_extract(html, $${DESCRIPTION}$$, 1)) <> '' as de, {sql_first(H1)} is not null as h,
  regexp_matches(html, $$(?is)<link[^>]*rel=["']canonical["']$$) as ca, regexp_matches(html, $$(?is)<meta[^>]*name=["']viewport["'][^>]*content=["'][^"']*width=device-width$$) as mobile_friendly,
  regexp_matches(html, '(?i)<form[\\s>]') as has_contact_form, {sql_any(_LOW, ("wa.me", "api.whatsapp.com", "whatsapp"))} as has_whatsapp_widget, {sql_any(_LOW, ("hubspot", "salesforce", "zoho"))} as has_crm,
  {sql_any(_LOW, ("calendly", "fresha", "booking", "setmore"))} as has_booking_system, {sql_any(_LOW, ("intercom", "drift", "crisp", "tawk", "tidio"))} as has_chatbot,
  100 - case when len(regexp_extract_all(html, '(?i)<img[\\s/>]')) - len(regexp_extract_all(html, $$(?is)<img[^>]*loading=["']lazy["']$$)) > 5 then 20 else 0 end
   - case when len(regexp_extract_all(html, '(?is)<script[^>]*\\ssrc=')) > 10 then 20 else 0 end - case when len(regexp_extract_all(html, '<[a-zA-Z]')) > 1500 then 20 else 0 end as sp from pages),
b as (select *, case when ti then 30 else 0 end + case when de then 30 else 0 end + case when h then 20 else 0 end + case when ca then 20 else 0 end as seo from a)
select page_id, ssl_enabled, cast(seo as int) as seo_score, mobile_friendly, has_contact_form, has_whatsapp_widget, has_crm, has_booking_system, has_chatbot, cast(sp as int) as page_speed_estimate,
  array_to_string(list_filter([case when not ssl_enabled then 'Website does not support HTTPS/SSL securely.' end, case when not ti then 'Missing <title> tag' end, case when not de then 'Missing meta description' end,
   case when not h then 'Missing <h1> tag' end, case when not ca then 'Missing canonical link' end, case when not has_contact_form then 'No contact forms detected' end,
   case when not has_whatsapp_widget then 'No WhatsApp widget detected' end, case when not mobile_friendly then 'Missing mobile viewport meta tag' end,
   case when sp < 80 then 'Large DOM size or excessive synchronous scripts/images detected' end], lambda z: z is not null), '|') as issues,
  'The website scored ' || seo || '/100 for SEO. ' || case when ssl_enabled then '' else 'It lacks a valid SSL certificate. ' end || case when mobile_friendly then 'It appears to be mobile-friendly. '
   else 'It lacks mobile responsiveness tags. ' end || case when has_contact_form or has_whatsapp_widget then 'It has lead conversion elements in place.' else 'It lacks strong lead conversion widgets.' end as summary
from b
""",
)
def _(t):
    a = ext.audit_pages(t.pages)
    return a.select(
        "page_id", "ssl_enabled", "seo_score", "mobile_friendly", "has_contact_form", "has_whatsapp_widget", "has_crm", "has_booking_system", "has_chatbot",
        "page_speed_estimate", F.array_join(F.transform("issues", lambda i: i["message"]), "|").alias("issues"), "summary",
    )


@query(
    "scr_10_quick_audit",
    f"""with {_DOCS}, q as (select site, url like 'https://%' as ssl_enabled, coalesce(length(title) > 5, false) as ti, coalesce(length(hero) > 3, false) as h, coalesce(length(about) > 100, false) as ab, len(hs) > 0 as sv,
   {_uses("React", "Next.js", "Angular", "Shopify")} as mobile_friendly, {_uses("HubSpot")} as has_crm, {_uses("Google Analytics", "Meta Pixel")} as has_analytics from docs)
 select site, ssl_enabled, cast(least(100, case when ti then 30 else 0 end + case when h then 25 else 0 end + case when ab then 10 else 0 end + case when sv then 10 else 0 end) as int) as seo_score, mobile_friendly,
  true as has_whatsapp_widget, true as has_contact_form, true as has_booking_system, has_crm, has_analytics,
  array_to_string(list_filter([case when not ssl_enabled then 'security' end, case when not ti then 'seo' end, 'seo', case when not h then 'seo' end, case when not mobile_friendly then 'performance' end,
   case when not has_analytics then 'performance' end, case when not has_crm then 'conversion' end], lambda z: z is not null), ',') as issue_types from q""",
)
def _(t):
    q = ext.quick_audit(_documents(t))
    return q.select(
        "site", "ssl_enabled", "seo_score", "mobile_friendly", "has_whatsapp_widget", "has_contact_form", "has_booking_system", "has_crm", "has_analytics",
        F.array_join(F.transform("issues", lambda i: i["type"]), ",").alias("issue_types"),
    )


# ---- model output -------------------------------------------------------------------------------


@query(
    "ext_12_profiles_from_serp",
    """
with r as (select c.contact_id as row_id, trim(replace(c.first_name || ' ' || c.last_name || ' - ' || coalesce(c.title, '') || ' - ' || k.name || ' | LinkedIn', '| LinkedIn', '')) as t, lower(k.name) as co, c.linkedin_url
   from contacts c join companies k using (company_id) where c.linkedin_url is not null),
p as (select *, list_transform(string_split(t, '-'), lambda x: trim(x)) as parts from r),
f as (select *, list_filter(parts, lambda x: not (contains(lower(x), co) or contains(co, lower(x)))) as fp from p),
j as (select *, list_filter(fp, lambda x: regexp_matches(lower(x), 'ceo|founder|director|manager|president|vp|head|doctor|psychiatrist|psychologist|consultant|principal|owner|partner|chief'))[1] as job from f),
n as (select *, list_filter(list_filter(fp, lambda x: job is null or x <> job), lambda x: len(string_split_regex(x, '\\s+')) <= 4)[1] as nm from j)
select row_id, coalesce(nullif(nm, ''), parts[1]) as full_name, coalesce(job, '') as job_title, cast(case when job is not null then 90 else 60 end as int) as confidence from n
""",
)
def _(t):
    rows = t.contacts.filter("linkedin_url is not null").join(t.companies.select("company_id", F.col("name").alias("company_name")), "company_id").select(
        F.col("contact_id").alias("row_id"), "company_name", F.col("linkedin_url").alias("url"), F.lit("").alias("snippet"),
        F.concat("first_name", F.lit(" "), "last_name", F.lit(" - "), F.coalesce("title", F.lit("")), F.lit(" - "), "company_name", F.lit(" | LinkedIn")).alias("title"),
    )
    return ext.profiles_from_serp(rows).select("row_id", "full_name", "job_title", "confidence")


# token rows derived from the first words of every document: capitalised words begin or go on a span
_TOKENS = """(select doc_id, i as pos, case when (doc_id + i) % 11 = 0 then '##' || lower(w) else w end as word,
  case when (doc_id + i) % 3 = 0 then 'B-PER' when (doc_id + i) % 3 = 1 then 'I-PER' when (doc_id + i) % 7 = 2 then 'I-PER' else 'O' end as label, 0.6::double + (doc_id * 7 + i) % 40 / 100.0::double as score
  from (select doc_id, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 as i from documents))"""


def _tokens(t):
    # whole texts are dealt by document, so the many rows of their words need not be sent again to be ordered
    w = t.documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "w"))
    n = F.col("doc_id") + F.col("pos")
    label = F.when(n % 3 == 0, "B-PER").when(n % 3 == 1, "I-PER").when(n % 7 == 2, "I-PER").otherwise("O")
    return w.select(
        "doc_id", "pos", F.when(n % 11 == 0, F.concat(F.lit("##"), F.lower("w"))).otherwise(F.col("w")).alias("word"), label.alias("label"),
        (F.lit(0.6) + (F.col("doc_id") * 7 + F.col("pos")) % 40 / F.lit(100.0)).alias("score"),
    )


_SPANS = f"""
k as (select *, sum(case when label = 'B-PER' or label = 'O' then 1 else 0 end) over (partition by doc_id order by pos) as span from {_TOKENS}),
g as (select doc_id, span, min(pos) as start, bool_or(label = 'B-PER') as begun, avg(score) as score,
   string_agg(case when word like '##%' then substr(word, 3) else ' ' || word end, '' order by pos) as nm from k where label <> 'O' group by 1, 2),
spans as (select doc_id, start, trim(nm) as name, score from g where begun and score > 0.7 and len(string_split(trim(nm), ' ')) >= 2)"""


@query("ext_13_merge_entities", f"with {_SPANS} select doc_id, cast(start as int) as start, name, round(score, 6) as score from spans")
def _(t):
    return ext.merge_entities(_tokens(t)).select("doc_id", "start", "name", F.round("score", 6).alias("score"))


@query("ext_14_persons_to_contacts")
def _(t):
    return ext.persons_to_contacts(ext.merge_entities(_tokens(t)), t.documents)


@query(
    "ext_15_pick_labels",
    """with r as (select doc_id, label, cast(floor(floor(score * 100 + 0.5) / 100 * 100 + 0.5) as int) as pct, row_number() over (partition by doc_id order by score desc, label) as rn from classifier_scores)
  select doc_id, max(label) filter (where rn = 1) as top_label, max(pct) filter (where rn = 1) as top_pct, max(label) filter (where rn = 2) as second_label, max(pct) filter (where rn = 2) as second_pct from r group by 1""",
)
def _(t):
    return ext.pick_labels(t.classifier_scores)


@query("udf_02_embed_text")
def _(t):
    return t.documents.select("doc_id", F.size(score_text("text")).alias("dims"))


# ---- vectors ------------------------------------------------------------------------------------


def _vectors(t):
    return t.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(
    "sim_01_pair_cosine",
    """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def _(t):
    v = _vectors(t)
    pairs = v.select(F.col("id").alias("a"), F.col("vec").alias("a_vec"), (F.col("id") + 1).alias("b")).join(
        v.select(F.col("id").alias("b"), F.col("vec").alias("b_vec")), "b"
    )
    return vectors.pair_cosine(pairs).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "sim_02_similar_companies",
    """with p as (select a.vec_id as query_id, b.vec_id as match_id, floor(list_cosine_similarity(a.embedding::double[], b.embedding::double[]) * 1000 + 0.5) / 1000 as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id)
  select query_id, match_id, similarity, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by similarity desc, match_id) as rank from p) where rank <= 5""",
)
def _(t):
    return vectors.similar_companies(_vectors(t), 5)


@query(
    "sim_03_semantic_search",
    """with p as (select a.vec_id as query_id, b.vec_id as match_id, floor(list_cosine_similarity(a.embedding::double[], b.embedding::double[]) * 1000 + 0.5) / 1000 as similarity from embeddings a, embeddings b where a.label = 3)
  select query_id, match_id, similarity, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by similarity desc, match_id) as rank from p) where rank <= 10""",
)
def _(t):
    q = t.vectors.filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.semantic_search(q, _vectors(t), 10)


@query(
    "ent_14_vector_duplicates",
    """with e as (select vec_id, embedding::double[] as embedding from embeddings union all
    select vec_id + 1000000, list_transform(embedding, lambda x: 2 * x::double) from embeddings where vec_id % 5 = 0)
  select a.vec_id as id, min(b.vec_id) as duplicate_of from e a join e b on b.vec_id < a.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.92 group by 1""",
)
def _(t):
    own = _vectors(t)  # every fifth vector comes again at twice its length
    again = own.filter("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), F.transform("vec", lambda x: x + x).alias("vec"))
    return vectors.vector_duplicates(own.unionByName(again))
