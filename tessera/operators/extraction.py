"""Facts taken from pages and texts: contacts, technology, links, sections, people, listing cards."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import rules
from tessera.functions.keys import compact, digits, host_key, points, present
from tessera.operators.filters import any_word, valid_title
from tessera.operators.scoring import decision_maker_score
from tessera.operators.skew import top_n_per


def site_of(url: str = "url") -> Column:
    return host_key(url)


# ---- nodes of a page -------------------------------------------------------------------------


def under(nodes: Column, e: Column, offset: Column | int = 0) -> Column:
    """Nodes below element ``e``; ``offset`` is the place of the list's first node in its page."""
    start = e["n"] - (F.lit(offset) if isinstance(offset, int) else offset)
    return F.slice(nodes, start + 2, e["last"] - e["n"])


def text_of(nodes: Column, separator: str = " ") -> Column:
    """Text pieces of a list of nodes, joined."""
    return F.array_join(F.transform(F.filter(nodes, lambda x: x["tag"] == "#text"), lambda x: x["text"]), separator)


def is_tag(e: Column, *tags: str) -> Column:
    return e["tag"].isin(*tags)


def clean_pages(nodes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(page_id, url, text): the page's visible text with single spaces.

    The whole text by default; ``max_chars`` cuts it where a fixed budget is wanted.
    """
    visible = F.filter("nodes", lambda x: ~x["noise"])
    text = F.trim(F.regexp_replace(text_of(visible), r"\s+", " "))
    return nodes.select("page_id", "url", (F.substring(text, 1, max_chars) if max_chars else text).alias("text"))


# id/class words of the page sections.
SECTION_WORDS = {
    "about": ("about", "story", "who-we-are"),
    "services": ("services", "solutions", "features"),
    "products": ("products",),
    "leadership": ("team", "leadership", "management", "board"),
    "testimonials": ("testimonial", "review"),
    "faq": ("faq", "frequently"),
}


def page_sections(nodes: DataFrame) -> DataFrame:
    """Per page: title, hero and footer text, and the texts of six kinds of sections.

    A section is a ``section`` or ``div`` whose id holds one of the words; only where no id does,
    classes are looked at.
    """
    page = F.col("nodes")

    def section(words: Sequence[str]) -> Column:
        boxes = F.filter(page, lambda e: is_tag(e, "section", "div"))
        by_id = F.filter(boxes, lambda e: any_word(F.lower(e["id"]), words))
        by_class = F.filter(boxes, lambda e: any_word(F.lower(e["cls"]), words))
        chosen = F.when(F.size(by_id) > 0, by_id).otherwise(by_class)
        return F.transform(chosen, lambda e: text_of(under(page, e)))

    def first_text(elements: Column) -> Column:
        e = F.get(elements, F.lit(0))
        return F.when(e.isNotNull(), text_of(under(page, e)))

    h1 = F.filter(page, lambda e: is_tag(e, "h1"))
    hero = F.filter(page, lambda e: (e["tag"] != "#text") & F.lower(e["cls"]).contains("hero"))
    footer = F.filter(page, lambda e: is_tag(e, "footer"))
    footer_class = F.filter(page, lambda e: (e["tag"] != "#text") & F.lower(e["cls"]).contains("footer"))
    sections = {name: section(words) for name, words in SECTION_WORDS.items()}
    return nodes.select(
        "page_id",
        "url",
        first_text(F.filter(page, lambda e: is_tag(e, "title"))).alias("title"),
        F.coalesce(first_text(h1), first_text(hero)).alias("hero"),
        F.coalesce(first_text(footer), first_text(footer_class)).alias("footer"),
        F.array_join(sections.pop("about"), " ").alias("about"),
        *[c.alias(name) for name, c in sections.items()],
    )


# ---- facts by pattern ------------------------------------------------------------------------

# Character references resolved in titles and headings.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for code, char in ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, description, language, first h1, headings of 4-149 letters and JSON-LD blocks of every page."""

    def first(pattern: str) -> Column:
        return F.nullif(strip_tags(F.regexp_extract("html", pattern, 1)), F.lit(""))

    headings = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h[123][^>]*>(.*?)</h[123]>"), 1), strip_tags)
    return pages.select(
        "page_id",
        "url",
        first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        first(r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""").alias("description"),
        F.substring(F.regexp_extract("html", r"""(?i)<html[^>]*\slang=["']([^"']*)["']""", 1), 1, 5).alias("language"),
        first(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"),
        F.filter(headings, lambda h: F.length(h).between(4, 149)).alias("headings"),
        F.regexp_extract_all(
            "html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1
        ).alias("json_ld"),
    )


def parse_json_ld(meta: DataFrame) -> DataFrame:
    """(page_id, pos, document): JSON-LD blocks that parse, as variants."""
    return (
        meta.select("page_id", F.posexplode("json_ld").alias("pos", "block"))
        .select("page_id", "pos", F.try_parse_json("block").alias("document"))
        .filter("document is not null")
    )


def extract_contacts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, value, class, pos): e-mails and phones of every text, distinct, in first-seen order.

    E-mails are lower-cased and generic when the local part is a role mailbox; phones have seven or
    more digits; the first WhatsApp number is given without spaces.
    """
    t = F.col(text)
    emails = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(rules.EMAIL_PATTERN), 0), F.lower))
    phones = F.array_distinct(
        F.filter(
            F.transform(F.regexp_extract_all(t, F.lit(rules.PHONE_PATTERN), 0), lambda x: F.trim(x)),
            lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 7,
        )
    )
    whatsapp = F.regexp_extract_all(
        t, F.lit(r"(?i)(?:wa\.me/|whatsapp[^\S\n]*:?[^\S\n]*(?=\+?[0-9][0-9\s\-]{7,15}))(\+?[0-9][0-9\s\-]*)"), 1
    )
    numbers = F.transform(whatsapp, lambda w: F.regexp_replace(w, r"\s", ""))

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(
            values, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos"))
        )

    # one scan and one explode for all kinds
    found = F.concat(tagged("email", emails), tagged("phone", phones), tagged("whatsapp", numbers))
    rows = texts.select(key, F.explode(found).alias("c")).select(key, "c.*")
    local = F.split_part(F.col("value"), F.lit("@"), F.lit(1))
    cls = F.when(F.col("kind") == "email", F.when(local.isin(*rules.GENERIC_EMAILS), "generic").otherwise("personal"))
    return rows.select(key, "kind", "value", cls.alias("class"), "pos")


def extract_addresses(texts: DataFrame, key: str = "page_id", text: str = "text", n: int | None = None) -> DataFrame:
    """All street addresses of every text, or the first ``n``."""
    found = F.regexp_extract_all(F.col(text), F.lit(rules.ADDRESS_PATTERN), 0)
    found = found if n is None else F.slice(found, 1, n)
    return texts.select(key, F.posexplode(found).alias("pos", "address"))


def social_profiles(pages: DataFrame) -> DataFrame:
    """(page_id, network, link): the first profile link of each network on every page."""
    found = F.array(
        *[
            F.struct(F.lit(name).alias("network"), F.nullif(F.regexp_extract("html", p, 0), F.lit("")).alias("link"))
            for name, p in rules.SOCIAL_PATTERNS.items()
        ]
    )
    return pages.select("page_id", F.explode(found).alias("s")).select("page_id", "s.network", "s.link").filter("link is not null")


def _lowered(pages: DataFrame) -> DataFrame:
    """Site and lower-cased markup, computed once for all signatures."""
    return pages.select(site_of().alias("site"), F.lower("html").alias("low"))


def _signature_flags(signatures: dict[str, Sequence[str]], html: Column) -> list[tuple[str, Column]]:
    return [(name, any_word(html, [w.lower() for w in words])) for name, words in signatures.items()]


def detect_technology(pages: DataFrame, signatures: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(site, technology, confidence, pages): products whose signature occurs in a page's markup.

    One pass per page with one test per product; pages are never joined to the signature list.
    """
    flags = _signature_flags(signatures or rules.TECH_SIGNATURES, F.col("low"))
    hits = compact(*[F.when(c, F.lit(name)) for name, c in flags])
    return (
        _lowered(pages).select("site", F.explode(hits).alias("technology"))
        .groupBy("site", "technology")
        .agg(F.count(F.lit(1)).alias("pages"))
        .select("site", "technology", F.lit(85).alias("confidence"), "pages")
    )


def detect_signals(pages: DataFrame, signatures: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per site with a yes/no column per business signal."""
    flags = _signature_flags(signatures or rules.SIGNAL_SIGNATURES, F.col("low"))
    marked = _lowered(pages).select("site", *[c.alias(name) for name, c in flags])
    return marked.groupBy("site").agg(*[F.max(name).alias(name) for name, _ in flags])


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of a link on a page."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    joined = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), href))
        .otherwise(F.concat(origin, folder, F.regexp_replace(href, r"^(?:\./)+", "")))
    )
    return joined


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link, pos): internal links of every page, absolute, distinct, in page order."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href=["']([^"']*)["']"""), 1)
    cleaned = F.filter(
        F.transform(hrefs, lambda h: F.trim(decode_entities(h))), lambda h: ~h.rlike("^(?:mailto:|tel:|javascript:|#)") & (h != "")
    )
    links = F.array_distinct(F.transform(cleaned, lambda h: resolve_link(h, F.col("url"))))
    netloc = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return (
        pages.select("page_id", "url", netloc.alias("netloc"), F.posexplode(links).alias("pos", "link"))
        .filter(F.regexp_extract("link", "^https?://([^/?#]+)", 1) == F.col("netloc"))
        .select("page_id", "url", "link", "pos")
    )


def link_path(link: str = "link") -> Column:
    return F.regexp_replace(F.regexp_extract(link, r"^https?://[^/?#]+(/[^?#]*)?", 1), r"/+$", "")


def link_priority(link: str = "link") -> Column:
    """Crawl priority of a URL: 100 for a home page, else the best keyword, 10 by default."""
    lower = F.lower(link)
    scores = [F.when(lower.contains(word), value).otherwise(10) for word, value in rules.PAGE_PRIORITIES.items()]
    return F.when(link_path(link) == "", 100).otherwise(F.greatest(F.lit(10), *scores))


def rank_links(links: DataFrame, n: int = 4, by: str = "site") -> DataFrame:
    """The ``n`` most important paths of every site; equal paths count once, priorities of 20 or less are dropped."""
    scored = links.withColumns(
        {"site": site_of(), "path": link_path(), "priority": link_priority(), "order": F.struct("page_id", "pos")}
    ).filter("priority > 20")
    best = scored.groupBy(by, "path").agg(
        F.max("priority").alias("priority"), F.min("order").alias("order"), F.min_by("link", "order").alias("link")
    )
    ranked = top_n_per(best, [by], [F.desc("priority"), F.asc("order")], n, rank="rank")
    return ranked.select(by, "rank", "path", "link", "priority")


def audit_pages_pick(links: DataFrame, n: int = 2, words: str = "about|service|solution|practice-areas") -> DataFrame:
    """The ``n`` shortest links of each page whose address has one of ``words``: about, service or solution pages of the same site."""
    fit = links.filter(F.col("link").rlike(words))
    return top_n_per(
        fit.select("page_id", "link"), ["page_id"], [F.length("link").asc(), F.asc("link")], n, rank="rank"
    )


def dedup_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text with lines of 20 letters or less and repeated lines removed, and a low-content flag."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.array_join(F.array_distinct(F.filter(lines, lambda l: F.length(l) > 20)), " ")
    flat = F.trim(F.regexp_replace(kept, r"\s+", " "))
    return texts.select(
        key,
        flat.alias("clean_text"),
        ((F.length(flat) < 300) | (F.size(F.split(flat, " ")) < 50)).alias("low_quality"),
    )


def site_contacts(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, kind, value, class, first_page): distinct contacts of a site with the page they were first seen on.

    One row per value rather than one list per site, so a very large site stays spread out.
    """
    where = pages.select("page_id", site_of().alias("site"))
    return contacts.join(where, "page_id").groupBy("site", "kind", "value").agg(
        F.min_by("class", F.struct("page_id", "pos")).alias("class"), F.min("page_id").alias("first_page")
    )


def site_documents(page_texts: DataFrame, max_chars: int | None = None, salts: int = 32) -> DataFrame:
    """One row per site: page count, word count, and its pages' whole text in page order, or up to a budget of ``max_chars``.

    A page can only reach a budget if the pages before it do not fill it. That is first tested
    within (site, salt), where less text comes before than in the whole site, so no needed page is
    lost and at most ``salts`` budgets of text per site are left for the final order.
    """
    t = page_texts.select(site_of().alias("site"), "page_id", "text")
    counts = t.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))).alias("words"),
    )
    if max_chars is None:
        whole = t.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "text"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
        return counts.join(whole, "site").select("site", "pages", "words", joined.alias("raw_text"))
    salted = Window.partitionBy("site", "salt").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    near = (
        t.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
        .withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(salted), F.lit(0)))
        .filter(F.col("before") < max_chars)
    )
    ordered = near.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return counts.join(ordered, "site").select("site", "pages", "words", F.substring(joined, 1, max_chars).alias("raw_text"))


def company_profile(
    documents: DataFrame,
    about_chars: int | None = None,
    hero_chars: int | None = None,
    max_services: int | None = None,
    max_products: int | None = None,
) -> DataFrame:
    """Size, description, audience and services of every site document; texts and lists are whole unless a budget is given."""
    empty = F.array().cast("array<string>")
    services, products = F.coalesce("services", empty), F.coalesce("products", empty)
    text = F.lower(F.concat_ws(" ", "about", "hero", F.array_join(services, " ")))
    size, staff, evidence = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    tech = F.coalesce("technology", empty)

    def uses(*names: str) -> Column:
        return F.arrays_overlap(tech, F.array(*[F.lit(n) for n in names]))

    fallbacks = (
        (uses("Salesforce", "HubSpot"), "Mid-Market", "50-499", "enterprise CRM detected"),
        (uses("Shopify", "WooCommerce"), "Small Business", "1-49", "e-commerce platform detected"),
        (uses("WordPress"), "Small Business", "1-49", "WordPress detected"),
    )
    size, staff, evidence = F.lit("Unknown"), F.lit("Unknown"), empty
    for test, s, e, why in reversed(fallbacks):
        size, staff = F.when(test, s).otherwise(size), F.when(test, e).otherwise(staff)
        evidence = F.when(test, F.array(F.lit(why))).otherwise(evidence)
    for tier, employees, words in reversed(rules.SIZE_TIERS):
        matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
        hit = F.size(matched) > 0
        size, staff = F.when(hit, tier).otherwise(size), F.when(hit, employees).otherwise(staff)
        evidence = F.when(hit, matched).otherwise(evidence)
    description = (
        F.when(F.length("description") > 30, F.col("description"))
        .when(F.length("about") > 30, F.col("about") if about_chars is None else F.substring("about", 1, about_chars))
        .when(present("hero"), F.col("hero") if hero_chars is None else F.substring("hero", 1, hero_chars))
        .otherwise("")
    )
    mood = F.lower(F.concat_ws(" ", "about", "hero"))
    audience = (
        F.when(F.col("business_model").startswith("B2B"), "Businesses and companies")
        .when(F.col("business_model").startswith("B2C"), "Individual consumers")
        .when(mood.rlike("enterprise|corporate"), "Enterprise clients")
        .when(mood.rlike("small business|smb"), "Small and medium businesses")
        .when(mood.rlike("student|learner"), "Students and learners")
        .when(mood.rlike("patient|healthcare"), "Patients and healthcare seekers")
        .otherwise("General consumers and businesses")
    )
    blocks = F.concat(
        services if max_services is None else F.slice(services, 1, max_services),
        products if max_products is None else F.slice(products, 1, max_products),
    )
    lines = F.transform(blocks, lambda b: F.trim(F.get(F.split(b, r"[\n.]"), F.lit(0))))
    listed = F.array_distinct(F.filter(lines, lambda x: F.length(x).between(4, 119)))
    return documents.select(
        "site", size.alias("company_size"), staff.alias("employees"), evidence.alias("evidence"),
        description.alias("description"), audience.alias("target_audience"), listed.alias("services_listed"),
    )


# ---- audits ------------------------------------------------------------------------------------


def _issue(missing: Column, kind: str, message: str, severity: str) -> Column:
    return F.when(missing, F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Rule-based audit of every page: SEO, widgets, speed proxy, issues, summary and social links."""
    html, low = F.col("html"), F.lower("html")

    def has(*words: str) -> Column:
        return any_word(low, words)

    def filled(pattern: str) -> Column:
        return F.coalesce(strip_tags(F.regexp_extract(html, pattern, 1)) != "", F.lit(False))

    title = filled(r"(?is)<title[^>]*>(.*?)</title>")
    description = F.trim(F.regexp_extract(html, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)) != ""
    h1 = filled(r"(?is)<h1[^>]*>(.*?)</h1>")
    canonical = html.rlike(r"""(?is)<link[^>]*rel=["']canonical["']""")
    viewport = html.rlike(r"""(?is)<meta[^>]*name=["']viewport["'][^>]*content=["'][^"']*width=device-width""")
    form = html.rlike(r"(?i)<form[\s>]")
    whatsapp = has("wa.me", "api.whatsapp.com", "whatsapp")
    images = F.regexp_count(html, F.lit(r"(?i)<img[\s/>]")) - F.regexp_count(html, F.lit(r"""(?is)<img[^>]*loading=["']lazy["']"""))
    scripts = F.regexp_count(html, F.lit(r"(?is)<script[^>]*\ssrc="))
    elements = F.regexp_count(html, F.lit(r"<[a-zA-Z]"))
    base = pages.select(
        "page_id",
        "url",
        F.col("url").startswith("https").alias("ssl_enabled"),
        title.alias("has_title"),
        description.alias("has_description"),
        h1.alias("has_h1"),
        canonical.alias("has_canonical"),
        points((title, 30), (description, 30), (h1, 20), (canonical, 20)).cast("int").alias("seo_score"),
        viewport.alias("mobile_friendly"),
        form.alias("has_contact_form"),
        whatsapp.alias("has_whatsapp_widget"),
        has("hubspot", "salesforce", "zoho").alias("has_crm"),
        has("calendly", "fresha", "booking", "setmore").alias("has_booking_system"),
        has("intercom", "drift", "crisp", "tawk", "tidio").alias("has_chatbot"),
        has("google-analytics", "gtag", "fbq").alias("has_analytics"),
        (F.lit(100) - points((images > 5, 20), (scripts > 10, 20), (elements > 1500, 20))).cast("int").alias("page_speed_estimate"),
        F.transform(
            F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href=["']([^"']*)["']"""), 1), F.lower
        ).alias("hrefs"),
    )
    issues = compact(
        _issue(~F.col("ssl_enabled"), "security", "Website does not support HTTPS/SSL securely.", "high"),
        _issue(~F.col("has_title"), "seo", "Missing <title> tag", "high"),
        _issue(~F.col("has_description"), "seo", "Missing meta description", "medium"),
        _issue(~F.col("has_h1"), "seo", "Missing <h1> tag", "medium"),
        _issue(~F.col("has_canonical"), "seo", "Missing canonical link", "low"),
        _issue(~F.col("has_contact_form"), "conversion", "No contact forms detected", "medium"),
        _issue(~F.col("has_whatsapp_widget"), "conversion", "No WhatsApp widget detected", "low"),
        _issue(~F.col("mobile_friendly"), "performance", "Missing mobile viewport meta tag", "high"),
        _issue(
            F.col("page_speed_estimate") < 80, "performance", "Large DOM size or excessive synchronous scripts/images detected", "medium"
        ),
    )
    widgets = F.col("has_contact_form") | F.col("has_whatsapp_widget")
    summary = F.concat(
        F.lit("The website scored "), F.col("seo_score").cast("string"), F.lit("/100 for SEO. "),
        F.when(F.col("ssl_enabled"), "").otherwise("It lacks a valid SSL certificate. "),
        F.when(F.col("mobile_friendly"), "It appears to be mobile-friendly. ").otherwise("It lacks mobile responsiveness tags. "),
        F.when(widgets, "It has lead conversion elements in place.").otherwise("It lacks strong lead conversion widgets."),
    )
    networks = ("linkedin.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com")

    def first_link(domain: str) -> Column:
        return F.get(F.filter("hrefs", lambda h: h.contains(domain)), F.lit(0))

    social = compact(*[first_link(d) for d in networks])
    return base.withColumns({"issues": issues, "summary": summary, "social_links": F.array_distinct(social)}).drop("hrefs")


def quick_audit(documents: DataFrame) -> DataFrame:
    """Audit from a site document: SEO 30/25/25/10/10, flags from technology and texts, issues."""
    empty = F.array().cast("array<string>")
    tech = F.coalesce("technology", empty)
    signals = F.transform(F.coalesce("business_signals", empty), F.lower)
    footer = F.lower(F.coalesce("footer", F.lit("")))
    about = F.lower(F.coalesce("about", F.lit("")))
    everything = F.concat_ws(" ", footer, about)

    def uses(*names: str) -> Column:
        return F.arrays_overlap(tech, F.array(*[F.lit(n) for n in names]))

    def signal(*words: str) -> Column:
        return F.exists(signals, lambda s: any_word(s, words))

    def longer(name: str, n: int) -> Column:
        return F.coalesce(F.length(F.trim(name)) > n, F.lit(False))

    title, description, h1 = longer("title", 5), longer("description", 10), longer("hero", 3)
    whatsapp = F.array_contains(signals, "whatsapp") | any_word(footer, ("wa.me", "whatsapp"))
    form = signal("appointment", "consultation", "book") | any_word(everything, ("contact form", "get in touch"))
    booking = uses("Calendly") | signal("book", "appointment")
    flags = documents.select(
        "site",
        F.col("url").startswith("https://").alias("ssl_enabled"),
        title.alias("has_title"),
        description.alias("has_meta_description"),
        h1.alias("has_h1"),
        F.least(
            F.lit(100),
            points(
                (title, 30), (description, 25), (h1, 25),
                (F.coalesce(F.length("about") > 100, F.lit(False)), 10),
                (F.coalesce(F.size("services"), F.lit(0)) > 0, 10),
            ),
        ).cast("int").alias("seo_score"),
        uses("React", "Next.js", "Vue", "Angular", "Shopify").alias("mobile_friendly"),
        whatsapp.alias("has_whatsapp_widget"),
        form.alias("has_contact_form"),
        booking.alias("has_booking_system"),
        (uses("Freshworks", "HubSpot", "Zoho") | any_word(everything, ("live chat", "chat with us"))).alias("has_chatbot"),
        uses("HubSpot", "Salesforce", "Zoho").alias("has_crm"),
        uses("Google Analytics", "Meta Pixel", "Hotjar").alias("has_analytics"),
        compact(
            *[
                F.when(everything.contains(f"{n}.com"), F.lit(n))
                for n in ("linkedin", "facebook", "instagram", "twitter", "youtube")
            ]
        ).alias("social_links"),
    )
    no_form = ~F.col("has_contact_form") & ~F.col("has_whatsapp_widget")
    return flags.withColumn(
        "issues",
        compact(
            _issue(~F.col("ssl_enabled"), "security", "Website does not use HTTPS/SSL.", "high"),
            _issue(~F.col("has_title"), "seo", "Missing or empty <title> tag.", "high"),
            _issue(~F.col("has_meta_description"), "seo", "Missing meta description.", "medium"),
            _issue(~F.col("has_h1"), "seo", "No clear <h1> heading detected.", "medium"),
            _issue(~F.col("mobile_friendly"), "performance", "Could not confirm mobile-friendliness from static content.", "low"),
            _issue(no_form, "conversion", "No contact form or WhatsApp widget detected.", "high"),
            _issue(~F.col("has_booking_system"), "conversion", "No booking or appointment system detected.", "medium"),
            _issue(~F.col("has_analytics"), "performance", "No analytics platform detected (Google Analytics, Meta Pixel, etc.).", "medium"),
            _issue(~F.col("has_crm"), "conversion", "No CRM integration detected (HubSpot, Salesforce, Zoho).", "low"),
        ),
    )


# ---- people ------------------------------------------------------------------------------------


def section_type(e: Column) -> Column:
    """Kind of a block by the words of its class and id; words of offers and banners come first."""
    t = F.lower(F.concat_ws(" ", e["cls"], e["id"]))
    offer = t.rlike("service|solution|feature|faq|pricing|plan|product|resource|benefit|blog|industry|case-study|hero|banner|cta")
    return (
        F.when(t.rlike("service|solution"), "SERVICE_SECTION")
        .when(t.contains("faq"), "FAQ_SECTION")
        .when(t.contains("feature"), "FEATURE_SECTION")
        .when(t.rlike("cta|banner|hero"), "CTA_SECTION")
        .when(offer, "UNKNOWN")
        .when(t.rlike("team|staff|employee|people"), "TEAM_SECTION")
        .when(t.rlike("leadership|management|founder|executive|board|director"), "LEADERSHIP_SECTION")
        .when(t.rlike("profile|author|speaker|advisor|partner|doctor|specialist|consultant"), "PROFILE_CARD")
        .when(t.rlike("testimonial|review"), "TESTIMONIAL_CARD")
        .otherwise("UNKNOWN")
    )


# Section kinds, labels and word lists that results depend on, in natural order.
PROFILE_SECTIONS = ("TEAM_SECTION", "LEADERSHIP_SECTION", "PROFILE_CARD", "AUTHOR_CARD", "TESTIMONIAL_CARD")
SECTION_LABELS = (
    "about author", "author", "about the author", "meet the team", "leadership", "management", "team member", "profile", "bio",
    "about me", "our team", "our leadership", "executive team",
)
NAME_PARTICLES = ("van", "de", "der", "von", "la", "del", "da", "di")
ROLE_WORDS = (
    "founder", "ceo", "coo", "cto", "cfo", "cmo", "director", "president", "vp", "manager", "head", "lead", "executive",
    "officer", "partner", "owner", "chairperson",
)
OCCUPATION_WORDS = (
    "engineer", "developer", "designer", "consultant", "specialist", "advisor", "psychologist", "therapist", "doctor",
    "dentist", "orthodontist", "clinician", "assistant", "coordinator", "administrator", "analyst", "strategist", "architect",
)
PREGEN_CTA = (
    "call now", "book now", "get started", "learn more", "contact us", "schedule call", "read more", "click here", "subscribe",
    "download", "sign up", "register", "get a quote", "book appointment",
)
PREGEN_MARKETING = (
    "trusted experts", "client outcomes", "web development", "paid advertising", "content creation", "braces & aligners",
    "precision over volume", "radical transparency", "why choose us", "our approach", "our process", "case studies",
    "success stories", "our origin", "how we win",
)
PREGEN_PLACEHOLDERS = (
    "business contact", "contact person", "support team", "admin team", "our team", "about us", "services", "products",
    "pricing", "solutions", "partners",
)


def looks_human(name: Column) -> Column:
    """Two to four words, at least two with letters, none in lower case except particles."""
    parts = F.split(F.trim(name), r"\s+")
    lettered = F.filter(parts, lambda p: p.rlike("[A-Za-z]"))
    cased = F.forall(lettered, lambda p: ~F.substring(p, 1, 1).rlike(r"\p{Ll}") | F.lower(p).isin(*NAME_PARTICLES))
    ok = F.length(name).between(3, 40) & F.size(parts).between(2, 4) & (F.size(lettered) >= 2) & cased
    return F.coalesce(ok, F.lit(False))


def pre_gate(name: Column, title: Column, section: Column, brand: Column, image: Column, linked: Column, mailed: Column) -> Column:
    """struct(score, reason) of a person candidate before it is kept; a reason always comes with a negative score."""
    lower = F.lower(F.trim(name))
    words = F.split(lower, r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", ""))
    banned = F.array(*[F.lit(w) for w in dict.fromkeys(rules.PRODUCT_TERMS + rules.REJECT_KEYWORDS)])
    cased = F.exists(F.split(F.trim(name), r"\s+"), lambda w: w.rlike("[a-z][A-Z]") & ~w.rlike("^(?i:mac|mc)[A-Z]"))
    product = (
        (present(brand) & F.array_contains(words, brand))
        | ((F.size(words) >= 2) & F.try_element_at(words, F.lit(-1)).isin(*rules.COUNTRY_SUFFIXES))
        | F.arrays_overlap(bare, banned)
        | cased
    )
    reason = (
        F.when(F.coalesce(product, F.lit(False)), "PRODUCT_NAME")
        .when(present(title) & ~valid_title(title), "CTA")
        .when(lower.rlike(r"^[0-9\s+\-()]+$") | lower.contains("@"), "PHONE")
        .when(any_word(lower, PREGEN_CTA), "CTA")
        .when(any_word(lower, PREGEN_MARKETING), "MARKETING")
        .when(any_word(lower, PREGEN_PLACEHOLDERS), "PLACEHOLDER")
        .when(section.isin("SERVICE_SECTION", "FAQ_SECTION", "FEATURE_SECTION", "CTA_SECTION"), "MARKETING")
    )
    score = points(
        (looks_human(name), 40),
        (present(title), 30),
        (section.isin("PROFILE_CARD", "LEADERSHIP_SECTION", "TEAM_SECTION"), 25),
        (section.isin("AUTHOR_CARD", "TESTIMONIAL_CARD"), 15),
        (linked, 20),
        (mailed, 20),
        (image, 15),
    )
    return F.struct(F.when(reason.isNull(), score).otherwise(-100).alias("score"), reason.alias("reason"))


def _hrefs(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda x: is_tag(x, "a") & x["href"].isNotNull()), lambda x: x["href"])


def _last_after(hrefs: Column, prefix: str) -> Column:
    """What follows the prefix in the last link that has it, without a query."""
    kept = F.filter(hrefs, lambda h: h.startswith(prefix))
    return F.trim(F.split_part(F.replace(F.try_element_at(kept, F.lit(-1)), F.lit(prefix), F.lit("")), F.lit("?"), F.lit(1)))


def brand_of(url: str = "url") -> Column:
    """First label of the page's host when longer than two letters."""
    label = F.split_part(host_key(url), F.lit("."), F.lit(1))
    return F.when(F.length(label) > 2, label)


def profile_blocks(nodes: DataFrame) -> DataFrame:
    """Innermost person blocks of every page with their own nodes, texts and links."""
    visible = F.filter("nodes", lambda x: is_tag(x, "div", "li", "section", "article") & ~x["noise"])
    page = F.col("nodes")
    blocks = F.transform(
        F.filter(F.transform(visible, lambda e: F.struct(e.alias("e"), section_type(e).alias("kind"))), lambda b: b["kind"].isin(*PROFILE_SECTIONS)),
        lambda b: F.struct(b["e"].alias("e"), b["kind"].alias("kind"), under(page, b["e"]).alias("sub")),
    )
    block = nodes.select("page_id", "url", F.explode(blocks).alias("b")).select("page_id", "url", "b.*")
    inner = F.exists(
        "sub", lambda x: is_tag(x, "div", "li", "section", "article") & section_type(x).isin(*PROFILE_SECTIONS)
    )
    held = F.filter("sub", lambda x: is_tag(x, "h2", "h3", "h4", "h5", "strong", "b", "p", "span", "div"))
    first = F.col("e")["n"] + 1
    texts = F.array_distinct(
        F.filter(F.transform(held, lambda x: text_of(under(F.col("sub"), x, first), "")), lambda t: t != "")
    )
    return block.select(
        "page_id", "url", F.col("e")["n"].alias("n"), F.col("kind").alias("section_type"), inner.alias("has_inner"),
        F.filter(texts, lambda t: ~F.lower(t).isin(*SECTION_LABELS)).alias("texts"),
        F.exists("sub", lambda x: is_tag(x, "img")).alias("has_image"),
        _hrefs(F.col("sub")).alias("hrefs"),
    )


def person_candidates(nodes: DataFrame, minimum: int = 50) -> DataFrame:
    """People named in profile blocks; on pages without any such block, in short text boxes; and in profile links.

    (page_id, url, name, title, section_type, has_image, has_linkedin, has_email, has_phone, linkedin,
    email, phone, score, reject_reason); rejected ones are kept with their reason.
    """
    blocks = profile_blocks(nodes)
    name = F.coalesce(
        F.get(F.filter("texts", looks_human), F.lit(0)),
        F.get(F.filter("texts", lambda t: (F.length(t) < 40) & (F.size(F.split(t, r"\s+")) <= 4)), F.lit(0)),
    )
    human = F.get(F.filter("texts", looks_human), F.lit(0))
    place = F.array_position("texts", human)
    after = F.filter(F.slice("texts", place.cast("int") + 1, F.size("texts")), lambda t: F.length(t) < 100)
    profiles = F.filter("hrefs", lambda h: h.contains("linkedin.com/in/"))
    own_link = F.when(F.size(profiles) == 1, F.get(profiles, F.lit(0)))
    found = blocks.filter("not has_inner").select(
        "page_id", "url", "n", "section_type", "has_image",
        name.alias("name"),
        F.when(human.isNotNull() & (place > 0), F.get(after, F.lit(0))).alias("title"),
        own_link.alias("linkedin"),
        _last_after(F.col("hrefs"), "mailto:").alias("email"),
        F.trim(F.replace(F.try_element_at(F.filter("hrefs", lambda h: h.startswith("tel:")), F.lit(-1)), F.lit("tel:"), F.lit(""))).alias("phone"),
    ).filter("name is not null")
    firsts = found.groupBy("page_id", F.lower("name").alias("key")).agg(F.min("n").alias("n"))
    found = found.withColumn("key", F.lower("name")).join(firsts, ["page_id", "key", "n"], "left_semi").drop("key")
    linked, mailed = F.col("linkedin").isNotNull(), F.col("email").isNotNull()
    gate = pre_gate(F.col("name"), F.col("title"), F.col("section_type"), brand_of(), F.col("has_image"), linked, mailed)
    primary = found.withColumn("g", gate).select(
        "page_id", "url", "name", "title", "section_type", "has_image",
        linked.alias("has_linkedin"), mailed.alias("has_email"), F.col("phone").isNotNull().alias("has_phone"),
        "linkedin", "email", "phone", F.col("g.score").alias("score"),
        F.when(F.col("g.score") < minimum, F.coalesce("g.reason", F.lit("LOW_SCORE"))).alias("reject_reason"),
    )
    bare = nodes.join(blocks.select("page_id").distinct(), "page_id", "left_anti")
    return primary.unionByName(_fallback_people(bare)).unionByName(_linked_people(nodes, minimum))


def _fallback_people(nodes: DataFrame) -> DataFrame:
    """Names beside a role or occupation inside boxes of at most 300 letters."""
    page = F.col("nodes")
    boxes = F.filter("nodes", lambda x: is_tag(x, "div", "article", "section", "li") & ~x["noise"])
    cut = F.transform(boxes, lambda e: F.struct(e["n"].alias("n"), under(page, e).alias("sub")))
    box = nodes.select("page_id", "url", F.explode(cut).alias("b")).select("page_id", "url", "b.*")
    joined = text_of(F.col("sub"), "|")
    texts = F.filter(F.transform(F.split(joined, r"[|,—–\n]"), lambda x: F.trim(x)), lambda t: t != "")
    box = box.filter((joined != "") & (F.length(joined) <= 300)).select(
        "page_id", "url", "n", texts.alias("texts"), F.exists("sub", lambda x: is_tag(x, "img")).alias("has_image"), _hrefs(F.col("sub")).alias("hrefs")
    ).filter("size(texts) between 2 and 10")
    near = F.filter(
        F.array(*[F.when(F.col("i") + o >= 0, F.get("texts", (F.col("i") + o).cast("int"))) for o in (1, -1, 2, -2)]),
        lambda t: t.isNotNull() & ~any_word(F.lower(t), ("call now", "book appointment", "contact us", "learn more")),
    )
    roles = F.filter("near", lambda t: any_word(F.lower(t), ROLE_WORDS))
    jobs = F.filter("near", lambda t: any_word(F.lower(t), OCCUPATION_WORDS))
    either = F.filter("near", lambda t: any_word(F.lower(t), ROLE_WORDS + OCCUPATION_WORDS))

    def linked(prefix: str) -> Column:
        return F.get(F.filter("hrefs", lambda h: h.contains(prefix) if prefix.startswith("linkedin") else h.startswith(prefix)), F.lit(0))

    rows = box.select("*", F.posexplode("texts").alias("i", "name")).filter(looks_human(F.col("name")))
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    rows = rows.filter(~F.arrays_overlap(words, F.array(*[F.lit(w) for w in ROLE_WORDS + OCCUPATION_WORDS])))
    rows = rows.withColumn("near", near).withColumns(
        {
            "title": F.coalesce(F.get(either, F.lit(0)), F.lit("")),
            "has_role": F.size(roles) > 0,
            "has_job": F.size(jobs) > 0,
            "linkedin": linked("linkedin.com/in/"),
            "email": F.trim(F.split_part(F.replace(linked("mailto:"), F.lit("mailto:"), F.lit("")), F.lit("?"), F.lit(1))),
            "phone": F.trim(F.replace(linked("tel:"), F.lit("tel:"), F.lit(""))),
        }
    )
    no = F.lit(False)
    gate = pre_gate(F.col("name"), F.col("title"), F.lit("FALLBACK"), brand_of(), no, no, no)
    score = points(
        (F.col("has_role"), 20),
        (F.col("has_job"), 15),
        (F.col("linkedin").isNotNull(), 20),
        (F.col("has_image"), 15),
        (F.size("texts") <= 5, 20),
        (F.col("email").isNotNull(), 10),
        (F.col("phone").isNotNull(), 10),
    )
    kept = rows.withColumns({"g": gate, "score": score}).filter("g.reason is null and score >= 40")
    columns = ["url", "name", "title", "has_image", "linkedin", "email", "phone", "score"]
    first = kept.groupBy("page_id", F.lower("name").alias("key")).agg(
        F.min_by(F.struct(*columns), F.struct("n", "i")).alias("r")
    )
    return first.select("page_id", "r.*").select(
        "page_id", "url", "name", "title", F.lit("FALLBACK_RELATIONSHIP_SCAN").alias("section_type"), "has_image",
        F.col("linkedin").isNotNull().alias("has_linkedin"), F.col("email").isNotNull().alias("has_email"),
        F.col("phone").isNotNull().alias("has_phone"), "linkedin", "email", "phone", "score",
        F.lit(None).cast("string").alias("reject_reason"),
    )


def _linked_people(nodes: DataFrame, minimum: int) -> DataFrame:
    """Names inferred from personal profile links."""
    visible = F.filter("nodes", lambda x: ~x["noise"])
    links = F.array_distinct(F.filter(_hrefs(visible), lambda h: h.contains("linkedin.com/in/")))
    slug = F.split_part(F.regexp_extract("linkedin", r"^.*linkedin\.com/in/(.*)$", 1), F.lit("/"), F.lit(1))
    rows = nodes.select("page_id", "url", F.explode(links).alias("linkedin")).withColumn(
        "name", F.initcap(F.translate(slug, "-", " "))
    )
    no, none = F.lit(False), F.lit(None).cast("string")
    gate = pre_gate(F.col("name"), F.lit(""), F.lit("LINKEDIN_PROFILE"), brand_of(), no, F.lit(True), no)
    return rows.withColumn("g", gate).select(
        "page_id", "url", "name", F.lit("").alias("title"), F.lit("LINKEDIN_PROFILE").alias("section_type"), no.alias("has_image"),
        F.lit(True).alias("has_linkedin"), no.alias("has_email"), no.alias("has_phone"), "linkedin", none.alias("email"),
        none.alias("phone"), F.col("g.score").alias("score"),
        F.when(F.col("g.score") < minimum, F.coalesce("g.reason", F.lit("LOW_SCORE"))).alias("reject_reason"),
    )


def footer_contacts(nodes: DataFrame) -> DataFrame:
    """(page_id, kind, value): footer e-mails, phones, WhatsApp links, addresses and contact pages, and
    company-level social links anywhere on the page; distinct, in page order."""
    page = F.col("nodes")
    feet = F.filter(
        "nodes",
        lambda e: is_tag(e, "footer")
        | ((e["tag"] != "#text") & (e["cls"].rlike(r"(^|\s)(footer|site-footer|main-footer|page-footer)(\s|$)") | (e["id"] == "footer"))),
    )
    inside = F.flatten(F.transform(feet, lambda e: under(page, e)))

    def fact(kind: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.alias("n"))

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)

    def from_link(a: Column) -> Column:
        h, low = a["href"], F.lower(a["href"])
        return (
            F.when(h.startswith("mailto:"), fact("EMAIL", F.trim(F.split_part(decoded(F.replace(h, F.lit("mailto:"), F.lit(""))), F.lit("?"), F.lit(1))), a["n"]))
            .when(h.startswith("tel:"), fact("PHONE", F.trim(decoded(F.replace(h, F.lit("tel:"), F.lit("")))), a["n"]))
            .when(low.rlike(r"wa\.me/|api\.whatsapp\.com"), fact("WHATSAPP", h, a["n"]))
            .when(low.rlike("/contact|/get-in-touch|/reach-us"), fact("CONTACT_PAGE", F.split_part(h, F.lit("#"), F.lit(1)), a["n"]))
        )

    def social(a: Column) -> Column:
        h, low = a["href"], F.lower(a["href"])
        return (
            F.when(low.rlike(r"linkedin\.com/(?:company|school)/"), fact("LinkedIn", h, a["n"]))
            .when(low.contains("facebook.com/") & ~low.contains("sharer"), fact("Facebook", h, a["n"]))
            .when(low.contains("instagram.com/"), fact("Instagram", h, a["n"]))
            .when(low.rlike(r"twitter\.com/|x\.com/") & ~low.rlike("intent/tweet|share"), fact("Twitter", h, a["n"]))
            .when(low.rlike(r"youtube\.com/|youtu\.be/"), fact("YouTube", h, a["n"]))
        )

    anchors = F.filter(inside, lambda x: is_tag(x, "a") & x["href"].isNotNull())
    everywhere = F.filter("nodes", lambda x: is_tag(x, "a") & x["href"].isNotNull())
    addresses = F.filter(
        F.transform(
            F.filter(inside, lambda x: is_tag(x, "address")), lambda e: fact("ADDRESS", text_of(under(page, e)), e["n"])
        ),
        lambda f: F.length(f["value"]) > 10,
    )
    facts = F.array_compact(F.concat(F.transform(everywhere, social), F.transform(anchors, from_link), addresses))
    return (
        nodes.select("page_id", F.explode(facts).alias("f"))
        .filter("f.value <> ''")
        .groupBy("page_id", "f.kind", "f.value")
        .agg(F.min("f.n").alias("pos"))
    )


# Per directory, class words (regular expressions) of the card and of its parts.
CARD_RULES = (
    # source, card class, (name tag, name class)..., phone tag, phone class, address tag, address class
    ("asklaila", r"search-result|listing-info|srp", (("h2", ""), ("a", r"\bresultTitle\b")), ("label", r"ph|phone|contact"), ("div", r"\baddress\b")),
    ("yellowpages", r"\beachPopular\b", (("a", r"\beachPopularTitle\b"),), ("a", r"\bbusinessContact\b"), ("address", r"\bbusinessArea\b")),
    ("hotfrog", r"\blisting-card\b|\bbusiness-result\b", (("h3", r"\blisting-title\b"), ("a", r"\bbiz-name\b")), ("a", "tel:"), None),
    ("grotal", r"\blistingBox\b|\bcustomer-details\b", (("div", r"\bcompany-name\b"), ("h2", "")), ("span", r"\bphn_no\b"), ("div", r"\baddress\b")),
    ("tradeindia", r"product-card|company-card|listing-box", (("h2", ""), ("a", r"company|name|title")), None, ("div", r"location|address|city")),
    ("indiamart_rss", r"(?i)listing|dealer|supplier", (("h2,h3,a", r"(?i)company|name|title"),), None, ("", r"(?i)address|location|city")),
)
CARD_PHONE = r"\+91[-\s]?[0-9]{10}|[0-9]{10}"


def listing_cards(nodes: DataFrame, source: str = "source") -> DataFrame:
    """Listing cards of landed directory pages as records: name, phone, address and site per card.

    ``nodes`` carries the directory's name in ``source``; cards and their parts are found by the
    class words of that directory.
    """
    page = F.col("nodes")

    def first(sub: Column, rule) -> Column:
        if rule is None:
            return F.lit(None).cast("struct<n:int,last:int,tag:string,cls:string,id:string,href:string,text:string,noise:boolean>")
        tags, words = rule
        ok = lambda x: (x["tag"].isin(*tags.split(",")) if tags else x["tag"] != "#text") & (
            x["href"].startswith("tel:") if words == "tel:" else x["cls"].rlike(words) if words else F.lit(True)
        )
        return F.get(F.filter(sub, ok), F.lit(0))

    out = None
    for name, card_class, name_rules, phone_rule, address_rule in CARD_RULES:
        own = nodes.filter(F.col(source) == name)
        cards = F.filter(page, lambda e: is_tag(e, "div") & e["cls"].rlike(card_class))
        cut = F.transform(cards, lambda e: F.struct(e["n"].alias("n"), under(page, e).alias("sub")))
        card = own.select("page_id", source, F.explode(cut).alias("c")).select("page_id", source, "c.n", "c.sub")
        sub, offset = F.col("sub"), F.col("n") + 1

        def words(e: Column, sep: str = "") -> Column:
            return F.nullif(text_of(under(sub, e, offset), sep), F.lit(""))

        title = F.coalesce(*[words(first(sub, r)) for r in name_rules])
        pieces = F.transform(F.filter(sub, lambda x: x["tag"] == "#text"), lambda x: x["text"])
        loose = F.get(F.filter(pieces, lambda t: t.rlike(CARD_PHONE)), F.lit(0))
        box = first(sub, phone_rule)
        by_href = F.nullif(F.trim(F.replace(F.when(box["href"].startswith("tel:"), box["href"]), F.lit("tel:"), F.lit(""))), F.lit(""))
        phone = F.coalesce(by_href, words(box), loose) if phone_rule is None or name == "grotal" else F.coalesce(by_href, words(box))
        site = F.get(F.filter(_hrefs(sub), lambda h: h.startswith("http") & ~h.contains(name)), F.lit(0))
        has_site = name in ("asklaila", "yellowpages")
        row = card.select(
            "page_id", F.col("n").alias("pos"), F.col(source).alias("source"), F.trim(title).alias("raw_name"), phone.alias("raw_phone"),
            words(first(sub, address_rule), " ").alias("raw_address"), (site if has_site else F.lit(None).cast("string")).alias("raw_website"),
        ).filter("raw_name is not null and raw_name <> ''")
        out = row if out is None else out.unionByName(row)
    return out


def registry_details(pages: DataFrame) -> DataFrame:
    """Registry detail pages: labelled e-mail and registered address, and the directors' names in order."""
    html = F.col("html")

    def after(label: str) -> Column:
        return F.nullif(strip_tags(F.regexp_extract(html, rf"(?is){label}.*?<(?:p|td)[^>]*>(.*?)</(?:p|td)>", 1)), F.lit(""))

    table = F.regexp_extract(html, r"""(?is)<table[^>]*class=["'][^"']*table-striped[^"']*["'][^>]*>(.*?)</table>""", 1)
    lines = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1))
    names = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: strip_tags(F.get(c, F.lit(1))))
    return pages.select(
        "page_id", "url", after("Email ID:").alias("email"), after("Registered Address").alias("address"),
        F.filter(names, lambda x: x != "").alias("directors"),
    )


# ---- people from search rows and from model output ----------------------------------------------


def profiles_from_serp(rows: DataFrame) -> DataFrame:
    """Names and titles from personal-profile search rows (title, snippet, url, company_name).

    The title is split at ``|`` or ``-``; parts that repeat the company are skipped, the first part with
    a title word is the job title, the first other one of up to four words the name.
    """
    clean = F.trim(F.replace(F.replace("title", F.lit("| LinkedIn"), F.lit("")), F.lit("- LinkedIn"), F.lit("")))
    parts = F.transform(F.when(clean.contains("|"), F.split(clean, r"\|")).otherwise(F.split(clean, "-")), lambda x: F.trim(x))
    company = F.lower("company_name")
    base = rows.filter(F.col("url").contains("linkedin.com/in")).withColumn("parts", parts)
    foreign = F.filter(
        "parts", lambda p: ~(F.contains(F.lower(p), company) | F.contains(company, F.lower(p)))
    )
    base = base.withColumn("foreign", foreign)
    titled = F.filter("foreign", lambda p: any_word(F.lower(p), rules.PROFILE_TITLES))
    job = F.get(titled, F.lit(0))
    # a second titled part may still be the name, so only the first one is set aside
    pos = F.array_position("foreign", F.coalesce(job, F.lit("\u0000")))
    others = F.filter(F.transform("foreign", lambda p, i: F.when(i + 1 != pos, p)), lambda p: p.isNotNull() & (F.size(F.split(F.trim(p), r"\s+")) <= 4))
    name = F.get(others, F.lit(0))
    base = base.withColumns({"job": job, "found_name": F.nullif(name, F.lit(""))})
    fallback_job = F.when(F.col("found_name").isNull() & F.col("job").isNull(), F.get("parts", F.lit(1)))
    base = base.withColumns(
        {"full_name": F.coalesce("found_name", F.get("parts", F.lit(0))), "job": F.coalesce("job", F.nullif(fallback_job, F.lit("")))}
    )
    guess = F.trim(F.get(F.split("snippet", r"\.\.\."), F.lit(0)))
    title = F.coalesce("job", F.when((guess != "") & (F.length(guess) < 50), guess), F.lit(""))
    link = F.regexp_extract("url", r"(https?://[a-z]{0,3}\.?linkedin\.com/in/[^/?#]+)", 1)
    return base.withColumn("job_title", title).filter("full_name <> ''").select(
        "row_id", "full_name", "job_title", F.coalesce(F.nullif(link, F.lit("")), F.col("url")).alias("linkedin_url"),
        F.when(F.col("job_title") != "", 90).otherwise(60).alias("confidence"),
    )


def merge_entities(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Person spans of token-level entity output: (key, start, name, score) with mean score over 0.7 and two words or more.

    A span starts at a B- token and goes on over directly following I- tokens; ``##`` pieces are glued on.
    """
    w = Window.partitionBy(key).orderBy("pos")
    begins = F.col("label").isin("B-PER", "B-PERSON")
    goes_on = F.col("label").isin("I-PER", "I-PERSON")
    marked = tokens.withColumns(
        {"starts": begins.cast("int"), "breaks": (~begins & ~goes_on).cast("int")}
    ).withColumns(
        {"span": F.sum(F.col("starts") + F.col("breaks")).over(w), "in_span": begins | goes_on}
    )
    pieces = marked.filter("in_span").groupBy(key, "span").agg(
        F.min("pos").alias("start"),
        F.max("starts").alias("begun"),
        F.avg("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"),
    )
    glued = F.aggregate(
        "words",
        F.lit(""),
        lambda acc, x: F.when(x["word"].startswith("##"), F.concat(acc, F.substr(x["word"], F.lit(3)))).otherwise(
            F.concat(acc, F.when(acc == "", "").otherwise(" "), x["word"])
        ),
    )
    named = pieces.filter("begun = 1").select(key, "start", F.trim(glued).alias("name"), "score")
    return named.filter((F.col("score") > 0.7) & (F.size(F.split("name", " ")) >= 2))


#: Texts whose names are looked up together; keeps a Python worker small when texts are long or have many names.
NEAR_TEXTS = 32


def _near_names(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, score, at, snippet): where each person's name first is in the lowered text (from 1; 0: nowhere), and the text around.

    ``rows`` has the key, ``text``, ``low`` and ``people``. Rows come out a few texts at a time, so neither side holds a batch whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, NEAR_TEXTS):
                part = batch.slice(start, NEAR_TEXTS)
                texts, lows = part.column("text").to_pylist(), part.column("low").to_pylist()
                people = part.column("people")
                owner = np.repeat(np.arange(part.num_rows), people.value_lengths().to_numpy())
                wanted, names, scores = (pc.struct_field(people.flatten(), c) for c in ("name_key", "name", "score"))
                at = [0 if lows[i] is None else lows[i].find(name) + 1 for i, name in zip(owner, wanted.to_pylist())]
                snippets = [texts[i][max(p - 21, 0) : p + 149] if p else None for i, p in zip(owner, at)]
                columns = [part.column(key).take(pa.array(owner)), names, scores, pa.array(at, pa.int32()), pa.array(snippets, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "name", "score", "at", "snippet"])

    person = rows.schema["people"].dataType.elementType
    schema = StructType([rows.schema[key], person["name"], person["score"]]).add("at", "integer").add("snippet", "string")
    return rows.select(key, "text", "low", "people").mapInArrow(run, schema)


def persons_to_contacts(persons: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Persons with the title near their name, a decision-maker score and a category; one per name and text.

    A text is lowered once and meets its persons as one list, so it is not copied for each of them.
    """
    firsts = persons.filter(F.length(F.trim("name")) >= 4).groupBy(key, F.lower("name").alias("name_key")).agg(
        F.min_by(F.struct("name", "score"), "start").alias("r")
    )
    listed = firsts.groupBy(key).agg(F.collect_list(F.struct("name_key", "r.name", "r.score")).alias("people"))
    once = texts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("text"))
    j = listed.join(once.withColumn("low", F.lower("text")), key)
    title = F.nullif(F.trim(F.regexp_extract("snippet", r"(?:–|-|,|\n)\s*([A-Z][a-zA-Z\s&,]{5,60}?)(?:\n|$)", 1)), F.lit(""))
    # the title is made before a generator, so it is not worked out again wherever it is used
    rows = _near_names(j, key).withColumn("title", F.explode(F.array(F.when(F.col("at") > 0, title))))
    leading = any_word(F.lower("title"), rules.LEADERSHIP_TITLES)
    score = F.when(leading, 80).when(F.col("title").isNotNull(), 50).otherwise(20)
    rows = rows.withColumn("decision_maker_score", score)
    return rows.select(
        key, "name", "title", "decision_maker_score",
        F.when(F.col("decision_maker_score") >= 70, "LEADERSHIP").otherwise("TEAM").alias("category"),
        F.floor(F.col("score") * 100 + 0.5).cast("int").alias("confidence"),
    )


def pick_labels(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Top and second label per key with whole percents of their two-decimal scores."""
    two = top_n_per(scores.select(key, "label", "score"), [key], [F.desc("score"), F.asc("label")], 2, rank="rank")
    pct = F.floor(F.floor(F.col("score") * 100 + 0.5) / 100 * 100 + 0.5).cast("int")
    two = two.withColumn("pct", pct)
    return two.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("top_label"),
        F.max(F.when(F.col("rank") == 1, F.col("pct"))).alias("top_pct"),
        F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("second_label"),
        F.max(F.when(F.col("rank") == 2, F.col("pct"))).alias("second_pct"),
    )
