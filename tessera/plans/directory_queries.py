"""Queries over landed directory and registry pages: pages are rendered from the tables, landed by source and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import extraction as ext
from tessera.plans.catalog import query
from tessera.session import checkpoint_dir
from tessera.sources.pages import page_nodes, read_landed_pages

#: Cards on one directory page.
CARDS = 25
#: A card of each directory in its own markup; {…} are a company's values, absent ones leave no element.
CARD_MARKUP = {
    "asklaila": ("<div class='search-result'><h2>{name}</h2>", "<label class='ph'>{phone}</label>", "<div class='address'>{address}</div>", "<a href='{site}'>site</a>"),
    "yellowpages": ("<div class='eachPopular'><a class='eachPopularTitle' href='/d'>{name}</a>", "<a class='businessContact' href='tel:{phone}'>Call</a>", "<address class='businessArea'>{address}</address>", "<a href='{site}'>site</a>"),
    "hotfrog": ("<div class='listing-card'><h3 class='listing-title'><b>{name}</b></h3>", "<a href='tel:{phone}'>Call</a>", "<p>{address}</p>", "<a href='{site}'>site</a>"),
    "grotal": ("<div class='listingBox'><div class='company-name'>{name}</div>", "<p>{phone}</p>", "<div class='address'>{address}</div>", "<a href='{site}'>site</a>"),
    "tradeindia": ("<div class='company-card'><h2>{name}</h2>", "<p>{phone}</p>", "<div class='city'>{address}</div>", "<a href='{site}'>site</a>"),
    "indiamart_rss": ("<div class='Dealer-box'><h3 class='Company'>{name}</h3>", "<span>{phone}</span>", "<span class='Address'>{address}</span>", "<a href='{site}'>site</a>"),
}
_SOURCES = list(CARD_MARKUP)


def _filled(template: str, name: str, value: Column) -> Column:
    before, after = template.split("{" + name + "}")
    return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _landed(pages: DataFrame, name: str) -> DataFrame:
    """Pages (source, page) landed as lines of text files in one folder per source, and read back."""
    path = f"{checkpoint_dir(pages.sparkSession)}/{name}-{uuid.uuid4().hex}"
    pages.select("source", F.col("page").alias("value")).write.partitionBy("source").text(path)
    return read_landed_pages(pages.sparkSession, path)


def _directory_pages(t) -> DataFrame:
    c = t.companies.withColumn("source", F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("company_id") % len(_SOURCES) + 1).cast("int")))
    card = None
    for source, (head, phone, address, site) in CARD_MARKUP.items():
        made = F.concat(
            _filled(head, "name", _escaped(F.col("name"))), _filled(phone, "phone", F.col("phone")),
            _filled(address, "address", F.concat_ws(", ", _escaped(F.col("city")), F.col("postal_code"))), _filled(site, "site", _escaped(F.col("website_url"))), F.lit("</div>"),
        )
        card = F.when(F.col("source") == source, made) if card is None else card.when(F.col("source") == source, made)
    number = F.floor(F.col("company_id") / (len(_SOURCES) * CARDS))
    # a page holds CARDS cards at most, so its list is bounded
    pages = c.groupBy("source", number.alias("number")).agg(F.array_sort(F.collect_list(F.struct("company_id", card.alias("card")))).alias("cards"))
    body = F.array_join(F.transform("cards", lambda x: x["card"]), "")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/page/"), F.col("number").cast("string"))
    html = F.concat(F.lit("<html><head><link rel='canonical' href='"), url, F.lit("'></head><body><div class='top'>All listings</div>"), body, F.lit("<script>var card = '<div>';</script></body></html>"))
    return pages.select("source", html.alias("page"))


@query(
    "ext_18_listing_cards",
    """with c as (select *, company_id % 6 as d from companies)
  select ['asklaila', 'yellowpages', 'hotfrog', 'grotal', 'tradeindia', 'indiamart_rss'][d + 1] as source, name as raw_name, phone as raw_phone,
   case when d <> 2 then city || ', ' || postal_code end as raw_address, case when d < 2 then website_url end as raw_website from c""",
)
def _(t):
    nodes = page_nodes(_landed(_directory_pages(t), "directories"), keep=("source",))
    return ext.listing_cards(nodes).select("source", "raw_name", "raw_phone", "raw_address", "raw_website")


def _registry_pages(t) -> DataFrame:
    people = t.contacts.filter("first_name is not null and last_name is not null")
    # a registry page lists the directors of one company
    directors = people.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("contact_id", F.concat_ws(" ", "first_name", "last_name").alias("name")))).alias("people"))
    c = t.companies.join(directors, "company_id", "left")
    rows = F.transform(F.coalesce("people", F.array()), lambda p: F.concat(F.lit("<tr><td>"), p["contact_id"].cast("string"), F.lit("</td><td><a href='#'>"), p["name"], F.lit("</a></td></tr>")))
    url = F.concat(F.lit("https://registry.example/company/"), F.col("company_id").cast("string"))
    html = F.concat(
        F.lit("<html><head><link rel='canonical' href='"), url, F.lit("'></head><body><h1>"), _escaped(F.col("name")), F.lit("</h1><table><tr><td>Email ID:</td><td>"),
        F.coalesce("email", F.lit("")), F.lit("</td></tr><tr><td>Registered Address</td><td><b>"), F.concat_ws(", ", "city", "postal_code"),
        F.lit("</b></td></tr></table><table class='table table-striped'><tr><td>DIN</td><td>Name</td></tr>"), F.array_join(rows, ""), F.lit("</table></body></html>"),
    )
    return c.select(F.lit("registry").alias("source"), html.alias("page"))


@query(
    "ext_19_registry_details",
    """with p as (select company_id, string_agg(first_name || ' ' || last_name, '|' order by contact_id) as directors from contacts where first_name is not null and last_name is not null group by 1)
  select 'https://registry.example/company/' || company_id as url, nullif(email, '') as email, city || ', ' || postal_code as address, coalesce(directors, '') as directors
  from companies left join p using (company_id)""",
)
def _(t):
    rows = ext.registry_details(_landed(_registry_pages(t), "registry"))
    return rows.select("url", "email", "address", F.array_join("directors", "|").alias("directors"))
