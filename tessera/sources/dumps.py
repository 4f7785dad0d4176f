"""Landed source dumps as discovery records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.keys import clean_title, host_key, present
from tessera.operators.filters import exclude_hosts, word_table
from tessera.operators.skew import best_per

RAW_SCHEMA = (
    "source string, business_name string, phone string, email string, website string, address string, rating string, "
    "category string, gstin string, cin string, platform string, profile_url string, quality_score int, _corrupt_record string"
)
KNOWN_FIELDS = tuple(f.split()[0] for f in RAW_SCHEMA.split(", ") if not f.startswith("_"))


def load_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files of any source as (records, rejected lines)."""
    return parse_raw(spark.read.text(path))


def parse_raw(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines in the column ``value`` as (records, rejected lines).

    All sources share one schema; keys outside it are kept in the variant column ``extra``.
    """
    parsed = lines.withColumn("whole", F.try_parse_json("value")).withColumn("r", F.from_json("value", RAW_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("whole").isNull() | F.col("r._corrupt_record").isNotNull()
    everything = F.from_json("value", "map<string,string>")
    extra = F.map_filter(everything, lambda k, v: ~k.isin(*KNOWN_FIELDS))
    good = parsed.filter(~bad).select(
        "r.source",
        F.col("r.business_name").alias("raw_name"),
        F.col("r.phone").alias("raw_phone"),
        F.col("r.email").alias("raw_email"),
        F.col("r.website").alias("raw_website"),
        F.col("r.address").alias("raw_address"),
        F.col("r.rating").alias("raw_rating"),
        *[f"r.{c}" for c in ("category", "gstin", "cin", "platform", "profile_url", "quality_score")],
        F.parse_json(F.to_json(extra)).alias("extra"),
    )
    return good, parsed.filter(bad).select(F.col("value").alias("line"))


# Address tags of a map element, in writing order.
ADDRESS_TAGS = ("addr:housenumber", "addr:street", "addr:suburb", "addr:city", "addr:state", "addr:postcode")


def osm_records(elements: DataFrame) -> DataFrame:
    """Map elements (id, type, tags map) as records; elements without a name are left out."""

    def tag(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("tags", F.lit(n)), F.lit("")) for n in names])

    address = F.nullif(F.array_join(F.array_compact(F.array(*[tag(n) for n in ADDRESS_TAGS])), ", "), F.lit(""))
    rows = elements.select(
        F.col("id").alias("osm_id"),
        F.col("type").alias("osm_type"),
        tag("name", "name:en").alias("raw_name"),
        F.lit("overpass").alias("source"),
        tag("phone", "contact:phone").alias("raw_phone"),
        tag("website", "contact:website").alias("raw_website"),
        tag("email", "contact:email").alias("raw_email"),
        address.alias("raw_address"),
        tag("opening_hours").alias("opening_hours"),
    )
    return rows.filter("raw_name is not null")


def sitemap_records(urls: DataFrame, aliases: list[str], keyword: str) -> DataFrame:
    """Sitemap URLs that mention a city alias or the keyword, as records named after their last path part."""
    url = F.lower("loc")
    hit = F.lit(False)
    for word in [*aliases, keyword.lower()]:
        hit = hit | url.contains(word)
    slug = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    slug = F.regexp_replace(F.regexp_replace(slug, "-contact-address$", ""), "-[0-9]+$", "")
    for alias in aliases:
        slug = F.replace(slug, F.lit(f"-{alias}"), F.lit(""))
    name = F.initcap(F.translate(slug, "-", " "))
    rows = urls.filter(hit).select("row_id", name.alias("raw_name"), F.col("loc").alias("listing_url"))
    return rows.filter(F.length("raw_name") >= 3).select(
        "row_id", "raw_name", F.lit("sulekha_sitemap").alias("source"), "listing_url", F.lit(15).alias("quality_score")
    )


def archive_records(index: DataFrame) -> DataFrame:
    """Web-archive index rows (original, urlkey, snapshot, status_code) as one record per host.

    Only status 200; the newest snapshot per URL key, then the newest per host.
    """
    ok = index.filter("status_code = '200'")
    per_key = best_per(ok, ["urlkey"], [F.col("snapshot"), F.col("row_id")])
    hosted = per_key.withColumn("host", host_key("original")).filter("host is not null")
    per_host = best_per(hosted, ["host"], [F.col("snapshot"), F.col("row_id")])
    name = F.initcap(F.translate(F.split_part("host", F.lit("."), F.lit(1)), "-", " "))
    return per_host.select(
        "host",
        name.alias("raw_name"),
        F.lit("wayback_machine").alias("source"),
        F.when(F.col("original").startswith("http"), F.col("original")).otherwise(F.concat(F.lit("https://"), "host")).alias("raw_website"),
        "snapshot",
        F.lit(40).alias("quality_score"),
    )


def unwrap_redirect(href: str = "href") -> Column:
    """Target of a search engine's redirect link."""
    wrapped = F.regexp_extract(href, "uddg=([^&]*)", 1)
    return F.when(wrapped != "", F.coalesce(F.try_url_decode(wrapped), wrapped)).otherwise(F.col(href))


def serp_records(results: DataFrame, excluded: tuple[str, ...] = rules.SERP_EXCLUDED_HOSTS) -> DataFrame:
    """Search results (row_id, href, title, snippet) as records, directory and public hosts left out."""
    phone = F.regexp_replace(F.regexp_extract("snippet", rules.SNIPPET_PHONE_PATTERN, 0), r"[\s-]", "")
    rows = results.select(
        "row_id",
        clean_title("title").alias("raw_name"),
        unwrap_redirect().alias("raw_website"),
        F.nullif(phone, F.lit("")).alias("raw_phone"),
        F.lit("duckduckgo").alias("source"),
    )
    kept = exclude_hosts(rows, word_table(results.sparkSession, excluded), "raw_website", "row_id")
    return kept.withColumn("quality_score", (F.lit(50) + F.when(present("raw_phone"), 20).otherwise(0)).cast("int"))


# What registry sites append to a company's name.
REGISTRY_SUFFIXES = ("- Company Details", "- Zauba Corp", "- Tofler", "- Ministry of Corporate Affairs")


def registry_records(rows: DataFrame) -> DataFrame:
    """Registry search rows (row_id, title, snippet): name, first tax id and company id, one per company id."""
    name = F.col("title")
    for suffix in REGISTRY_SUFFIXES:
        name = F.element_at(F.split(name, rf"(?i)\s+{suffix}", 2), 1)
    name = F.regexp_replace(F.regexp_replace(name, r"^[ |,-]+", ""), r"[ |,-]+$", "")
    cin = F.coalesce(
        F.nullif(F.regexp_extract("snippet", rules.CIN_PATTERN, 0), F.lit("")),
        F.nullif(F.regexp_extract("title", rules.CIN_PATTERN, 0), F.lit("")),
    )
    gstin = F.get(F.regexp_extract_all("snippet", F.lit(rules.GSTIN_PATTERN), 0), F.lit(0))
    parsed = rows.select("row_id", name.alias("raw_name"), gstin.alias("gstin"), cin.alias("cin"))
    # rows without a company id stand for themselves
    own = F.coalesce("cin", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    first = best_per(parsed.withColumn("own", own), ["own"], [F.col("row_id")], largest=False).drop("own")
    return first.withColumns(
        {"source": F.lit("mca"), "quality_score": (F.lit(15) + F.when(F.col("cin").isNotNull(), 10).otherwise(0)).cast("int")}
    )


def registry_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, number): every tax id and company id in a text column."""
    t = F.col(text)
    found = F.concat(
        F.transform(F.regexp_extract_all(t, F.lit(rules.GSTIN_PATTERN), 0), lambda x: F.struct(F.lit("gstin").alias("kind"), x.alias("number"))),
        F.transform(F.regexp_extract_all(t, F.lit(rules.CIN_PATTERN), 0), lambda x: F.struct(F.lit("cin").alias("kind"), x.alias("number"))),
    )
    return texts.select(key, F.explode(F.array_distinct(found)).alias("f")).select(key, "f.kind", "f.number")


def social_records(results: DataFrame) -> DataFrame:
    """Social search results (row_id, platform, href, title) as records with platform and profile link."""
    href = F.coalesce(unwrap_redirect(), F.lit(""))
    name = F.trim(F.element_at(F.split("title", "[|\\-–@]", 2), 1))
    tail = r"(?i)\s*(?:on facebook|on instagram|on linkedin|facebook|instagram|linkedin)\s*$"
    rows = results.select(
        "row_id", "platform", href.alias("profile_url"), F.trim(F.regexp_replace(name, tail, "")).alias("raw_name")
    )
    kept = rows.filter(F.contains(F.lower("profile_url"), F.col("platform")) & (F.length("raw_name") >= 2))
    return kept.withColumns({"source": F.lit("social_google_indexed"), "quality_score": F.lit(20)})
