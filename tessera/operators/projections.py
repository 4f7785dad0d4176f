"""Record standardising, quality scores, name and text projections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import compact, points, present

# Quality bonus by source.
SOURCE_BONUS = {
    "google_maps": 20,
    "website_search": 15,
    "duckduckgo": 10,
    "grotal": 5,
    "asklaila": 5,
    "yellowpages": 5,
    "hotfrog": 5,
}


def standard_phone(c: Column | str) -> Column:
    """Digits and ``+`` only; a leading 0 becomes +91, ten bare digits get +91 in front."""
    p = F.regexp_replace(F.trim(c), "[^0-9+]", "")
    return (
        F.when(p.startswith("0"), F.concat(F.lit("+91"), F.substring(p, 2, 100)))
        .when((F.length(p) == 10) & ~p.startswith("+"), F.concat(F.lit("+91"), p))
        .otherwise(p)
    )


def standardize(raw: DataFrame) -> DataFrame:
    """Trim every text field, lower the source, bring phones to one form; nulls become empty text."""

    def text(name: str) -> Column:
        return F.coalesce(F.trim(name), F.lit(""))

    return raw.withColumns(
        {
            "raw_name": text("raw_name"),
            "raw_website": text("raw_website"),
            "raw_phone": F.coalesce(standard_phone("raw_phone"), F.lit("")),
            "raw_address": text("raw_address"),
            "category": text("category"),
            "raw_email": text("raw_email"),
            "source": F.lower(F.trim("source")),
        }
    )


def source_bonus_table(df: DataFrame, bonus: dict[str, int] | None = None) -> DataFrame:
    """The bonus rules as a small table (source, bonus)."""
    rules = bonus or SOURCE_BONUS
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(b).alias("bonus")) for s, b in rules.items()])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.source", "r.bonus")


def quality_score(records: DataFrame, bonus: dict[str, int] | None = None) -> DataFrame:
    """Quality from filled fields plus the source bonus."""
    base = points(
        (present("raw_website"), 40),
        (present("raw_email"), 30),
        (present("raw_phone"), 25),
        (present("raw_address"), 15),
        (present("category"), 10),
    )
    rules = F.broadcast(source_bonus_table(records, bonus)).withColumnRenamed("source", "rule_source")
    joined = records.join(rules, F.lower("source") == F.col("rule_source"), "left").drop("rule_source")
    return joined.withColumn("quality_score", (base + F.coalesce("bonus", F.lit(0))).cast("int")).drop("bonus")


# Fixed values: (source, field or 'base', points); 'cap' limits the sum.
QUALITY_RULES = (
    ("google_maps", "base", 20),
    ("google_maps", "raw_website", 40),
    ("google_maps", "raw_phone", 25),
    ("google_maps", "raw_address", 10),
    ("google_maps", "raw_rating", 5),
    ("google_maps", "category", 5),
    ("google_maps", "cap", 100),
    ("overpass", "base", 20),
    ("overpass", "raw_website", 40),
    ("overpass", "raw_phone", 25),
    ("overpass", "raw_email", 10),
    ("overpass", "raw_address", 5),
    ("asklaila", "base", 10),
    ("asklaila", "raw_phone", 10),
    ("asklaila", "raw_address", 5),
    ("asklaila", "raw_website", 10),
    ("yellowpages", "base", 10),
    ("yellowpages", "raw_website", 20),
    ("yellowpages", "raw_phone", 10),
    ("justdial", "base", 5),
    ("justdial", "raw_phone", 15),
    ("wayback_machine", "base", 15),
    ("wayback_machine", "raw_website", 25),
    ("website_discovery", "base", 40),
    ("website_discovery", "raw_phone", 20),
    ("google_dorks", "base", 35),
    ("google_dorks", "raw_phone", 20),
    ("duckduckgo", "base", 10),
    ("duckduckgo", "raw_website", 40),
    ("duckduckgo", "raw_phone", 20),
    ("mca", "base", 15),
    ("mca", "cin", 10),
)


def quality_rule_table(df: DataFrame, rules=QUALITY_RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f).alias("field"), F.lit(p).alias("points")) for s, f, p in rules])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def quality_by_rules(records: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(record_id, source, rule_score) from a table of (source, field, points).

    The rules of a source are folded into one map, so each record meets one row and is never exploded. A source without
    rules scores 0; only a source with a ``cap`` rule is capped.
    """
    table = quality_rule_table(records) if rules is None else rules
    folded = table.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("field", "points"))).alias("rule"))
    fields = [r for r in ("raw_website", "raw_phone", "raw_email", "raw_address", "raw_rating", "category", "gstin", "cin") if r in records.columns]
    scored = records.join(F.broadcast(folded), "source", "left")

    def worth(name: str) -> Column:
        return F.coalesce(F.try_element_at("rule", F.lit(name)), F.lit(0))

    total = worth("base")
    for f in fields:
        total = total + F.when(present(f), worth(f)).otherwise(0)
    total = F.least(total, F.try_element_at("rule", F.lit("cap")))  # null (no cap) is passed over
    return scored.select("record_id", "source", total.cast("int").alias("rule_score"))


def split_names(contacts: DataFrame, name: str = "name") -> DataFrame:
    """First word and the rest of a display name; ``-`` where there is no rest."""
    first = F.split_part(F.col(name), F.lit(" "), F.lit(1))
    rest = F.substr(F.col(name), F.length(first) + 2)
    return contacts.withColumns(
        {
            "first_name": F.when(first != "", first).otherwise(F.col(name)),
            "last_name": F.when(rest != "", rest).otherwise(F.lit("-")),
        }
    )


# Mailboxes that name nobody.
GENERIC_MAILBOXES = ("info", "support", "hello", "contact", "admin", "sales")


def name_from_email(c: Column | str) -> Column:
    """Title-cased words of the local part; null for role mailboxes and under two letters."""
    local = F.split_part(F.col(c) if isinstance(c, str) else c, F.lit("@"), F.lit(1))
    words = F.trim(F.regexp_replace(F.translate(local, "._-", "   "), "[0-9]+", ""))
    cased = F.array_join(
        F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )
    return F.when(~F.lower(local).isin(*GENERIC_MAILBOXES) & (F.length(words) >= 2), cased)


def email_candidates(contacts: DataFrame) -> DataFrame:
    """(contact_id, rank, email): likely addresses from first name, last name and host, in order."""
    fn, ln, d = F.lower(F.trim("first_name")), F.lower(F.trim("last_name")), F.lower(F.trim("host"))
    has_last = (ln != "") & (ln != "-")
    f1, l1 = F.substring(fn, 1, 1), F.substring(ln, 1, 1)

    def at(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("@"), d)

    personal = compact(
        at(fn),
        F.when(has_last, at(fn, ".", ln)),
        F.when(has_last, at(f1, ln)),
        F.when(has_last, at(fn, l1)),
        F.when(has_last, at(fn, ln)),
        F.when(has_last, at(fn, "_", ln)),
        F.when(has_last, at(f1, ".", ln)),
        at("contact"),
        at("info"),
    )
    roles = F.array(at("info"), at("contact"), at("hello"), at("support"))
    listed = F.when((fn != "") & (d != ""), F.array_distinct(personal)).otherwise(roles)
    return contacts.filter("host is not null").select("contact_id", F.posexplode(listed).alias("rank", "email"))


def parse_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Keyword and place of search texts like ``X in Y`` or ``X near Y``."""
    q = F.trim(text)

    def part(word: str, group: int) -> Column:
        return F.trim(F.regexp_extract(q, rf"(?is)^(.+?)\s+{word}\s+(.+)$", group))

    keyword = F.coalesce(F.nullif(part("in", 1), F.lit("")), F.nullif(part("near", 1), F.lit("")), q)
    place = F.coalesce(F.nullif(part("in", 2), F.lit("")), F.nullif(part("near", 2), F.lit("")))
    return queries.withColumns({"keyword": keyword, "location": place})


# Query templates by keyword, first fit wins.
QUERY_TEMPLATES = (
    (1, ("dentist", "dental"), "Dental Clinic {city}"),
    (2, ("hotel",), "Boutique Hotel {city}"),
    (3, ("lawyer", "advocate", "law firm"), "Law Firm {city}"),
    (4, ("restaurant", "cafe"), "Top rated restaurants {city}"),
    (5, ("gym", "fitness"), "Fitness Center {city}"),
    (6, ("ca ", "chartered accountant"), "Accounting Firm {city}"),
)
DEFAULT_TEMPLATE = "Top {keyword} in {city}"
SITE_TEMPLATES = (
    '"{keyword}" "{city}" site:*.in OR site:*.com',
    '"contact us" "{keyword}" "{city}"',
    '"about us" "{keyword}" "{city}"',
    '"services" "{keyword}" "{city}"',
    'inurl:contact "{keyword}" "{city}"',
)


def expand_queries(seeds: DataFrame) -> DataFrame:
    """(keyword, city, kind, rank, query): the plain query, one by category, and five site queries."""
    kw = F.lower("keyword")
    template = F.lit(None).cast("string")
    for _, words, text in reversed(QUERY_TEMPLATES):
        hit = F.lit(False)
        for w in words:
            hit = hit | kw.contains(w)
        template = F.when(hit, F.lit(text)).otherwise(template)
    template = F.coalesce(template, F.lit(DEFAULT_TEMPLATE))
    kinds = F.array(
        F.struct(F.lit("search").alias("kind"), F.lit(0).alias("rank"), F.lit("{keyword} {city}").alias("template")),
        F.struct(F.lit("search").alias("kind"), F.lit(1).alias("rank"), template.alias("template")),
        *[
            F.struct(F.lit("site").alias("kind"), F.lit(i).alias("rank"), F.lit(t).alias("template"))
            for i, t in enumerate(SITE_TEMPLATES)
        ],
    )
    q = seeds.select("keyword", "city", F.explode(kinds).alias("t"))
    text = F.replace(F.replace(F.col("t.template"), F.lit("{keyword}"), F.col("keyword")), F.lit("{city}"), F.col("city"))
    return q.select("keyword", "city", "t.kind", "t.rank", text.alias("query"))


def profile_text(
    documents: DataFrame,
    classification_about: int | None = None,
    classification_services: tuple[int | None, int | None] = (None, None),
    classification_chars: int | None = None,
    profile_about: int | None = None,
    profile_chars: int | None = None,
    services: tuple[int | None, int | None] = (None, None),
    products: tuple[int | None, int | None] = (None, None),
    services_chars: int | None = None,
) -> DataFrame:
    """Model inputs per site: whole texts and lists, or as far as the given budgets go.

    ``classification_text`` takes title, description, hero, about and services, ``profile_text`` title, description, hero,
    about and the industry, ``services_text`` services and products. Budgets are letters of the about text, (items, letters
    of each) of a list, and letters in all; None is no limit.
    """

    def filled(name: str) -> Column:
        return F.nullif(name, F.lit(""))

    def upto(text: Column, letters: int | None) -> Column:
        return text if letters is None else F.substring(text, 1, letters)

    def first(name: str, budget: tuple[int | None, int | None]) -> Column:
        n, letters = budget
        items = F.coalesce(name, F.array().cast("array<string>"))
        cut = F.transform(items if n is None else F.slice(items, 1, n), lambda s: upto(s, letters))
        return F.when(F.size(cut) > 0, F.array_join(cut, ". "))

    head = [filled("title"), filled("description"), filled("hero")]
    classification = F.concat_ws(". ", *head, upto(filled("about"), classification_about), first("services", classification_services))
    industry = F.when(F.col("industry") != "Unknown", F.concat(F.lit("Industry: "), filled("industry")))
    profile = F.concat_ws(". ", *head, upto(filled("about"), profile_about), industry)
    listed = F.concat_ws(". ", first("services", services), first("products", products))
    return documents.select(
        "site",
        F.trim(upto(classification, classification_chars)).alias("classification_text"),
        upto(profile, profile_chars).alias("profile_text"),
        upto(listed, services_chars).alias("services_text"),
    )


def fill_first(template: Column, name: Column, token: str = "{{name}}") -> Column:
    """Template with its first token replaced."""
    at = F.instr(template, token)
    return F.when(
        at > 0,
        F.concat(F.substr(template, F.lit(1), at - 1), name, F.substr(template, at + len(token))),
    ).otherwise(template)


def render_messages(due: DataFrame) -> DataFrame:
    """Subject and body of due steps, addressed by first name or ``there``."""
    name = F.coalesce(F.nullif("first_name", F.lit("")), F.lit("there"))
    return due.withColumns(
        {"subject": fill_first(F.col("template_subject"), name), "body": fill_first(F.col("template_body"), name)}
    )
