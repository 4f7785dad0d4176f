"""Match keys and clean-up of single columns: phones, hosts, names, addresses, URLs, titles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal and sector suffixes dropped from the end of a business name.
NAME_SUFFIXES = (
    r"pvt\.?\s*ltd\.?",
    r"private\s+limited",
    r"limited",
    r"ltd\.?",
    r"llp",
    r"llc",
    r"inc\.?",
    r"corp\.?",
    r"co\.?",
    r"&\s+co\.?",
    r"associates",
    r"associate",
    r"enterprises",
    r"enterprise",
    r"solutions",
    r"services",
    r"technologies",
    r"technology",
    r"tech",
    r"group",
    r"india",
    r"international",
    r"clinic",
    r"clinics",
    r"hospital",
    r"hospitals",
    r"care",
    r"centre",
    r"center",
    r"academy",
    r"institute",
    r"studio",
    r"studios",
    r"agency",
    r"consultancy",
    r"consultant",
    r"consultants",
)
SUFFIX_PATTERN = r"(?:\s+(?:" + "|".join(NAME_SUFFIXES) + r"))+\s*$"

HOST_PATTERN = r"^https?://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?:[/?#:]|$)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and all-space text."""
    c = col(c)
    return F.when(F.trim(c) != "", c)


def present(c: Column | str) -> Column:
    """True where a text value is neither null nor empty."""
    return F.coalesce(col(c) != "", F.lit(False))


def truthy(c: Column | str) -> Column:
    """Boolean flag with null read as false."""
    return F.coalesce(col(c), F.lit(False))


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5) as a whole number."""
    return F.floor(c + F.lit(0.5)).cast("int")


def clamp(c: Column, low: int | float = 0, high: int | float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of every rule whose condition holds."""
    total = F.lit(0)
    for condition, value in rules:
        total = total + F.when(condition, F.lit(value)).otherwise(F.lit(0))
    return total


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def phone_key(c: Column | str, min_digits: int = 7, short: str = "null") -> Column:
    """Last ten digits. Under ``min_digits`` the key is null, or all digits with ``short='keep'``."""
    d = digits(c)
    key = F.when(F.length(d) >= min_digits, F.right(d, F.lit(10)))
    return F.coalesce(key, F.nullif(d, F.lit(""))) if short == "keep" else key


def host_key(c: Column | str) -> Column:
    """Lower-case host without a leading ``www.``; a missing scheme is read as https."""
    u = F.lower(F.trim(col(c)))
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.regexp_extract(u, HOST_PATTERN, 1), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def name_key(c: Column | str) -> Column:
    """Lower-case name without trailing legal/sector words, punctuation or repeated spaces."""
    n = F.lower(F.trim(col(c)))
    n = F.trim(F.regexp_replace(n, SUFFIX_PATTERN, ""))
    n = F.regexp_replace(n, r"[^\p{L}\p{N}_\s]", "")
    return F.nullif(F.trim(F.regexp_replace(n, r"\s+", " ")), F.lit(""))


def address_hash(c: Column | str) -> Column:
    a = F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " ")
    return F.when(present(c), F.md5(F.regexp_replace(a, r"[^\p{L}\p{N}_\s,]", "")))


def fold_name(c: Column | str) -> Column:
    """The form in which two raw names are compared letter by letter."""
    return F.nullif(F.lower(F.trim(col(c))), F.lit(""))


def with_match_keys(
    records: DataFrame,
    name: str = "raw_name",
    phone: str = "raw_phone",
    website: str = "raw_website",
    address: str = "raw_address",
    min_digits: int = 10,
) -> DataFrame:
    """Every record with its phone, host, name and address join keys."""
    return records.withColumns(
        {
            "phone_key": phone_key(phone, min_digits),
            "host_key": host_key(website),
            "name_key": name_key(name),
            "address_key": address_hash(address),
        }
    )


def clean_url(c: Column | str) -> Column:
    """Target of an ``/url?q=`` link as it is; else the URL without query, fragment and end slashes.

    A missing scheme is read as https.
    """
    u = F.trim(col(c))
    wrapped = F.regexp_extract(u, r"/url\?(?:[^#]*&)?q=([^&#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/+$", "")
    u = F.when(wrapped != "", F.coalesce(F.try_url_decode(wrapped), wrapped)).otherwise(bare)
    return F.when(present(c), F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))


def clean_title(c: Column | str) -> Column:
    """First part of a display title, cut at ``|``, an en/em dash, or a hyphen between spaces."""
    title = F.trim(col(c))
    first = F.trim(F.element_at(F.split(title, r"\s*[|–—]\s*|\s+-\s+", 2), 1))
    return F.when(first != "", first).otherwise(title)


# Trade words at which a listing title is cut.
TRADE_WORDS = ("Manufacturer", "Supplier", "Wholesaler", "Retailer", "Exporter", "Importer")


def trade_name(c: Column | str) -> Column:
    """Listing title without what follows a trade word or ``|``."""
    cut = r"(?i)\s+-\s+(?:" + "|".join(TRADE_WORDS) + ")"
    first = F.element_at(F.split(col(c), cut, 2), 1)
    return F.trim(F.element_at(F.split(first, r"\|", 2), 1))
