"""Register of named queries: a Spark job over the tables, and its twin in plain SQL where one exists."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.keys import HOST_PATTERN, SUFFIX_PATTERN
from tessera.plans.views import Tables, sql_with_views
from tessera.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with its SQL twin."""

    def keep(job: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, base: job(Tables(prepare(spark), base))
        if sql is not None:
            ORACLES[name] = sql_with_views(sql)
        return job

    return keep


# ---- pieces of SQL used by many twins -----------------------------------------------------------


def sql_digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def sql_phone(c: str, least: int = 7) -> str:
    return f"(case when length({sql_digits(c)}) >= {least} then right({sql_digits(c)}, 10) end)"


def sql_host(c: str) -> str:
    u = f"(case when regexp_matches(lower(trim({c})), '^https?://') then lower(trim({c})) else 'https://' || lower(trim({c})) end)"
    return f"nullif(regexp_replace(regexp_extract({u}, '{HOST_PATTERN}', 1), '^www\\.', ''), '')"


def sql_name(c: str) -> str:
    cut = f"trim(regexp_replace(lower(trim({c})), '{SUFFIX_PATTERN}', ''))"
    bare = f"regexp_replace({cut}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"nullif(trim(regexp_replace({bare}, '\\s+', ' ', 'g')), '')"


def sql_address(c: str) -> str:
    flat = f"regexp_replace(lower(trim({c})), '\\s+', ' ', 'g')"
    return f"(case when {c} <> '' then md5(regexp_replace({flat}, '[^\\p{{L}}\\p{{N}}_\\s,]', '', 'g')) end)"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_values(rows, columns: str) -> str:
    """A short fixed table as ``(values ...) as t(columns)``."""

    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as {columns}"


def sql_any(text: str, words) -> str:
    """Does a text contain any of the words?"""
    return "(" + " or ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"
