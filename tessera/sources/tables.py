"""Declared schemas and the table accessor (column lists reach the Parquet scan)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One schema per landed table; nothing is inferred.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(
    spark: SparkSession,
    base: str,
    name: str,
    columns: Sequence[str] | None = None,
    predicate: Column | None = None,
) -> DataFrame:
    """Scan one table; the column list and the predicate are pushed to the file scan."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}.parquet")
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df


def visible_to(df: DataFrame, user: str, owner: str = "user_id", shared: str | None = None) -> DataFrame:
    """Rows a user may see: their own ones, and shared rows where the table has such a flag."""
    own = F.col(owner) == F.lit(user)
    return df.filter(own | F.coalesce(F.col(shared), F.lit(False)) if shared else own)
