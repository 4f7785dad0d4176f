"""Crawled-page corpus: scan, and one pass that lays every page out as a flat list of nodes."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id bigint, url string, html string"

NODE_SCHEMA = (
    "page_id bigint, url string, nodes array<struct<n:int,last:int,tag:string,cls:string,id:string,href:string,"
    "text:string,noise:boolean>>"
)

# Elements whose content is not page text.
NOISE_TAGS = frozenset(("script", "style", "noscript", "svg", "iframe", "canvas", "nav", "aside", "header", "footer"))
VOID_TAGS = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
)
HIDDEN_STYLE = re.compile(r"display:\s*none|visibility:\s*hidden", re.I)

NODE_TYPE = pa.list_(
    pa.struct(
        [
            ("n", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("cls", pa.string()), ("id", pa.string()),
            ("href", pa.string()), ("text", pa.string()), ("noise", pa.bool_()),
        ]
    )
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as landed: (page_id, url, html)."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


CANONICAL = r"""(?i)<link\s+rel=["']canonical["']\s+href=["']([^"']*)["']"""


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (source, page_id, url, html) of landed text files, a page a line, in one folder per source.

    The page's canonical link names it; page_id is a hash of it (of the page where it has none). Spark's own reader
    lists and splits the files, in any store it knows.
    """
    lines = spark.read.schema("value string, source string").text(path)
    url = F.nullif(F.regexp_extract("value", CANONICAL, 1), F.lit(""))
    return lines.select("source", F.xxhash64(F.coalesce(url, "value")).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


class _Flattener(HTMLParser):
    """Elements and text pieces of one page in document order; ``last`` closes an element's range."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []

    def _add(self, tag: str, attrs: dict, text: str | None = None) -> dict:
        parent_noise = bool(self.open) and self.open[-1]["noise"]
        hidden = bool(HIDDEN_STYLE.search(attrs.get("style") or ""))
        node = {
            "n": len(self.nodes), "last": len(self.nodes), "tag": tag, "cls": attrs.get("class") or "", "id": attrs.get("id") or "",
            "href": attrs.get("href"), "text": text, "noise": parent_noise or hidden or tag in NOISE_TAGS,
        }
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, dict(attrs))
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, dict(attrs))

    def handle_endtag(self, tag):
        if any(node["tag"] == tag for node in self.open):
            while self.open:
                node = self.open.pop()
                node["last"] = len(self.nodes) - 1
                if node["tag"] == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            self._add("#text", {}, data.strip())

    def done(self) -> list[dict]:
        self.close()
        for node in self.open:
            node["last"] = len(self.nodes) - 1
        return self.nodes


def _flatten(html: str | None) -> list[dict]:
    flat = _Flattener()
    flat.feed(html or "")
    return flat.done()


#: Nodes that are gathered before they leave as a batch (a page's at least), so that memory does not grow with a batch's pages.
NODES_AT_ONCE = 50_000


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.select([c for c in batch.schema.names if c != "html"])
        start, some, held = 0, [], 0
        for i, html in enumerate(batch.column("html")):
            some.append(_flatten(html.as_py()))
            held += len(some[-1])
            if held >= NODES_AT_ONCE or i + 1 == batch.num_rows:
                rows = kept.slice(start, len(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(some, type=NODE_TYPE)], [*rows.schema.names, "nodes"])
                start, some, held = i + 1, [], 0


def page_nodes(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, nodes): node n of a page sits at position n of its list, its content up to ``last``.

    The only step that leaves the JVM; sections, blocks, cards and links are then array expressions. Columns named in
    ``keep`` stay before ``nodes``.
    """
    more = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in keep)
    schema = NODE_SCHEMA.replace("nodes array", f"{more}nodes array")
    return pages.select("page_id", "url", *keep, "html").mapInArrow(_flatten_batches, schema)
