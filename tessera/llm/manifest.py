"""Merkle manifest of a dataset: a tree of SHA-256 digests for each language, and one over the languages' roots.

The nodes of a tree are rows in slot order. Two consecutive nodes of a level have one parent, so a node of level k is the run of
2^k slots that begins at a multiple of 2^k, and its row is the first of that run: the first child hashes its parent. On these rows
the sibling is the row 2^k further on or back, which a lead or lag of that fixed offset reads; slot and number of nodes say which
of the two counts and where the tree ends. All other rows of a run take the sibling from its first row, by a running last value.

A window holds 2^LEVELS consecutive slots of a tree, so LEVELS levels share one shuffle and one sort, and no task needs a whole
language. What is left, one node a window, is the bottom of the next tier, and so on; a proof is the tiers' siblings in turn.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ready, slots, written

#: Levels worked off inside one window of 2^LEVELS rows.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    """The leaf of a row of documents, with ``n_chars`` in the place of its own."""
    return digest(*(field(n_chars if name == "n_chars" else F.col(name)) for name in FIELDS))


def with_slots(rows: DataFrame, tree: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``slot``, the gapless place from 0 of a row in its tree by ``order``, and ``n``, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so a large tree is many ranges; each (range, tree) is numbered apart and moved by
    the counts of the ranges before it, of which there are (ranges + trees) at most. ``order`` must tell rows of a tree apart.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(ranges or slots(rows.sparkSession), F.col(tree), *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt)
    counts = dealt.groupBy(tree, "range").agg(F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(tree).alias("of_tree"), F.col("range").alias("of_range"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n")
    )
    inside = Window.partitionBy("range", tree).orderBy(*order)
    same = (F.col("range") == F.col("of_range")) & F.col(tree).eqNullSafe(F.col("of_tree"))
    return dealt.withColumn("rank", F.row_number().over(inside) - 1).join(counts, same).select(
        *names, (F.col("rank") + F.col("before")).cast("long").alias("slot"), F.col("n").cast("long").alias("n")
    )


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, slot, n, node) with ``path``, the steps of each row through ``levels`` levels or up to its root.

    ``node`` becomes, on the first row of each window, the node that the window ends in (null elsewhere).
    """
    block = Window.partitionBy("tree", F.shiftright("slot", levels)).orderBy("slot")
    first_siblings = []
    for level in range(levels):
        step = 1 << level
        open_, first = F.col("n") > step, F.col("slot") % step == 0
        on_left = F.shiftright("slot", level) % 2 == 1
        beside = F.when(on_left, F.lag("node", step).over(block)).otherwise(F.lead("node", step).over(block))
        first_siblings.append(f"sibling_{level}")
        nodes = nodes.withColumn(f"sibling_{level}", F.when(open_ & first, F.coalesce(beside, F.lit(""))))
        parent = F.when(open_, digest(F.col("node"), F.col(f"sibling_{level}"))).otherwise(F.col("node"))
        nodes = nodes.withColumn("node", F.when(F.col("slot") % (2 * step) == 0, parent))
    running = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumns({s: F.last(s, ignorenulls=True).over(running) for s in first_siblings})
    step_of = lambda k, s: F.struct(F.col(s).alias("sibling"), (F.shiftright("slot", k) % 2 == 1).alias("on_left"))
    steps = F.array(*(F.when(F.col(s).isNotNull(), step_of(k, s)) for k, s in enumerate(first_siblings)))
    return nodes.withColumn("path", F.array_compact(steps)).drop(*first_siblings)


def with_paths(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with ``path``; the roots: tree, root) for nodes with tree, slot, n and node.

    ``path`` has (sibling, on_left) from the bottom up: the other node of the run, empty where a node is alone in its run. Further
    columns stay. Each tier is written, so a lost executor costs its running tasks only.
    """
    done = written(_tier(nodes, levels))
    tops = done.filter(F.col("node").isNotNull() & (F.col("slot") % (1 << levels) == 0)).select(
        "tree", F.shiftright("slot", levels).alias("slot"), F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), "node"
    )
    below = done.drop("node")
    roots = tops.filter("n = 1").select("tree", F.col("node").alias("root"))
    open_ = tops.filter("n > 1")
    if open_.isEmpty():
        return below, roots
    above, more = with_paths(open_, levels)
    above = above.select(F.col("tree").alias("_tree"), F.col("slot").alias("_block"), F.col("path").alias("_above"))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("slot", levels) == F.col("_block"))
    joined = below.join(above, same, "left")
    path = F.when(F.col("_above").isNull(), F.col("path")).otherwise(F.concat("path", "_above"))
    return joined.withColumn("path", path).drop("_tree", "_block", "_above"), roots.unionByName(more)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.when(s["on_left"], digest(s["sibling"], node)).otherwise(digest(node, s["sibling"])))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings in turn."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def manifest(docs: DataFrame, tampered_n_chars: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path, claimed_leaf: the manifest of ``docs``, one row per row.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns stay out, so names cannot clash. Leaves of a language
    ascend by doc_id (null first), then by leaf digest; repeated rows are leaves of their own. Null is a language of its own and
    the first one, the others follow by their UTF-8 bytes. A tree of one leaf is that leaf. ``claimed_leaf`` is the leaf with
    ``tampered_n_chars`` in the place of n_chars: what a reader would recompute from a changed row. Texts are read once, in the
    scan, and only digests are moved. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    if not 1 <= levels <= 16:
        raise ValueError("1 to 16 levels to a window")
    claimed = leaf_digest(F.col("n_chars") if tampered_n_chars is None else tampered_n_chars)
    # equal rows are told apart by their place in the scan; whichever comes first, the tree is the same
    leaves = docs.select("doc_id", "lang", leaf_digest(F.col("n_chars")).alias("leaf"), claimed.alias("claimed_leaf"), F.monotonically_increasing_id().alias("place"))
    placed = with_slots(leaves, "lang", ["doc_id", "leaf", "place"]).drop("place")
    rows, roots = with_paths(placed.withColumnsRenamed({"lang": "tree"}).withColumn("node", F.col("leaf")), levels)
    subroots = with_slots(roots.select(F.lit(0).alias("all"), "tree", F.col("root").alias("subroot")), "all", ["tree"])
    upper, root = with_paths(subroots.select(F.col("all").alias("tree"), F.col("tree").alias("_lang"), "subroot", "slot", "n", F.col("subroot").alias("node")), levels)
    upper = upper.join(root.select(F.col("tree").alias("_all"), "root"), F.col("tree") == F.col("_all"))
    upper = upper.select("_lang", "subroot", F.col("path").alias("_upper"), "root")
    joined = rows.join(upper, F.col("tree").eqNullSafe(F.col("_lang")))
    return joined.select(
        "doc_id", F.col("tree").alias("lang"), "leaf", "subroot", "root", F.concat("path", "_upper").alias("path"), "claimed_leaf"
    )


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """n_chars plus 1 where 7 divides the crc32 of the decimal doc_id; nulls stay."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, n_chars + 1).otherwise(n_chars)


def verified(rows: DataFrame) -> DataFrame:
    """The digests of ``manifest`` rows, the root recomputed from the claimed leaf, and whether it is the manifest's."""
    again = folded(F.col("claimed_leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def rows_sql() -> str:
    """The query's rows in SQL, over a table named documents; crc32 is worked out bit by bit."""
    part = lambda e: f"coalesce(octet_length(encode({e}::varchar))::varchar || ':' || {e}::varchar, '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(n if f == "n_chars" else f) for f in FIELDS) + ")"
    return f"""
with recursive b as (select doc_id, doc_id::varchar as s, 0 as k, 4294967295::bigint as crc from documents union all
  select doc_id, s, k + 1, xor(c >> 1, 3988292384::bigint * (c & 1))
  from (select *, case when k % 8 = 0 then xor(crc, ascii(s[k // 8 + 1])::bigint) else crc end as c from b where k < 8 * length(s))),
hits as (select doc_id from b where k = 8 * length(s) and xor(crc, 4294967295::bigint) % 7 = 0),
d as (select doc_id, lang, {leaf('n_chars')} as leaf, {leaf('(n_chars + (doc_id in (from hits))::int)')} as claimed,
  row_number() over (partition by lang order by doc_id nulls first) - 1 as slot, count(*) over (partition by lang) as n from documents),
t as (select 0 as lvl, lang, slot as i, leaf as h, n from d union all
  select lvl + 1, lang, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from t where n > 1 group by lvl, lang, i // 2, n),
s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as slot, count(*) over () as n from t where n = 1),
u as (select 0 as lvl, slot as i, subroot as h, n from s union all
  select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from u where n > 1 group by lvl, i // 2, n),
p as (select lvl, lang, i, coalesce(case when i % 2 = 1 then lag(h) over w else lead(h) over w end, '') as sib from t window w as (partition by lvl, lang order by i)),
q as (select lvl, i, coalesce(case when i % 2 = 1 then lag(h) over w else lead(h) over w end, '') as sib from u window w as (partition by lvl order by i)),
f as (select 0 as lvl, doc_id, lang, slot as i, n, claimed as h, '' as proof from d union all
  select f.lvl + 1, doc_id, f.lang, f.i // 2, (f.n + 1) // 2, sha256(case when f.i % 2 = 1 then sib || h else h || sib end), proof || sib
  from f join p on p.lvl = f.lvl and p.lang is not distinct from f.lang and p.i = f.i where f.n > 1),
g as (select 0 as lvl, doc_id, s.slot as i, s.n, h, proof from f join s on s.lang is not distinct from f.lang where f.n = 1 union all
  select g.lvl + 1, doc_id, g.i // 2, (g.n + 1) // 2, sha256(case when g.i % 2 = 1 then sib || h else h || sib end), proof || sib
  from g join q on q.lvl = g.lvl and q.i = g.i where g.n > 1)
select d.doc_id, leaf, subroot, u.h as root, sha256(proof) as proof_sha256, g.h as folded_root, g.h = u.h as verified
from d join s on s.lang is not distinct from d.lang join u on u.n = 1 join g on g.n = 1 and g.doc_id = d.doc_id
"""
