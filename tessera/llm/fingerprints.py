"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

DataFrame functions only. A paragraph is a piece of text up to a line break or the end of a sentence (by default of certain
sentences only; the query takes SENTENCE_END); a document is the set of its paragraphs' digests (48 bits and 16 check bits). A sketch has three rows of four cells; each digest enters
one cell of each row (cell: count and xor of its digests). Sketches of two versions are subtracted cell by cell; peeling then
takes out digests that stand alone in a cell until nothing is left. If that fails, both sets are sketched larger: they are
split by digest over so many sketches that each holds few differences, and a part that still fails is split by four again
with another seed. The likeness of two documents is shared / all digests, from the set sizes and the peeled difference.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ready, slots, written

ROW, ROWS = 4, 3
CELLS = ROW * ROWS
#: Digests that a part of an enlarged sketch is laid out for; rounds of peeling; enlargements of a failing part.
PER_PART, ROUNDS, DEPTH = 3, 6, 19
#: A paragraph ends at a line break, or after a sentence whose last letter is one of these: content alone decides, so any two
#: documents that share a passage cut it alike, and the letters set how fine.
PARAGRAPH_END = r"\n|(?<=[aeiounr][.!?]) "
#: How often a failing part is enlarged beside its row; what still fails then is worked on apart, over all rows.
IN_ROW = 2
#: Line breaks and every sentence end, in any script: a stop, with or without a closing mark, before a blank, or a full-width stop.
SENTENCE_END = r"""\n|(?<=[.!?…؟।]) |(?<=[.!?…؟।]["'”’»)\]]) |(?<=[。！？]) ?"""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column, paragraph_end: str = PARAGRAPH_END) -> Column:
    """The set of paragraph digests of a text; a null or empty text has none.

    A digest has 48 bits of a hash above 16 bits of check, which tell a digest from a mixture of several.
    """
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), paragraph_end), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: _let(F.xxhash64(p).bitwiseAND(F.lit(~0xFFFF)), lambda h: h.bitwiseOR(_check(h)))))


def _check(h: Column) -> Column:
    return F.xxhash64(h, F.lit("check")).bitwiseAND(F.lit(0xFFFF))


def _cell_bits(key: Column, seed: int) -> Column:
    """The cells of a digest, one in each row, as set bits of an integer."""
    bit = lambda h, r: F.call_function("shiftleft", F.lit(1), F.shiftright(h, 7 + 9 * r).bitwiseAND(F.lit(ROW - 1)).cast("int") + r * ROW)
    return _let(F.xxhash64(key, F.lit(seed)), lambda h: bit(h, 0).bitwiseOR(bit(h, 1)).bitwiseOR(bit(h, 2)))


def _signed(keys: Column, sign: int, seed: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("n"), k.alias("key"), _cell_bits(k, seed).alias("bits")))


def _added(entries: Column, cell: Column, i: Column) -> Column:
    """The cell with the entries that belong to it."""
    return F.aggregate(
        entries,
        cell,
        lambda c, e: F.when(
            F.getbit(e["bits"], i) == 1, F.struct((c["n"] + e["n"]).alias("n"), c["key"].bitwiseXOR(e["key"]).alias("key"))
        ).otherwise(c),
    )


def _cells(entries: Column) -> Column:
    """Cells of signed entries: the sketch of the positive ones minus the sketch of the negative ones."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"))
    return _let(entries, lambda given: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: _added(given, none, i)))


def sketch(keys: Column, seed: int = 0) -> Column:
    """The cells (n, key) of a set of digests."""
    return _cells(_signed(keys, 1, seed))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"))
    )


def peel(cells: Column, seed: int) -> Column:
    """Number of digests that a difference of sketches holds, or null if it can't be peeled to nothing."""

    def lone(state: Column) -> Column:
        """Digests that stand alone in a cell, with the sign that takes them out."""
        pure = F.filter(
            state["cells"],
            lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"].bitwiseAND(F.lit(~0xFFFF))) == c["key"].bitwiseAND(F.lit(0xFFFF))),
        )
        return F.array_distinct(
            F.transform(pure, lambda c: F.struct((-c["n"]).alias("n"), c["key"].alias("key"), _cell_bits(c["key"], seed).alias("bits")))
        )

    def without(state: Column, taken: Column) -> Column:
        left = F.transform(state["cells"], lambda c, i: _added(taken, c, i))
        return F.struct(left.alias("cells"), (state["found"] + F.size(taken)).alias("found"), F.lit(False).alias("over"))

    def step(state: Column) -> Column:
        stuck = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(
            _let(lone(state), lambda taken: F.when(F.size(taken) == 0, stuck).otherwise(without(state, taken)))
        )

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("over"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))
    return _let(end, lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0)), s["found"]))


def _part(keys: Column, which: Column, parts: Column, shift: int) -> Column:
    return F.filter(keys, lambda k: F.pmod(F.shiftright(k, shift), parts) == which)


def _attempt(a: Column, b: Column, seed: int) -> Column:
    """n: digests in one set only; null if peeling failed, and then the two sets for the next attempt."""
    entries = F.concat(_signed(a, 1, seed), _signed(b, -1, seed))
    return _let(
        peel(_cells(entries), seed),
        lambda n: F.struct(n.alias("n"), F.when(n.isNull(), a).alias("a"), F.when(n.isNull(), b).alias("b")),
    )


def _enlarged(a: Column, b: Column, side: Column, seed: int) -> Column:
    """Attempts over side x side parts of both sets (two steps, so that long documents stay cheap)."""

    def inner(x: Column, y: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), side - 1), lambda q: _attempt(_part(x, q, side, 13), _part(y, q, side, 13), seed)
        )

    def outer(p: Column) -> Column:
        return _let(_part(a, p, side, 0), lambda x: _let(_part(b, p, side, 0), lambda y: inner(x, y)))

    return F.flatten(F.transform(F.sequence(F.lit(0), side - 1), outer))


def _again(failed: Column, seed: int) -> Column:
    """Attempts over four parts of each failed part, with a new seed."""

    def four(f: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda p: _attempt(_part(f["a"], p, F.lit(4), 24 + 2 * seed), _part(f["b"], p, F.lit(4), 24 + 2 * seed), seed),
        )

    return F.flatten(F.transform(failed, four))


def _sum(attempts: Column) -> Column:
    return F.aggregate(attempts, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["n"], F.lit(0)))


def _failed(attempts: Column) -> Column:
    return F.filter(attempts, lambda x: x["n"].isNull())


def with_difference(df: DataFrame, name: str, a: str, cells_a: str, b: str, cells_b: str) -> DataFrame:
    """Adds ``name``, the number of digests peeled so far, and ``name_failed``, the parts that are still to be enlarged.

    The first attempt subtracts the fingerprints themselves. Where it fails the sets are sketched larger, and parts that
    fail are enlarged IN_ROW times more.
    """
    out = df.withColumn("_first", peel(subtract(F.col(cells_a), F.col(cells_b)), 0))
    side = F.ceil(F.sqrt((F.size(a) + F.size(b)) / PER_PART)).cast("int")
    empty = F.expr("cast(array() as array<struct<n:int,a:array<bigint>,b:array<bigint>>>)")
    out = out.withColumn("_side", side).withColumn(
        "_tries", F.when(F.col("_first").isNull(), _enlarged(F.col(a), F.col(b), F.col("_side"), 1)).otherwise(empty)
    )
    out = out.withColumn(name, F.coalesce(F.col("_first").cast("long"), _sum(F.col("_tries"))))
    for step in range(IN_ROW):
        out = out.withColumn("_tries", _again(_failed(F.col("_tries")), 2 + step))
        out = out.withColumn(name, F.col(name) + _sum(F.col("_tries")))
    return out.withColumn(f"{name}_failed", _failed(F.col("_tries"))).drop("_first", "_side", "_tries")


def _finish(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (written, with ``_row``) with the failed parts of the named differences enlarged until all are peeled."""
    one = [
        rows.filter(F.size(f"{n}_failed") > 0).select("_row", F.lit(n).alias("which"), F.explode(f"{n}_failed").alias("part"))
        for n in names
    ]
    pending = one[0]
    for more in one[1:]:
        pending = pending.unionByName(more)
    if pending.isEmpty():
        return rows
    done, seed = [], 2 + IN_ROW
    while not pending.isEmpty():
        if seed > DEPTH:
            raise RuntimeError("a sketch could not be peeled: two digests of one document agree in all bits used")
        tried = written(pending.select("_row", "which", F.explode(_again(F.array("part"), seed)).alias("part")))
        done.append(tried.filter("part.n is not null").select("_row", "which", F.col("part.n").cast("long").alias("n")))
        pending = tried.filter("part.n is null")
        seed += 1
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    sums = total.groupBy("_row").agg(*[F.sum(F.when(F.col("which") == n, F.col("n")).otherwise(0)).alias(f"{n}_more") for n in names])
    open_ = F.greatest(*[F.size(f"{n}_failed") for n in names]) > 0
    late = rows.filter(open_).join(sums, "_row", "left")
    late = late.withColumns({n: F.col(n) + F.coalesce(F.col(f"{n}_more"), F.lit(0)) for n in names}).select(*rows.columns)
    return rows.filter(~open_).unionByName(late)


def likeness(total: Column, different: Column) -> Column:
    """Shared over all digests of two documents, 0 to 1, from their set sizes and the difference; without any they are alike."""
    return F.when(total == 0, F.lit(1.0)).otherwise((total - different) / (total + different).cast("double"))


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint as a string: number of digests, then count and digest of each cell in hexadecimal."""
    return F.concat(
        F.lpad(F.lower(F.hex(F.size(keys))), 8, "0"),
        F.array_join(
            F.transform(
                cells,
                lambda c: F.concat(
                    F.lpad(F.lower(F.hex(c["n"].bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"), F.lpad(F.lower(F.hex(c["key"])), 16, "0")
                ),
            ),
            "",
        ),
    )


def with_next(docs: DataFrame, blocks: int | None = None, paragraph_end: str = PARAGRAPH_END) -> DataFrame:
    """doc_id, text, cells and digests of each document, and ``next_*`` of the next one in descending doc_id.

    doc_id ranges between sampled ids of the table are worked on apart; the document at the head of a range is sent to the
    range before it too. Ties are ordered by a hash of the text; null doc_ids come last; after the last comes the first.
    """
    spark = docs.sparkSession
    count = blocks or slots(spark, 4)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    cuts = rows.agg(
        F.percentile_approx("_key", [i / count for i in range(1, count)] or [0.5], count * 50).alias("cuts"),
        F.min("_key").alias("low"),
        F.max("_key").alias("high"),
    ).first()
    high = cuts["high"]
    edges = sorted({*(cuts["cuts"] or [])} - {high})  # a range ends with an edge: (edge before, edge]
    place = F.lit(len(edges))
    if edges:
        found = F.array_position(F.transform(F.lit(edges), lambda e: e >= F.col("_key")), True)
        place = F.when(found > 0, found.cast("int") - 1).otherwise(F.lit(len(edges)))
    at_edge = F.col("_key").isin(edges) if edges else F.lit(False)
    # ranges are read downwards, so the head of a range follows the tail of the range above it
    copies = F.array(F.struct(F.col("_place").alias("block"), F.lit(0).alias("late"), F.lit(False).alias("ghost")))
    copies = F.concat(
        copies,
        F.when(at_edge, F.array(F.struct((F.col("_place") + 1).alias("block"), F.lit(1).alias("late"), F.lit(True).alias("ghost")))).otherwise(F.array()),
        F.when(F.col("_key") == F.lit(high), F.array(F.struct(F.lit(0).alias("block"), F.lit(2).alias("late"), F.lit(True).alias("ghost")))).otherwise(F.array()),
    )
    dealt = (
        rows.withColumn("_place", place)
        .withColumn("_copy", F.explode(copies))
        .select("doc_id", "text", "_key", "_copy.*")
        .repartition(slots(spark), "block")
        .withColumn("keys", digests(F.col("text"), paragraph_end))
        .withColumn("cells", sketch(F.col("keys")))
    )
    order = Window.partitionBy("block").orderBy("late", F.desc("_key"), F.xxhash64("text"), "text")
    ahead = F.lead(F.struct("text", "keys", "cells")).over(order)
    return dealt.withColumn("next", ahead).filter("not ghost").select("doc_id", "text", "keys", "cells", "next")


def fingerprint_documents(docs: DataFrame, paragraph_end: str = PARAGRAPH_END) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty). The edited text has its last third replaced by the head of the
    next document. ``paragraph_end`` is the pattern that ends a paragraph (SENTENCE_END: each sentence is one). Equal texts have equal fingerprints; repeated rows each give a row; an empty table gives none.
    """
    ready(docs.sparkSession)
    if docs.isEmpty():
        docs = docs.limit(0)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = with_next(docs, paragraph_end=paragraph_end).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    )
    both = edited.withColumn("edited_keys", digests(F.col("edited"), paragraph_end)).withColumn("edited_cells", sketch(F.col("edited_keys")))
    both = both.withColumn("next_keys", F.col("next.keys")).withColumn("next_cells", F.col("next.cells"))
    both = with_difference(both, "far_edited", "keys", "cells", "edited_keys", "edited_cells")
    both = with_difference(both, "far_next", "keys", "cells", "next_keys", "next_cells")
    rows = written(
        both.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("keys"), F.col("cells")).alias("fingerprint"),
            as_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
            F.size("keys").alias("_n"),
            F.size("edited_keys").alias("_n_edited"),
            F.size("next_keys").alias("_n_next"),
            *[c for c in both.columns if c.startswith("far_")],
        )
    )
    return _finish(rows, ["far_edited", "far_next"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("_n") + F.col("_n_edited"), F.col("far_edited")).alias("near_edited"),
        likeness(F.col("_n") + F.col("_n_next"), F.col("far_next")).alias("near_next"),
    )
