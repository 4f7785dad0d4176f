import hashlib
import re

from tessera.llm import fingerprints as fp
from tessera.llm.line_dedup import drop_emptied, remove_repeated_lines
from tests.llm.samples import no_documents, odd_documents


def slow_lines(docs, width=3):
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_lines_against_a_scan(spark):
    docs = odd_documents(spark, more=["q\nl1\nl2\nl3\nz", "l2\nl3\nl4\nl1", "a\na\na\na\na"]).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in remove_repeated_lines(docs).collect()}
    assert got == want and sum(n for *_, n in got.values()) > 0


def test_lines_of_odd_rows(spark):
    out = remove_repeated_lines(odd_documents(spark))
    assert out.count() == odd_documents(spark).count() and "source" in out.columns and len(set(out.columns)) == len(out.columns)
    assert drop_emptied(out).count() < out.count()
    assert remove_repeated_lines(no_documents(spark)).count() == 0


def test_lines_run_in_the_engine(spark):
    plan = remove_repeated_lines(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def slow_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    units = lambda t: {p for p in re.split(r"\n|(?<=[aeiounr][.!?]) ", t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after, third = rows[(i + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(units(text), units(edited)), 9), round(like(units(text), units(after)), 9))
    return out


def test_fingerprints_against_sets(spark):
    from tests.llm.samples import prose

    docs = odd_documents(spark, more=[prose(50 + i, 40 + 37 * i) for i in range(25)]).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = slow_fingerprints([(r.doc_id, r.text or "") for r in docs.collect()])
    rows = fp.fingerprint_documents(docs).collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows}
    assert got == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[4] == prints[5] and texts[4] == texts[5] and prints[4] != prints[6]


def test_query_cuts_at_every_sentence_end(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    lines = ["Kurt was left. Nobody met him at six. It is 1 of 3.", "She said \"no way!\" Then it got cold (or wet.) Last bit…", "Él lo vendió. Ella cantó. Fin del acto.",
             "第一句。第二句！第三句？", "Eins ist falsch. Zwei ist gut! Drei ist weg? Vier ist da.", "one piece only", ""]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    end = re.compile(r"""\n|(?<=[.!?…؟।]) |(?<=[.!?…؟।]["'”’»)\]]) |(?<=[。！？]) ?""")
    units = lambda t: {p for p in end.split(t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in QUERIES["op8_bloom_lookup_fingerprints"](spark, str(tmp_path)).collect()}
    assert [len(units(t)) for t in lines] == [3, 3, 3, 3, 4, 1, 0]
    for i, text in enumerate(lines):
        after, third = lines[(i - 1) % len(lines)], len(text) // 3
        assert abs(got[i].near_edited - like(units(text), units(text[: len(text) - third] + after[:third]))) < 1e-9
        assert int(got[i].fingerprint[:8], 16) == len(units(text))
    assert all(got[i].near_edited > 0 for i in range(5))


def test_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = fp.fingerprint_documents(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fp.fingerprint_documents(no_documents(spark)).count() == 0
    assert fp.fingerprint_documents(docs.limit(1)).first().near_next == 1.0


def test_small_sketches_fail_and_are_enlarged(spark):
    from pyspark.sql import functions as F

    keys = lambda low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.xxhash64(i))
    df = spark.range(1).select(keys(1, 400).alias("a"), keys(201, 700).alias("b"))
    df = df.withColumn("ca", fp.sketch(F.col("a"))).withColumn("cb", fp.sketch(F.col("b")))
    assert df.select(fp.peel(fp.subtract(F.col("ca"), F.col("cb")), 0).alias("x")).first().x is None
    r = fp.with_difference(df, "far", "a", "ca", "b", "cb").select("far", F.size("far_failed").alias("f")).first()
    assert r.f > 0 or r.far == 500


def test_next_document_over_any_blocks(spark):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    one, many = ([(r.doc_id, r.next.text) for r in sorted(fp.with_next(docs, blocks=b).collect(), key=lambda r: r.doc_id)] for b in (1, 64))
    assert one == many
