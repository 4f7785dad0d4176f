import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import infilling as im
from tests.llm.samples import no_documents, odd_documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LETTERS = st.sampled_from(list("ab \t\n\r\x0b\x0c\x08\x0e\x1f!é \u0085 ñ数🙂\x00\x7f"))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet=LETTERS, max_size=40), min_size=1, max_size=6), st.integers(0, 1000))
def test_units_against_the_pattern(texts, draw):
    units = im.Units([t.encode() for t in texts])
    parts = [UNIT.findall(t) for t in texts]
    assert units.counts.tolist() == [len(p) for p in parts]
    for k in {0, 1, draw, 10**6}:
        wanted = np.array([min(k, len(p)) if k == 10**6 else k % (len(p) + 1) for p in parts])
        heads = ["".join(p[:w]) for p, w in zip(parts, wanted)]
        cuts = units.cuts(wanted)
        assert cuts.tolist() == [len(h.encode()) for h in heads]
        assert units.code_points(cuts).tolist() == [len(h) for h in heads]


def slow(doc_id, text):
    text = text or ""
    parts = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    i, j = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    a, b, c = "".join(parts[:i]), "".join(parts[i:j]), "".join(parts[j:])
    if not text or any(x in text for x in im.SENTINELS) or h3 % 100 >= 50:
        return (len(parts), "plain", None, None, text, text)
    if h4 % 100 < 80:
        return (len(parts), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}", text)
    return (len(parts), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}", text)


def test_whole_rows_against_brute_force(spark):
    more = [f"a{'<' * (i % 3)} b >{i}é 🙂 \t\n c<P{'>' * (i % 5 == 0)} " + "w " * (i % 11) for i in range(150)] + ["word " * 300_000, "é" * 500_000, " \n" * 40]
    docs = odd_documents(spark, more)
    rows = im.fill_in_middle(docs).withColumn("back", im.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows), key=str)
    want = sorted(((d.doc_id, *slow(d.doc_id, d.text)) for d in docs.collect()), key=str)
    assert got == want and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert im.fill_in_middle(no_documents(spark)).collect() == []


def test_other_rates_and_sentinels(spark):
    docs = odd_documents(spark)
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = im.fill_in_middle(docs, rate=100, spm=0, sentinels=marks).withColumn("back", im.restored(F.col("output"), F.col("form"), marks))
    for r in rows.join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        assert r.form == ("psm" if r.text else "plain") and r.back == (r.text or "")
    assert im.fill_in_middle(docs, rate=0).filter("form <> 'plain'").isEmpty()
