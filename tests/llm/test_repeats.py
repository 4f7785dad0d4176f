import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats as rp
from tests.llm.samples import no_documents, odd_documents, prose


def slow(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def passages():
    r = random.Random(3)
    shared = [prose(700 + i, 60) for i in range(6)]
    out = []
    for i in range(60):
        parts = [prose(800 + i, r.randint(3, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts += [s[a : a + r.randint(20, len(s))], prose(900 + i, r.randint(1, 9))]
        out.append(" ".join(parts))
    return [*out, out[3], out[3], out[5] + "!", "ab" * 400, "a" * 500, "z" * 30]


@pytest.mark.parametrize("length,gram,hot", [(40, 12, 50_000), (40, 12, 1), (200, 64, 50_000)])
def test_every_byte_against_all_strings(spark, length, gram, hot):
    docs = odd_documents(spark, passages()).filter("doc_id is null or doc_id <> 10")
    rows = docs.collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rp.remove_repeats(docs, length, gram, hot=hot).collect())
    want = slow([(r.text or "").encode() for r in rows], length)
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, want)) and sum(w[1] for w in want) > 5000


def test_anchors_depend_on_content_alone(monkeypatch):
    data = (prose(1, 400) + "aaaa" * 100 + prose(1, 400)).encode()
    whole = [np.concatenate(x) for x in zip(*rp.anchors(np.frombuffer(data, np.uint8), 50, 10))]
    assert whole[1].sum() == len(data) - 49 and (whole[0][1:] == whole[0][:-1] + whole[1][:-1]).all()
    monkeypatch.setattr(rp, "PIECE", 300)
    parts = [np.concatenate(x) for x in zip(*rp.anchors(np.frombuffer(data, np.uint8), 50, 10))]
    spread = lambda a: np.repeat(a[2], a[1])
    assert (spread(parts) == spread(whole)).all()


def test_levels_are_powers_of_two(spark):
    from pyspark.sql import functions as F

    family, seen = rp.SuffixFamily(), Counter()
    for b in range(7):
        keys = [random.Random(b).randrange(60) for _ in range(12)]
        seen.update(keys)
        got = {r.key for r in family.add(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
        assert got == {k for k in set(keys) if seen[k] > 1}
    assert [n for n, _ in family.levels] == [4, 2, 1]
    total = sum(t.agg(F.sum("n")).first()[0] for _, t in family.levels)
    assert total == 84


def test_no_documents(spark):
    assert rp.remove_repeats(no_documents(spark)).count() == 0
