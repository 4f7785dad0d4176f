import random
import zlib

import numpy as np

from tessera.llm import toxicity as tx
from tests.llm.samples import no_documents, odd_documents, prose


def labelled(n):
    r, out = random.Random(4), []
    for i in range(n):
        toxic = i % 4 == 0
        text = prose(i, r.randint(20, 120)).split(" ")
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["Fool!", "gruesom" + r.choice(["a", "e", "ish"]), "rotter"]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy_and_place(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows if i % 3], "doc_id long, toxic int, text string")
    weights = tx.train(docs, labels)
    got = {r.doc_id: r for r in tx.score_documents(docs, weights).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([got[i].predicted == y for i, y in held])
    assert right > 0.97, right
    for i, text, y in rows[:80]:
        for s in got[i].offending:
            words = text.encode()[s.start : s.end].decode().lower()
            assert "fool" in words or "gruesom" in words or "rotter" in words


def test_score_is_the_noisy_or():
    weights = np.zeros(tx.FEATURES + 2, np.float32)
    weights[-1] = -2
    texts = [b"", b"  .. ", b"one", b"one two. three\nfour! ", "ünï çé. x".encode(), b"long " * 5000]
    h = tx.sentences([b"one"])[0].ravel()
    weights[h[h < tx.FEATURES]] = 1.5
    total, p, docs, starts = tx.score(texts, weights)
    leak, one = 1 / (1 + np.exp(2)), 1 / (1 + np.exp(0.5))
    want = [1 - (1 - leak) * (1 - one) ** n for n in (0, 0, 1, 1, 0, 0)]
    assert np.allclose(total, want, atol=1e-6)
    assert np.diff(docs).tolist() == [0, 0, 1, 3, 2, 1] and starts[1:4].tolist() == [0, 9, 15]


def test_long_texts_are_read_whole():
    weights = tx.fit([b"fine words here. all good", b"fine words here. awfulness"] * 40, np.array([0, 1] * 40))
    far = b"fine words here. " * 90_000
    a, b = tx.score([far + b"awfulness", far], weights)[0]
    assert a > 0.5 > b


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None), (5, 0), (5, 0), (99, 1)], "doc_id long, toxic int")
    weights = tx.train(docs, labels)
    out = tx.score_documents(docs, weights)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len(set(out.columns)) == len(out.columns) and "lang" in out.columns
    none = tx.train(no_documents(spark), labels.limit(0))
    assert tx.score_documents(no_documents(spark), none).count() == 0


def test_held_out_rows_are_not_learned(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "poison" if i % 2 else "fine") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert not tx.train(docs, labels)[: tx.FEATURES].any()
