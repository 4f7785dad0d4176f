import os
import tempfile
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tessera.llm import decontamination as dc
from tessera.llm import toxicity as tx
from tessera.llm.catalog import vocabulary
from tests.llm.test_decontamination import slow as slow_overlaps
from tests.llm.test_lines_fingerprints import slow_lines
from tests.llm.test_near_dups import family, slow_components
from tests.llm.samples import prose

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bench = [(i, prose(70 + i, 30)) for i in range(4)]
    texts = []
    for i in range(150):
        t = prose(i, 40 + i)
        if i % 5 == 0:
            t = t.replace(" ", " rotter ", 3)
        if i % 7 == 0:
            t += "\n" + "\n".join(["shared line one here", "shared line two here", "shared line three here"]) + "\n" + prose(500 + i, 12)
        if i % 11 == 0:
            t += " " + bench[i % 4][1]
        texts.append(t)
    texts += family(5, 12, 90, 6) + [texts[3], texts[4], "", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("rotter" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_stages_against_brute_force(spark, folder):
    path, rows, bench = folder
    left = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def stage(k, docs):
        out = cp.STAGES[k][1](spark, docs, path)
        assert out.columns == cp.COLUMNS
        out.write.parquet(target := os.path.join(path, f"out{k}"))
        return spark.read.parquet(target)

    docs = stage(0, docs)
    weights = tx.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    score = tx.score([(t or "").encode() for t in left.values()], weights)[0]
    left = {i: t for (i, t), s in zip(left.items(), score) if s < 0.3}
    assert {r.doc_id: r.text for r in docs.collect()} == left
    assert sum("rotter" in (t or "") for t in left.values()) <= 2 and len(left) > 110

    docs = stage(1, docs)
    lines = slow_lines(left.items())
    left = {i: t for i, (t, n, gone) in lines.items() if not n or gone < n}
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)

    docs = stage(2, docs)
    kept = {i for i, (_, _, keep) in slow_components(list(left.items()), 5, 80).items() if keep}
    assert {r.doc_id for r in docs.collect()} == kept and len(kept) < len(left)
    left = {i: t for i, t in left.items() if i in kept}

    docs = stage(3, docs)
    hit = {d for d, _ in slow_overlaps(left.items(), bench)}
    left = {i: t for i, t in left.items() if i not in hit}
    assert {r.doc_id for r in docs.collect()} == set(left) and hit

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = cp.STAGES[4][1](spark, docs, path).collect()
    for i, t in left.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    assert {p.doc_id for p in pieces} == set(left)
    whole = {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in cp.run(spark, path).collect()}
    assert {(d, s) for d, s, _ in whole if d in left and s == 0} == {(i, 0) for i in left}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"] and cp.ORACLE_SQL is None
    assert dc.MASKS
