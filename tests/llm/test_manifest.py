import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest as mf
from tests.llm.samples import no_documents, odd_documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(r, n_chars):
    parts = [n_chars if f == "n_chars" else r[f] for f in mf.FIELDS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def slow_tree(nodes):
    """(root, for each node its list of (siblings, on_left)) of one tree, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append((nodes[other] if other < len(nodes) else "", k % 2 == 1))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def slow(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [(r.doc_id is not None, r.doc_id or 0, slow_leaf(r, r.n_chars), r) for r in rows if r.lang == lang]
        trees[lang] = sorted(own, key=lambda x: x[:3])
    subs = {lang: slow_tree([x[2] for x in own]) for lang, own in trees.items()}
    root, upper = slow_tree([subs[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for (_, _, leaf, r), path in zip(trees[lang], subs[lang][1]):
            path = path + upper[k]
            hit = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = slow_leaf(r, r.n_chars + 1) if hit else leaf
            for sibling, on_left in path:
                node = h(sibling, node) if on_left else h(node, sibling)
            assert (node == root) == (not hit)
            out.append((r.doc_id, leaf, subs[lang][0], root, h(*(s for s, _ in path)), node, node == root))
    return sorted(out, key=str)


def got(docs, levels):
    rows = mf.verified(mf.manifest(docs, mf.tampered(F.col("doc_id"), F.col("n_chars")), levels))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_against_brute_force(spark, levels):
    langs = [None, "en", "de", "é", "zz", "", "EN"]
    more = [(i, f"text {i} ñ", langs[min(i % 9, 6)], f"s{i}" if i % 4 else None, i if i % 5 else None) for i in range(20, 120)]
    extra = ", ".join(f"{c} string" for c in ("slot", "tree", "node", "n", "path", "place", "range", "root", "leaf"))
    rows = [(*r, *"abcdefghi") for r in more] + [(7, "one", "alone", "s", 3, *"abcdefghi")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs = docs.unionByName(odd_documents(spark).withColumn("lang", F.when(F.col("doc_id") == 2, "odd").otherwise(F.col("lang"))), allowMissingColumns=True)
    assert got(docs, levels) == slow(docs.collect())


def test_small_trees(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for n in (1, 2, 5, 9):
        docs = spark.createDataFrame([(i, "t", "en", None, 1) for i in range(n)], kinds)
        assert got(docs, 2) == slow(docs.collect())
    assert mf.verified(mf.manifest(no_documents(spark))).collect() == []
    assert mf.manifest(spark.createDataFrame([(None, None, None, None, None)] * 2, kinds)).count() == 2
