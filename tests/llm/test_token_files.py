import tempfile

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_files as tf
from tessera.llm.catalog import vocabulary
from tests.llm.samples import no_documents, odd_documents, prose


@given(st.lists(st.lists(st.integers(3, 9), max_size=60), min_size=1, max_size=20), st.integers(2, 6))
@settings(deadline=None)
def test_shards_come_back(documents, least):
    blobs = [np.array([*d, 2], "<u4").tobytes() for d in documents]
    s = tf.Shard(tf.write_shard([None, *range(1, len(blobs))], blobs))
    assert [(i, x.tolist()) for i, x in s.documents()] == [(i or None, [*d, 2]) for i, d in enumerate(documents)]
    assert all(s.document(k).tolist() == [*d, 2] for k, d in enumerate(documents))
    flat = [x for d in documents for x in [*d, 2]]
    for low in range(0, len(flat), 7):
        assert s.ids(low, low + 11).tolist() == flat[low : low + 11]
    symbols, rules = tf.compress(np.array(flat), 10, least=least)
    assert tf.expand(symbols, rules, 10).tolist() == flat and len(symbols) <= len(flat)


def test_frequent_pairs_are_replaced():
    ids = np.array([3, 4, 5, 6] * 500 + [7] * 301 + [2])
    symbols, rules = tf.compress(ids, 10)
    assert len(symbols) < 60 and tf.lengths_of(rules, 10).max() >= 64
    assert tf.expand(symbols, rules, 10).tolist() == ids.tolist()


def test_symbols_are_packed_in_bounded_space():
    import tracemalloc

    values = np.random.default_rng(1).integers(0, 1 << 16, 100_000)
    tracemalloc.start()
    packed = tf._pack(values, 16)
    back = tf._unpack(packed, 16, 7, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.tolist() == values[7:].tolist() and peak < 100 * len(values)  # one byte a bit, not a long


def test_files_against_the_library(spark):
    from tokenizers import Tokenizer

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    docs = odd_documents(spark, more=[prose(9, 700)] * 3)
    tf.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), shard_ids=2000, tasks=4)
    rows = sorted(tf.read_token_files(spark, path).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    key = lambda d: (d is not None, d or 0)
    given = sorted(docs.collect(), key=lambda d: key(d.doc_id))
    assert [r.doc_id for r in rows] == [d.doc_id for d in given]
    at = 0
    for r, d in zip(rows, given):
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)


def test_no_documents(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    tf.write_token_files(no_documents(spark), path, vocabulary("byte_bpe_50k.json"))
    assert tf.read_token_files(spark, path).count() == 0
