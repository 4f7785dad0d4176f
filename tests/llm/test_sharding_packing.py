import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.catalog import vocabulary
from tessera.llm.packing import pack, pack_documents
from tessera.llm.sharding import jump, shard_documents
from tessera.llm.tokens import Encoder
from tests.llm.samples import no_documents, odd_documents


def slow_jump(key, shards):
    here, ahead = -1, 0
    while ahead < shards:
        here = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((here + 1) * (2.0**31 / ((key >> 33) + 1)))
    return here


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 200))
def test_jump_is_the_published_function(keys, shards):
    got = jump(np.array(keys, np.uint64), shards)
    assert got.tolist() == [slow_jump(k, shards) for k in keys]
    more = jump(np.array(keys, np.uint64), shards + 1)
    assert all(b in (a, shards) for a, b in zip(got, more))


def test_shards_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = shard_documents(docs).collect()
    assert len(rows) == docs.count()
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    by_id = {r.doc_id: r for r in rows}
    for d in docs.collect():
        r = by_id[d.doc_id]
        raw = (d.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 16
        assert r.grown_shard in (r.shard, 16)
    assert shard_documents(no_documents(spark)).count() == 0


def test_blocks_do_not_change_slots(spark):
    from pyspark.sql import functions as F

    from tessera.llm.sharding import with_slots

    rows = odd_documents(spark).select("doc_id", F.lit(0).alias("shard"))
    one, many = ({(r.doc_id, r.slot) for r in with_slots(rows, [F.col("doc_id")], blocks=b).collect()} for b in (1, 5000))
    assert one == many


@given(st.lists(st.integers(0, 300), max_size=60), st.sampled_from([1, 7, 64, 128]))
def test_pack_places_every_id_once(lengths, capacity):
    seen = {}
    sequences = pack(lengths, capacity)
    for s in sequences:
        assert s and sum(n for *_, n in s) <= capacity
        for item, start, n in s:
            seen.setdefault(item, []).append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, part in sorted(seen.get(item, [])):
            assert start == at and part > 0
            at += part
        assert at == n
    assert len(sequences) <= sum(lengths) // capacity + 1


def test_pack_balances_cost():
    costs = [sum(n + n * n / 6144 for *_, n in s) for s in pack([900, 800, 700, 600, 500, 400, 300, 200] * 8, 4096)]
    assert max(costs) < 1.25 * (sum(costs) / len(costs))


def test_packing_of_odd_documents(spark):
    docs = odd_documents(spark)
    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=512, window=3000).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    for d in docs.filter("doc_id is not null and doc_id <> 5").collect():
        own = sorted((p for p in pieces if p.doc_id == d.doc_id), key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
        assert ids == [*plain.encode(d.text or "", add_special_tokens=False).ids, 2] and own[0].doc_tokens == len(ids)
    assert pack_documents(no_documents(spark), vocabulary("word_bpe_49k.json")).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from(list("aAzß éñ.,'!s \n\t\x1c ́9²Σ<|>数"))))
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        if name not in KEPT:
            KEPT[name] = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
        ours, plain = KEPT[name]
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


KEPT: dict = {}
