import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import decontamination as dc
from tests.llm.samples import no_documents, odd_documents, prose


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def slow(docs, items, least=dc.LEAST_EQUAL, share=dc.LEAST_SHARE):
    """All diagonals of all pairs; those with a stretch that passes and holds a seed."""
    out = set()
    for doc_id, text in docs:
        a = words(text)
        for item_id, item in items:
            b = words(item)
            if len(b) < 6:
                continue
            need = min(least, -(-4 * len(b) // 5))
            for diagonal in range(-len(b) + 1, len(a)):
                low, high = max(0, diagonal), min(len(a), diagonal + len(b))
                same = np.array([a[i] == b[i - diagonal] for i in range(low, high)])
                seeded = any(all(same[i + o] for o, bit in enumerate(m) if bit == "1") for m in dc.MASKS for i in range(len(same) - len(m) + 1))
                if same.sum() >= need and seeded and dc.overlaps(same, need, share):
                    out.add((doc_id, item_id))
    return out


def changed(text, every, seed):
    out = text.split(" ")
    for i in range(seed % every, len(out), every):
        out[i] = f"zz{seed}{i}"
    return " ".join(out)


def cases(spark):
    r = random.Random(8)
    items = [(i, prose(100 + i, r.randint(14, 55))) for i in range(10)] + [(10, "only four words here"), (11, prose(100, 20)), (12, None), (13, ""), (14, prose(113, 9)), (15, prose(113, 9))]
    more = []
    for i in range(10):
        t = items[i][1]
        for every in (1000, 2, 3, 4, 5, 7):
            more.append(prose(300 + i, 60) + " " + changed(t, every, i + every) + " " + prose(400 + i, 60))
        more += [t.upper(), t.replace(" ", ",  "), " ".join(t.split(" ")[:7]) + " " + prose(500 + i, 30), items[14][1] + " " + prose(600 + i, 40)]
    return odd_documents(spark, more), spark.createDataFrame([(*x, 1, "t") for x in items], "item_id long, text string, doc_id long, tokens string"), items


def test_overlaps_against_all_diagonals(spark):
    docs, bench, items = cases(spark)
    got = {(x.doc_id, x.item_id) for x in dc.contaminated_items(docs, bench).collect()}
    want = slow([(d.doc_id, d.text) for d in docs.collect() if d.doc_id is None or d.doc_id not in (10,)], [x for x in items if x[0] != 15])
    assert got == want and len(got) > 60


def test_clean_documents_stay(spark):
    docs, bench, _ = cases(spark)
    hit = {x.doc_id for x in dc.contaminated_items(docs, bench).collect()}
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {x.doc_id for x in left.collect()} == {x.doc_id for x in docs.collect()} - hit


@given(st.lists(st.booleans(), max_size=60), st.integers(1, 12))
def test_stretches(same, least):
    got = dc.overlaps(np.array(same, bool), least, 0.65)
    for a, b, equal in got:
        assert equal == sum(same[a:b]) >= max(least, 0.65 * (b - a)) and same[a] and same[b - 1]
    assert all(x[1] <= y[0] or y[1] <= x[0] for i, x in enumerate(got) for y in got[:i])
    if same and all(same) and len(same) >= least:
        assert got == [(0, len(same), len(same))]


def passing(same, least):
    """All intervals that pass, by the letter of the definition."""
    ends = [0, *np.cumsum(same)]
    return {(a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if ends[b] - ends[a] >= least and 20 * (ends[b] - ends[a]) >= 13 * (b - a)}


@given(st.integers(0, 2**32), st.integers(0, 90), st.sampled_from([0.5, 0.6, 0.7]), st.integers(1, 12))
def test_each_passing_interval_meets_an_overlap(seed, n, share, least):
    same = np.random.default_rng(seed).random(n) < share
    want, got = passing(same, least), [x[:2] for x in dc.overlaps(same, least, 0.65)]
    assert set(got) <= want and all(any(a < y and x < b for x, y in got) for a, b in want)


def test_runs_inside_a_more_changed_copy():
    same = np.array(([True] * 10 + [False] * 9) * 5 + [True] * 10)
    assert sorted(dc.overlaps(same, 10, 0.65)) == [(19 * i, 19 * i + 10, 10) for i in range(6)]


def test_empty_tables(spark):
    docs, bench, _ = cases(spark)
    assert dc.contaminated(no_documents(spark), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
