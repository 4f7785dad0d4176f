"""Fuzzy join, components and leader clustering against brute force on seeded random inputs."""
import random

import pytest

from pyspark.sql import functions as F

from tessera.operators import fuzzy, graphs
from tessera.operators.fuzzy import fuzzy_name_pairs
from tessera.operators.graphs import connected_components, leaders_by_keys, leaders_by_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return 20 * distance(a, b) <= 3 * max(len(a), len(b))


def edited(rng, word, times):
    chars = list(word)
    for _ in range(times):
        op, at = rng.randrange(3), rng.randrange(max(1, len(chars)))
        if op == 0 and len(chars) > 1:
            del chars[at]
        elif op == 1:
            chars.insert(at, rng.choice("abc "))
        elif chars:
            chars[at] = rng.choice("abc ")
    return "".join(chars).strip()


def some_names(rng, n):
    names = set()
    while len(names) < n:
        base = "".join(rng.choice("abc ") for _ in range(rng.randrange(3, 30))).strip()
        tail = rng.choice(["", " dental clinic", " and sons limited"])
        names.add(base + tail)
        names.add(edited(rng, base + tail, rng.randrange(1, 5)))
    return sorted(x for x in names if x)


@pytest.mark.parametrize("hot", [4, 60])
def test_fuzzy_self_join_finds_exactly_the_similar_pairs(spark, hot):
    rng = random.Random(7)
    names = some_names(rng, 260)
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    got = {(r.a, r.b): r.distance for r in fuzzy_name_pairs(df, hot=hot).collect()}
    want = {
        (i, j): distance(names[i], names[j])
        for i in range(len(names))
        for j in range(i + 1, len(names))
        if similar(names[i], names[j])
    }
    assert len(want) > 100
    assert got == want


@pytest.mark.parametrize("hot", [5, 200])
def test_fuzzy_join_of_two_tables(spark, hot):
    rng = random.Random(11)
    names = some_names(rng, 200)
    left, right = names[::2], names[1::2] + names[:20]
    a = spark.createDataFrame([(i, n, None) for i, n in enumerate(left)], "id long, nm string, g long")
    b = spark.createDataFrame([(i, n, None) for i, n in enumerate(right)], "id long, nm string, g long")
    got = {(r.a, r.b) for r in fuzzy_name_pairs(a, b, hot=hot).collect()}
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if similar(x, y)}
    assert got == want


def test_one_shared_ending_is_met_in_bounded_cells(spark):
    """Names that all end alike are one hot key on both sides; no cell of its grid is above the block."""
    rng = random.Random(23)
    names = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) + " limited company" for _ in range(330)})
    names += [n[:3] + "zz" + n[5:] for n in names[:40]]
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    rows = df.withColumn("sig", fuzzy.letter_counts("nm"))
    index, probe = fuzzy._cells(fuzzy._cut_index(fuzzy._start_index(rows)), fuzzy._cut_probe(fuzzy._start_probe(rows)), 60)
    whole = index.groupBy("key").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert whole > 300
    cell = ["key", "row", "col"]
    met = index.groupBy(cell).count().join(probe.groupBy(cell).agg(F.count("*").alias("other")), cell)
    assert met.agg(F.max(F.greatest("count", "other"))).first()[0] < 110
    got = {(r.a, r.b) for r in fuzzy_name_pairs(df, block=60).collect()}
    assert got == {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if similar(names[i], names[j])}


def test_meetings_are_tested_on_both_sides_of_the_shared_part(spark):
    """A pair is met at a part with exactly j - 1 errors to its left: one meeting of several is kept, and no pair is lost."""
    rng = random.Random(41)
    names = sorted({"".join(rng.choice("abcd") for _ in range(20)) for _ in range(40)})
    names = sorted({*names, *(edited(rng, n, rng.randrange(1, 4)) for n in names for _ in range(5))})
    rows = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long").withColumn("sig", fuzzy.letter_counts("nm"))
    met = fuzzy._pairs(rows, rows, "(x.s < x.l or x.id < y.id)", 5000, 2000, 1 << 20).collect()
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if similar(names[i], names[j])}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in met} == want
    assert len(met) < 1.5 * len(want)


def framed_names(rng):
    """Names of three frames and of none, with edits inside and outside of their cores."""
    cores = ["".join(rng.choice("abcé𝔘") for _ in range(rng.randrange(1, 10))) for _ in range(110)]
    names = {f(c) for c in cores for f in (lambda c: c + " dental clinic", lambda c: "visit " + c, lambda c: c + " dental clinics")}
    names |= {edited(rng, n, rng.randrange(1, 4)) for n in sorted(names)[::4]}
    names |= {"a" * i + " dental clinic" for i in range(1, 12)} | {"abc" * 6 + e + " dental clinic" for e in "ab"}
    return sorted(n for n in names if n)


@pytest.mark.parametrize("hot", [5, 5000])
def test_names_of_a_frame_are_met_by_the_texts_of_their_cores(spark, hot):
    names = framed_names(random.Random(3))
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    frames = fuzzy._frames(df, 40)
    assert frames.count() == 3 and 150 < fuzzy._framed(df, frames).filter("f is not null").count() < len(names)
    near = {(i, j): distance(names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)) if similar(names[i], names[j])}
    assert len(near) > 300
    got = {(r.a, r.b): r.distance for r in fuzzy_name_pairs(df, hot=hot, block=hot, frame=40).collect()}
    assert got == near
    both = fuzzy_name_pairs(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), hot=hot, block=hot, frame=40, most=2).collect()
    assert {tuple(sorted((r.a, r.b))) for r in both} == {(i, j) for (i, j), d in near.items() if (i + j) % 2 == 1 and d <= 2}


def test_cores_made_into_keys_are_not_sent_to_the_driver(spark):
    names = framed_names(random.Random(3))
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    for pairs in (fuzzy_name_pairs(df, frame=40), fuzzy_name_pairs(df.filter("id % 9 = 0"), df.filter("id % 9 > 0"), frame=10)):
        joins = [x for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "levenshtein(core" in x and "Join" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)


def test_a_crowded_key_of_one_frame_has_no_meetings(spark):
    """All names end alike, so the parts of the ending are keys of all names; before, each such key met all with all."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) + " dental clinic" for _ in range(400)})
    names += ["some other dental clinic", "any more dental clinic"]
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    rows = fuzzy._framed(df, fuzzy._frames(df, 100)).withColumn("sig", fuzzy.letter_counts("nm"))
    index, probe = fuzzy._cut_index(fuzzy._start_index(rows)), fuzzy._cut_probe(fuzzy._start_probe(rows))
    met = lambda x, y: x.groupBy("key").count().join(y.groupBy("key").agg(F.count("*").alias("n")), "key").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert met(index, probe) > 300 * 300
    assert met(*fuzzy._lanes(index, probe, 50)) < 20 * len(names)


def test_letter_counts_never_exceed_the_distance(spark):
    rng = random.Random(31)
    pairs = [(w := "".join(rng.choice("abcxyzé 019") for _ in range(rng.randrange(1, 20))), edited(rng, w, rng.randrange(0, 5))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "nm string, other string").withColumns({"x": fuzzy.letter_counts("nm"), "y": fuzzy.letter_counts("other")})
    gap = df.selectExpr("greatest(bit_count(x & ~y), bit_count(y & ~x)) as gap", "levenshtein(nm, other) as distance")
    assert gap.filter("gap > distance").isEmpty() and not gap.filter("gap = distance and distance > 1").isEmpty()


def test_pairs_inside_one_group_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, "harbour bookshop", 1), (2, "harbour bookshox", 1), (3, "harbor bookshop", 3)], "id long, nm string, g long"
    )
    assert {(r.a, r.b) for r in fuzzy_name_pairs(df).collect()} == {(1, 3), (2, 3)}


def test_components_equal_a_fixpoint(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    label = {n: n for n in [*range(300), *range(400, 441)]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    nodes = spark.createDataFrame([(n,) for n in label], "node long")
    got = connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label


def test_leaders_by_pairs_equal_the_scan(spark):
    rng = random.Random(5)
    pairs = set()
    for _ in range(260):
        a, b = rng.sample(range(200), 2)
        pairs.add((min(a, b), max(a, b)))
    pairs |= {(i, i + 1) for i in range(300, 330)}
    neighbours = {}
    for a, b in pairs:
        neighbours.setdefault(b, []).append(a)
    nodes = [*range(200), *range(300, 331)]
    want, leads = {}, set()
    for n in nodes:
        earlier = [a for a in neighbours.get(n, []) if a in leads]
        want[n] = min(earlier) if earlier else n
        if not earlier:
            leads.add(n)
    got = leaders_by_pairs(
        spark.createDataFrame([(n,) for n in nodes], "node long"),
        spark.createDataFrame(sorted(pairs), "a long, b long"),
    ).collect()
    assert {r.node: r.leader for r in got} == want


def test_leaders_by_keys_equal_the_scan(spark):
    rng = random.Random(9)
    rows = []
    for node in range(300):
        for priority in (1, 2, 3):
            if rng.random() < 0.6:
                rows.append((node, priority, f"{priority}:{rng.randrange(1 + 60 * priority)}"))
    owner, want = {}, {}
    for node in range(300):
        mine = [(p, k) for n, p, k in rows if n == node]
        if not mine:
            continue
        taken = [owner[k] for p, k in sorted(mine) if k in owner]
        want[node] = taken[0] if taken else node
        if not taken:
            owner.update({k: node for _, k in mine})
    got = leaders_by_keys(spark.createDataFrame(rows, "node long, priority int, key string")).collect()
    assert {r.node: r.leader for r in got} == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 links is decided by doubling pointers, for pairs and for keys alike."""
    n, rounds = 10_000, []
    plain = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    ids = spark.range(n)
    pairs = ids.filter("id > 0").selectExpr("id - 1 as a", "id as b")
    got = leaders_by_pairs(ids.toDF("node"), pairs)
    assert got.filter("leader <> node - node % 2").isEmpty() and got.count() == n
    assert len(rounds) < 25
    rounds.clear()
    keys = ids.selectExpr("id as node", "1 as priority", "concat('k', id) as key").union(ids.selectExpr("id", "2", "concat('k', id + 1)"))
    got = leaders_by_keys(keys)
    assert got.filter("leader <> node - node % 2").isEmpty() and got.count() == n
    assert len(rounds) < 25


def test_settled_names_are_not_compared_with_more_errors(spark, monkeypatch):
    """Best company by name as by brute force, while names with an equal or nearest match stay out of the wider pass."""
    from tessera.operators import resolution

    rng = random.Random(41)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30)]
    hosts = [None, "a.in", "b.in", "c.in"]
    companies = [(i, edited(rng, s, rng.randrange(3)) + " dental clinic", None, rng.choice(hosts)) for i, s in enumerate(stems * 3)]
    records = [(1000 + i, edited(rng, s, rng.randrange(4)) + " dental clinic", None, rng.choice(hosts)) for i, s in enumerate(stems * 3)]
    passes = []

    def spy(left, right, **rest):
        passes.append((rest["most"], {r.nm for r in left.select("nm").collect()}))
        return fuzzy_name_pairs(left, right, **rest)

    monkeypatch.setattr(resolution, "fuzzy_name_pairs", spy)
    got = {
        r.record_id: (r.company_id, round(r.confidence, 9))
        for r in resolution.match_existing(
            spark.createDataFrame(records, "record_id long, raw_name string, raw_phone string, raw_website string"),
            spark.createDataFrame(companies, "company_id long, name string, phone string, website_url string"),
        ).collect()
    }
    want = {}
    for record, name, _, host in records:
        found = [(0.9, -c) for c, _, _, h in companies if h == host and host]
        for c, n, _, h in companies:
            if not (h == host and host) and similar(name.strip(), n.strip()):
                found.append((1 - distance(name.strip(), n.strip()) / max(len(name.strip()), len(n.strip())), -c))
        if found:
            best = max(found)
            want[record] = (-best[1], round(best[0], 9))
    assert got == want
    assert [most for most, _ in passes] == [1, 1 << 20]
    alone = {n.strip() for _, n, _, h in records if h is None}
    near = {n for n in alone if any(distance(n, c.strip()) <= 1 for _, c, _, _ in companies)}
    hosted = {n.strip() for _, n, _, h in records if h}
    assert len(near - hosted) > 5 and not (near - hosted) & passes[1][1]


@pytest.mark.parametrize("most", [1, 2])
def test_fuzzy_join_with_fewer_errors(spark, most):
    rng = random.Random(13)
    names = some_names(rng, 160)
    left, right = names[::2], names[1::2]
    a = spark.createDataFrame([(i, n, None) for i, n in enumerate(left)], "id long, nm string, g long")
    b = spark.createDataFrame([(i, n, None) for i, n in enumerate(right)], "id long, nm string, g long")
    got = {(r.a, r.b) for r in fuzzy_name_pairs(a, b, hot=5, most=most).collect()}
    assert got == {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if similar(x, y) and distance(x, y) <= most} and got


def test_rows_that_meet_nothing_are_not_written(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    few, many = [word() for _ in range(5)], [word() for _ in range(400)] + ["".join([word(), word()]) for _ in range(100)]
    many += [edited(rng, x, 1) for x in few]
    rows = lambda names, at: spark.createDataFrame([(at + i, n, None) for i, n in enumerate(names)], "id long, nm string, g long")
    written = []
    cut = fuzzy.cut_lineage
    monkeypatch.setattr(fuzzy, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = {(r.a, r.b) for r in fuzzy_name_pairs(rows(few, 0), rows(many, 1000)).select("a", "b").collect()}
    assert found == {(i, 1000 + j) for i, x in enumerate(few) for j, y in enumerate(many) if similar(x, y)} and found
    keyed = [df for df in written if "key" in df.columns and "e_left" in df.columns]
    assert sum(df.count() for df in keyed) < 2000  # of the many names, those that share a part with one of the few
