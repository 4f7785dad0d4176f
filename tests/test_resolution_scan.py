"""Order-dependent jobs against a plain scan over small random records."""
import random
import re

from tests.test_goldens import RECORD, records
from tests.test_matching_core import distance, edited

from tessera.functions.keys import SUFFIX_PATTERN
from tessera.operators import resolution as res


def some_records(seed, n, first=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 12))) for _ in range(n // 3)]
    out = []
    for i in range(first, first + n):
        name = edited(rng, rng.choice(stems), rng.randrange(0, 3)) + rng.choice(["", " dental clinic", " books"])
        out.append(
            {
                "record_id": i,
                "source": rng.choice(["google_maps", "justdial", "mca"]),
                "raw_name": rng.choice([name, name, name, None]),
                "raw_phone": rng.choice([None, None, f"98765{rng.randrange(n // 3):05d}"]),
                "raw_website": rng.choice([None, None, f"https://www.site{rng.randrange(n // 3)}.in/x"]),
                "raw_email": rng.choice([None, "a@b.in"]),
                "quality_score": rng.randrange(0, 100),
            }
        )
    return out


def phone(r):
    return (r.get("raw_phone") or r.get("phone") or "")[-10:] or None


def host(r):
    found = re.match(r"https://www\.([^/]+)", r.get("raw_website") or r.get("website_url") or "")
    return found.group(1) if found else None


def similarity(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0


def elect(group):
    return max(
        group,
        key=lambda r: (
            r["quality_score"] * 10 + 4 * bool(r["raw_website"]) + 3 * bool(r["raw_email"]) + 2 * bool(r["raw_phone"]),
            -r["record_id"],
        ),
    )["record_id"]


def scan_duplicates(rows):
    pairs, left = {}, list(rows)
    for key in (phone, host):
        groups = {}
        for r in left:
            if key(r):
                groups.setdefault(key(r), []).append(r)
        for g in groups.values():
            if len(g) > 1:
                best = elect(g)
                pairs.update({r["record_id"]: best for r in g if r["record_id"] != best})
                left = [r for r in left if r not in g]
    taken = set()
    for i, a in enumerate(left):
        if a["record_id"] in taken or not a["raw_name"]:
            continue
        g = [a] + [
            b for b in left[i + 1 :]
            if b["record_id"] not in taken and b["raw_name"] and similarity(a["raw_name"], b["raw_name"]) >= 0.85 - 1e-12
        ]
        if len(g) > 1:
            best = elect(g)
            taken |= {r["record_id"] for r in g}
            pairs.update({r["record_id"]: best for r in g if r["record_id"] != best})
    return pairs


def test_three_pass_duplicates_equal_the_scan(spark):
    rows = some_records(4, 150)
    got = {r.record_id: r.duplicate_of for r in res.dedup_pairs(records(spark, *rows)).collect()}
    want = scan_duplicates(rows)
    assert len(want) > 40
    assert got == want


def name_key(r):
    n = re.sub(SUFFIX_PATTERN, "", (r["raw_name"] or "").lower().strip()).strip()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", n)).strip() or None


def test_merge_equals_the_scan(spark):
    rows = some_records(8, 150)
    seen, kept = {}, {}
    for r in rows:
        keys = [(i, k) for i, k in enumerate((phone(r), host(r), name_key(r))) if k]
        owner = next((seen[k] for k in keys if k in seen), None)
        if owner is None:
            kept[r["record_id"]] = dict(r, n=0)
            seen.update({k: r["record_id"] for k in keys})
            continue
        o = kept[owner]
        for f in ("raw_phone", "raw_website", "raw_email"):
            o[f] = o[f] or r[f]
        o["quality_score"], o["n"] = min(100, o["quality_score"] + 5), o["n"] + 1
    got = {
        r.record_id: (r.raw_phone, r.raw_website, r.raw_email, r.quality_score, r.duplicates)
        for r in res.merge_sources(records(spark, *rows)).collect()
    }
    assert got == {k: (o["raw_phone"], o["raw_website"], o["raw_email"], o["quality_score"], o["n"]) for k, o in kept.items()}


def test_ingest_equals_the_scan(spark):
    rows = some_records(15, 120)
    known = [
        {"company_id": i, "name": r["raw_name"] or "Zz", "phone": r["raw_phone"], "website_url": r["raw_website"]}
        for i, r in enumerate(some_records(16, 25) + rows[5:60:6], 1)
    ]
    dropped = set(scan_duplicates(rows))
    pool = [("known", c["company_id"], c["name"], phone(c), host(c)) for c in known]
    want = {}
    for r in rows:
        if r["record_id"] in dropped:
            continue
        best = None
        for kind, key, name, p, h in pool:
            if phone(r) and phone(r) == p:
                c = 1.0
            elif host(r) and host(r) == h:
                c = 0.9
            else:
                c = similarity(r["raw_name"] or "", name or "")
            if c >= 0.85 - 1e-12 and (best is None or c > best[0] + 1e-12):
                best = (c, kind, key)
        if best:
            want[r["record_id"]] = ("EXISTING", best[1], best[2])
        else:
            want[r["record_id"]] = ("NEW", "batch", r["record_id"])
            pool.append(("batch", r["record_id"], r["raw_name"], phone(r), host(r)))
    companies = spark.createDataFrame(
        [(c["company_id"], c["name"], c["phone"], c["website_url"]) for c in known], "company_id long, name string, phone string, website_url string"
    )
    got = {
        r.record_id: (r.result_type, "known" if r.company_id is not None else "batch", r.company_id if r.company_id is not None else r.new_company_of)
        for r in res.ingest_results(records(spark, *rows), companies).collect()
    }
    assert got == want


def test_keys_of_identities_are_made_once(spark):
    """Before, nodes and edges each made the keys of all records again."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def seen(name):
        made.add(1)
        return name

    rows = records(spark, *some_records(4, 40)).localCheckpoint()
    counted = rows.withColumn("raw_name", F.udf(seen, "string")("raw_name"))
    assert res.resolve_by_keys(counted).count() == 40
    assert made.value == 40


def test_keys_of_records_are_not_sent_to_the_driver(spark):
    edges = res._star_edges(res.cut_lineage(res._identity_keys(records(spark, *some_records(2, 40)))))
    joins = [x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
