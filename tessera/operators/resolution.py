"""Entity resolution: duplicates, merged records, identities, matches against known companies.

Records carry ``record_id`` (unique, ascending in scan order), ``source``, ``raw_name``, ``raw_phone``,
``raw_email``, ``raw_website``, ``raw_address``, ``gstin``, ``cin`` and ``quality_score``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import address_hash, fold_name, host_key, name_key, phone_key, present
from tessera.operators.fuzzy import fuzzy_name_pairs
from tessera.operators.graphs import connected_components, leaders_by_keys, leaders_by_pairs
from tessera.operators.skew import best_per
from tessera.session import cut_lineage


def canonical_score() -> Column:
    """Quality, then website, email and phone as tie-breakers, in whole tenths."""
    return (
        F.coalesce(F.col("quality_score"), F.lit(0)).cast("long") * 10
        + F.when(present("raw_website"), 4).otherwise(0)
        + F.when(present("raw_email"), 3).otherwise(0)
        + F.when(present("raw_phone"), 2).otherwise(0)
    )


def elect_canonical(members: DataFrame, group: str) -> DataFrame:
    """(group, canonical, members): the record that stands for each group, earliest on ties."""
    return members.groupBy(group).agg(
        F.max_by("record_id", F.struct(canonical_score(), -F.col("record_id"))).alias("canonical"),
        F.count(F.lit(1)).alias("members"),
    )


def _pairs_of_groups(members: DataFrame, group: str, label: str) -> DataFrame:
    """(record_id, duplicate_of, pass) for every member of a group of two or more, canonicals included."""
    elected = elect_canonical(members, group).filter("members > 1").drop("members")
    return members.select("record_id", group).join(elected, group).select(
        "record_id", F.col("canonical").alias("duplicate_of"), F.lit(label).alias("pass")
    )


def exact_duplicate_groups(records: DataFrame) -> DataFrame:
    """Members of phone groups, then of host groups among the rest, with their canonical record."""
    keyed = records.withColumns({"phone_key": phone_key("raw_phone"), "host_key": host_key("raw_website")})
    by_phone = _pairs_of_groups(keyed.filter("phone_key is not null"), "phone_key", "phone")
    rest = keyed.filter("host_key is not null").join(by_phone.select("record_id"), "record_id", "left_anti")
    return by_phone.unionByName(_pairs_of_groups(rest, "host_key", "host"))


def exact_dedup_pairs(records: DataFrame) -> DataFrame:
    """(record_id, duplicate_of, pass) from the two equality passes."""
    return exact_duplicate_groups(records).filter("record_id <> duplicate_of")


def dedup_pairs(records: DataFrame) -> DataFrame:
    """(record_id, duplicate_of, pass) from three passes: same phone, same host, similar name.

    The name pass is a greedy scan in record order over what the first two left. Records with equal
    names have the same neighbours, so the scan runs over distinct names, each at its first place.
    """
    exact = cut_lineage(exact_duplicate_groups(records))
    rest = records.join(exact.select("record_id"), "record_id", "left_anti").withColumn("fold", fold_name("raw_name"))
    rest = cut_lineage(rest.filter("fold is not null"))
    names = rest.groupBy("fold").agg(F.min("record_id").alias("node"))
    pairs = fuzzy_name_pairs(names.select(F.col("node").alias("id"), F.col("fold").alias("nm"), F.lit(None).cast("long").alias("g")))
    leaders = leaders_by_pairs(names.select("node"), pairs)
    grouped = rest.join(names.join(leaders, "node").select("fold", "leader"), "fold")
    by_name = _pairs_of_groups(grouped, "leader", "name")
    return exact.unionByName(by_name).filter("record_id <> duplicate_of")


def apply_dedup(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records marked with ``is_duplicate`` and ``duplicate_of``."""
    marks = pairs.select("record_id", "duplicate_of")
    return records.join(marks, "record_id", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def dedup_counts(marked: DataFrame) -> DataFrame:
    """Raw and unique record counts of a marked load."""
    return marked.agg(
        F.count(F.lit(1)).alias("total_raw"), F.count_if(~F.col("is_duplicate")).alias("total_after_dedup")
    )


def merge_sources(records: DataFrame) -> DataFrame:
    """One record per business across sources.

    A record is a duplicate of the earliest kept record with its phone, else its host, else its name
    key. The kept record takes the first phone, website, address and email of its duplicates where it
    has none, and 5 quality points per duplicate, up to 100. Filled-in values are not matched on again.
    """
    keys = records.select(
        F.col("record_id").alias("node"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("priority"), F.concat(F.lit("p:"), phone_key("raw_phone", 10)).alias("key")),
                F.struct(F.lit(2).alias("priority"), F.concat(F.lit("h:"), host_key("raw_website")).alias("key")),
                F.struct(F.lit(3).alias("priority"), F.concat(F.lit("n:"), name_key("raw_name")).alias("key")),
            )
        ).alias("k"),
    ).select("node", "k.priority", "k.key").filter("key is not null")
    leader = leaders_by_keys(keys)
    placed = records.join(leader, records["record_id"] == leader["node"], "left").drop("node").withColumn(
        "leader", F.coalesce("leader", "record_id")
    )

    def first_filled(name: str) -> Column:
        return F.min_by(name, F.when(present(name), F.col("record_id"))).alias(name)

    own = F.when(F.col("record_id") == F.col("leader"), F.col("quality_score"))
    merged = placed.groupBy("leader").agg(
        *[first_filled(c) for c in ("raw_phone", "raw_website", "raw_address", "raw_email")],
        F.max(own).alias("own_quality"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
    )
    kept = records.drop("raw_phone", "raw_website", "raw_address", "raw_email", "quality_score")
    quality = F.when(F.col("duplicates") == 0, F.col("own_quality")).otherwise(
        F.least(F.lit(100), F.col("own_quality") + 5 * F.col("duplicates"))
    )
    return (
        kept.join(merged, kept["record_id"] == merged["leader"])
        .withColumn("quality_score", quality.cast("int"))
        .select(*records.columns, "duplicates")
    )


IDENTITY_KEYS = {"p:": "phone_key", "h:": "host_key", "g:": "gstin", "c:": "cin", "n:": "name_key", "a:": "address_key"}


def _identity_keys(records: DataFrame) -> DataFrame:
    return records.select(
        "record_id",
        "source",
        F.col("quality_score").cast("double").alias("quality_score"),
        phone_key("raw_phone", 10).alias("phone_key"),
        host_key("raw_website").alias("host_key"),
        F.nullif("gstin", F.lit("")).alias("gstin"),
        F.nullif("cin", F.lit("")).alias("cin"),
        name_key("raw_name").alias("name_key"),
        address_hash("raw_address").alias("address_key"),
    )


def _star_edges(keyed: DataFrame) -> DataFrame:
    """Each record linked to the first record with one of its keys: n - 1 edges per key, never n * n."""
    long = keyed.select(
        "record_id",
        F.explode(F.array(*[F.concat(F.lit(tag), F.col(c)) for tag, c in IDENTITY_KEYS.items()])).alias("key"),
    ).filter("key is not null")
    first = long.groupBy("key").agg(F.min("record_id").alias("first"))
    # Spark takes the keys for as small as the records they are made of, so without the hint they are sent to the driver as a broadcast
    return long.hint("merge").join(first, "key").filter("record_id <> first").select(
        F.col("record_id").alias("a"), F.col("first").alias("b")
    )


def resolve_by_keys(records: DataFrame) -> DataFrame:
    """(record_id, identity_id) from equal keys alone."""
    # read for the nodes and twice for the edges, so the keys are made and written once
    keyed = cut_lineage(_identity_keys(records))
    nodes = keyed.select(F.col("record_id").alias("node"))
    return connected_components(nodes, _star_edges(keyed)).select(
        F.col("node").alias("record_id"), F.col("component").alias("identity_id")
    )


def resolve_identities(records: DataFrame) -> DataFrame:
    """(record_id, identity_id): records closed under equal phone, host, tax id, company id, address
    and under equal or similar name keys.

    Equal keys are closed first; names are then compared only between different groups, and the groups
    themselves are closed over the similar pairs.
    """
    keyed = cut_lineage(_identity_keys(records))
    nodes = keyed.select(F.col("record_id").alias("node"))
    exact = cut_lineage(connected_components(nodes, _star_edges(keyed)))
    named = keyed.filter("name_key is not null").join(exact, keyed["record_id"] == exact["node"])
    names = named.groupBy(F.col("name_key").alias("nm")).agg(F.min("record_id").alias("id"), F.min("component").alias("g"))
    names = cut_lineage(names)
    pairs = fuzzy_name_pairs(names)
    group = names.select("id", "g")
    links = (
        pairs.join(group.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a")
        .join(group.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
        .select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        .distinct()
    )
    groups = exact.select(F.col("component").alias("node")).distinct()
    closed = connected_components(groups, links).select(
        F.col("node").alias("component"), F.col("component").alias("identity_id")
    )
    return exact.join(closed, "component").select(F.col("node").alias("record_id"), "identity_id")


def identities(records: DataFrame, members: DataFrame) -> DataFrame:
    """One row per identity: first key of each kind, the best record's name, its sources, a confidence."""
    m = _identity_keys(records).join(members, "record_id")

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("record_id"))).alias(name)

    rolled = m.groupBy("identity_id").agg(
        F.max_by("name_key", F.struct("quality_score", -F.col("record_id"))).alias("normalized_name"),
        *[first(c) for c in ("phone_key", "host_key", "address_key", "gstin", "cin")],
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count(F.lit(1)).alias("records"),
    )
    confidence = (
        F.lit(50)
        + F.when(F.col("phone_key").isNotNull(), 30).otherwise(0)
        + F.when(F.col("host_key").isNotNull(), 15).otherwise(0)
        + F.when(F.size("sources") > 1, 10).otherwise(0)
        + F.when(F.col("gstin").isNotNull(), 5).otherwise(0)
        + F.when(F.col("cin").isNotNull(), 5).otherwise(0)
    )
    return rolled.withColumns(
        {
            "source_count": F.size("sources"),
            "identity_confidence": F.least(F.lit(100), confidence).cast("double"),
        }
    )


def best_record(records: DataFrame, members: DataFrame) -> DataFrame:
    """The highest-quality record of each identity, earliest on ties."""
    joined = records.join(members, "record_id")
    return best_per(joined, ["identity_id"], [F.col("quality_score"), -F.col("record_id")])


# Points by source of a website candidate.
WEBSITE_SOURCE_POINTS = {"google_maps": 20, "duckduckgo": 15, "website_search": 10}


def best_website(records: DataFrame, members: DataFrame) -> DataFrame:
    """The best-scored website of each identity.

    Points for the source, for https, and for sharing phone or address with the identity's first
    map-listing record; earliest on ties.
    """
    joined = records.join(members, "record_id").withColumns(
        {"phone_key": phone_key("raw_phone", 10), "address_key": address_hash("raw_address")}
    )
    listing = F.when(F.col("source") == "google_maps", F.col("record_id"))
    anchors = joined.groupBy("identity_id").agg(
        F.min_by(F.struct("phone_key", "address_key"), listing).alias("anchor")
    )
    source_points = F.lit(0)
    for source, value in WEBSITE_SOURCE_POINTS.items():
        source_points = F.when(F.col("source") == source, value).otherwise(source_points)
    score = (
        source_points
        + F.when(F.col("raw_website").startswith("https://"), 10).otherwise(0)
        + F.when(F.col("phone_key") == F.col("anchor.phone_key"), 25).otherwise(0)
        + F.when(F.col("address_key") == F.col("anchor.address_key"), 20).otherwise(0)
    )
    scored = joined.filter(present("raw_website")).join(anchors, "identity_id").withColumn("website_score", score)
    slim = scored.select("identity_id", "record_id", "source", "raw_website", "website_score")
    return best_per(slim, ["identity_id"], [F.col("website_score"), -F.col("record_id")])


def match_existing(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(record_id, company_id, confidence, reason): the best known company for each record.

    Equal phone 1.0, equal host 0.9, otherwise name similarity; only 0.85 or more counts. The best
    confidence wins, the earliest company on ties, and a company equal on host is not judged by name.

    Only the earliest company per phone or host can win, and per record name only the best company
    and the best one on another host, so shared keys never multiply records by companies.
    """
    # narrow and read many times below, so both are written once
    r = records.select(
        "record_id", phone_key("raw_phone").alias("phone"), host_key("raw_website").alias("host"), fold_name("raw_name").alias("fold")
    )
    c = companies.select(
        "company_id", phone_key("phone").alias("phone"), host_key("website_url").alias("host"), fold_name("name").alias("fold")
    )
    r, c = cut_lineage(r), cut_lineage(c)
    by_phone = r.join(
        c.filter("phone is not null").groupBy("phone").agg(F.min("company_id").alias("company_id")), "phone"
    ).select("record_id", "company_id", F.lit(1.0).alias("confidence"), F.lit(3).alias("rank"))
    by_phone = cut_lineage(by_phone)
    by_host = r.join(
        c.filter("host is not null").groupBy("host").agg(F.min("company_id").alias("company_id")), "host"
    ).select("record_id", "company_id", F.lit(0.9).alias("confidence"), F.lit(2).alias("rank"))

    places = c.filter("fold is not null").groupBy("fold", "host").agg(F.min("company_id").alias("company_id"))
    names_c = places.groupBy("fold").agg(F.min("company_id").alias("id"))
    equal = (
        r.filter("fold is not null").select(F.col("fold").alias("name")).distinct()
        .join(places.withColumnRenamed("fold", "name"), "name")
        .select("name", "company_id", "host", F.lit(1.0).alias("confidence"))
    )
    offers = cut_lineage(equal)
    names_c = cut_lineage(names_c)
    nothing = F.lit(None).cast("long").alias("g")
    # a phone match can only be beaten by an equal name, so similar names are sought for the others
    open_names = cut_lineage(r.filter("fold is not null").join(by_phone.select("record_id"), "record_id", "left_anti"))
    # an equal name beats all others, and one error any two (a longer name is at most 20/17 of this one), so names whose
    # records all have such an offer are settled: only the rest is compared with more errors allowed
    for most in (1, 1 << 20):
        rest = open_names.join(_by_name(open_names, offers).select("record_id"), "record_id", "left_anti")
        names_r = cut_lineage(rest.groupBy("fold").agg(F.min("record_id").alias("id")))
        pairs = fuzzy_name_pairs(
            names_r.select("id", F.col("fold").alias("nm"), nothing), names_c.select("id", F.col("fold").alias("nm"), nothing), most=most
        )
        similar = (
            pairs.join(names_r.select(F.col("id").alias("a"), F.col("fold").alias("name")), "a")
            .join(names_c.select(F.col("id").alias("b"), F.col("fold").alias("company_name")), "b")
            .join(places.withColumnRenamed("fold", "company_name"), "company_name")
            .select("name", "company_id", "host", (1 - F.col("distance") / F.col("longer")).alias("confidence"))
        )
        # read twice below; names met in both passes do no harm
        offers = cut_lineage(offers.unionByName(similar))
    by_name = _by_name(r, offers)
    found = by_phone.unionByName(by_host).unionByName(by_name)
    best = best_per(found, ["record_id"], [F.col("confidence"), -F.col("company_id"), F.col("rank")])
    return best.select("record_id", "company_id", "confidence", _reason(F.col("rank")).alias("reason"))


def _by_name(records: DataFrame, offers: DataFrame) -> DataFrame:
    """(record_id, company_id, confidence, rank): the best offer for a record's name from a company on another host."""
    order = F.struct("confidence", -F.col("company_id"))
    offer = F.struct("company_id", "host", "confidence")
    first = offers.groupBy("name").agg(F.max_by(offer, order).alias("first"))
    elsewhere = offers.join(first, "name").filter("not (host <=> first.host)")
    second = elsewhere.groupBy("name").agg(F.max_by(offer, order).alias("second"))
    options = first.join(second, "name", "left")
    chosen = F.when(F.col("host").eqNullSafe(F.col("first.host")) & F.col("host").isNotNull(), F.col("second")).otherwise(
        F.col("first")
    )
    return (
        records.join(options, records["fold"] == options["name"])
        .select("record_id", chosen.alias("o"))
        .filter("o is not null")
        .select("record_id", "o.company_id", "o.confidence", F.lit(1).alias("rank"))
    )


def _reason(rank: Column) -> Column:
    return (
        F.when(rank == 3, "Exact Phone Match").when(rank == 2, "Exact Domain Match").otherwise("Fuzzy Name Match")
    )


def lookup_identity(records: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id, identity_id, matched_on): first hit in the order phone, host, tax id, company id, name.

    A name hit needs similarity 0.85 and the known name to contain the record name's first ten letters.
    ``known`` is shaped like the result of :func:`identities`.
    """
    # read three times and twice below, so both are written once
    keyed, known = cut_lineage(_identity_keys(records)), cut_lineage(known.select("identity_id", "normalized_name", "phone_key", "host_key", "gstin", "cin"))
    kinds = {1: "phone_key", 2: "host_key", 3: "gstin", 4: "cin"}

    def melt(df: DataFrame, key: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(p).alias("priority"), F.col(c).alias("key")) for p, c in kinds.items()])
        return df.select(key, F.explode(rows).alias("k")).select(key, "k.priority", "k.key").filter("key is not null")

    owners = melt(known, "identity_id").groupBy("priority", "key").agg(F.min("identity_id").alias("identity_id"))
    by_key = melt(keyed, "record_id").join(owners, ["priority", "key"]).select("record_id", "identity_id", "priority")
    exact = best_per(by_key, ["record_id"], [F.col("priority"), F.col("identity_id")], largest=False)

    rest = keyed.join(exact.select("record_id"), "record_id", "left_anti").filter("name_key is not null")
    nothing = F.lit(None).cast("long").alias("g")
    names_r = rest.groupBy(F.col("name_key").alias("nm")).agg(F.min("record_id").alias("id"))
    names_k = known.filter("normalized_name is not null").groupBy(F.col("normalized_name").alias("nm")).agg(
        F.min("identity_id").alias("id")
    )
    pairs = fuzzy_name_pairs(names_r.select("id", "nm", nothing), names_k.select("id", "nm", nothing))
    hits = (
        pairs.join(names_r.select(F.col("id").alias("a"), F.col("nm").alias("name")), "a")
        .join(names_k.select(F.col("id").alias("b"), F.col("nm").alias("known_name")), "b")
        .filter(F.expr("contains(known_name, substring(name, 1, 10))"))
        .groupBy("name").agg(F.min("b").alias("identity_id"))
    )
    by_name = rest.join(hits, rest["name_key"] == hits["name"]).select("record_id", "identity_id", F.lit(5).alias("priority"))
    labels = F.element_at(F.array(*[F.lit(x) for x in ("phone", "host", "gstin", "cin", "name")]), F.col("priority"))
    return exact.unionByName(by_name).select("record_id", "identity_id", labels.alias("matched_on"))


def upsert_identities(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The identity table after a batch: matched rows add one to the count per record, join their
    sources and keep the higher confidence; the rest are resolved among themselves and inserted."""
    batch = cut_lineage(batch)
    hits = cut_lineage(lookup_identity(batch, known))
    fresh = batch.join(hits, "record_id", "left_anti")
    new = identities(fresh, resolve_identities(fresh))
    single = _identity_keys(batch).join(hits, "record_id")
    per_identity = single.groupBy("identity_id").agg(
        F.count(F.lit(1)).alias("added"),
        F.collect_set("source").alias("new_sources"),
        F.max(
            F.least(
                F.lit(100),
                F.lit(50)
                + F.when(F.col("phone_key").isNotNull(), 30).otherwise(0)
                + F.when(F.col("host_key").isNotNull(), 15).otherwise(0)
                + F.when(F.col("gstin").isNotNull(), 5).otherwise(0)
                + F.when(F.col("cin").isNotNull(), 5).otherwise(0),
            )
        ).alias("new_confidence"),
    )
    columns = known.columns
    updated = (
        known.join(per_identity, "identity_id", "left")
        .withColumns(
            {
                "source_count": (F.col("source_count") + F.coalesce("added", F.lit(0))).cast("int"),
                "sources": F.array_sort(F.array_union("sources", F.coalesce("new_sources", F.array().cast("array<string>")))),
                "identity_confidence": F.greatest("identity_confidence", F.col("new_confidence").cast("double")),
                "records": F.col("records") + F.coalesce("added", F.lit(0)),
            }
        )
        .select(*columns)
    )
    return updated.unionByName(new.select(*columns))


def ingest_results(results: DataFrame, companies: DataFrame) -> DataFrame:
    """Load flow over one batch: (record_id, company_id, new_company_of, result_type, confidence, reason).

    Duplicates are set aside; every other record takes its best match among the known companies and
    the companies opened by earlier records of the batch, or opens one itself. Opening records are the
    greedy leaders of the records without a known match, under equal phone, host or similar names.
    """
    marked = apply_dedup(results, dedup_pairs(results))
    unique = cut_lineage(marked.filter("not is_duplicate").drop("is_duplicate", "duplicate_of"))
    known = cut_lineage(match_existing(unique, companies))
    keyed = unique.select(
        "record_id", phone_key("raw_phone").alias("phone"), host_key("raw_website").alias("host"), fold_name("raw_name").alias("fold")
    )
    keyed = cut_lineage(keyed)
    open_records = cut_lineage(keyed.join(known.select("record_id"), "record_id", "left_anti"))
    names = open_records.filter("fold is not null").groupBy(F.col("fold").alias("nm")).agg(F.min("record_id").alias("id"))
    pairs = cut_lineage(fuzzy_name_pairs(names.select("id", "nm", F.lit(None).cast("long").alias("g"))))
    # a similar pair of names is one more key that both sides share
    pair_key = F.concat(F.lit("s:"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))
    sides = pairs.select(F.col("a").alias("id"), pair_key.alias("key")).unionByName(
        pairs.select(F.col("b").alias("id"), pair_key.alias("key"))
    )
    by_name = open_records.join(names, open_records["fold"] == names["nm"]).join(sides, "id").select("record_id", "key")
    own = open_records.select(
        "record_id",
        F.explode(
            F.array(
                F.concat(F.lit("p:"), F.col("phone")), F.concat(F.lit("h:"), F.col("host")), F.concat(F.lit("n:"), F.col("fold"))
            )
        ).alias("key"),
    ).filter("key is not null")
    keys = own.unionByName(by_name).select(F.col("record_id").alias("node"), F.lit(1).alias("priority"), "key")
    led = leaders_by_keys(keys)
    followers = led.filter("node <> leader").select(F.col("node").alias("record_id"))
    opened = cut_lineage(open_records.join(followers, "record_id", "left_anti"))

    # leaders differ in phone, host and name, so each key names at most one of them
    later = cut_lineage(keyed.join(opened.select("record_id"), "record_id", "left_anti"))
    by_phone = later.join(opened.select("phone", F.col("record_id").alias("leader")), "phone").select(
        "record_id", "leader", F.lit(1.0).alias("confidence"), F.lit(3).alias("rank")
    )
    by_host = later.join(opened.select("host", F.col("record_id").alias("leader")), "host").select(
        "record_id", "leader", F.lit(0.9).alias("confidence"), F.lit(2).alias("rank")
    )
    names_l = later.filter("fold is not null").groupBy(F.col("fold").alias("nm")).agg(F.min("record_id").alias("id"))
    names_o = opened.filter("fold is not null").select(F.col("record_id").alias("id"), F.col("fold").alias("nm"))
    nothing = F.lit(None).cast("long").alias("g")
    similar = fuzzy_name_pairs(names_l.select("id", "nm", nothing), names_o.select("id", "nm", nothing))
    by_similar = (
        similar.join(names_l.select(F.col("id").alias("a"), "nm"), "a")
        .join(later, F.col("nm") == F.col("fold"))
        .select("record_id", F.col("b").alias("leader"), (1 - F.col("distance") / F.col("longer")).alias("confidence"), F.lit(1).alias("rank"))
    )
    offers = by_phone.unionByName(by_host).unionByName(by_similar).filter("leader < record_id")
    # one verdict per (record, leader): phone before host before name
    offers = best_per(offers, ["record_id", "leader"], [F.col("rank")])
    inside = offers.select(
        "record_id", F.lit(None).cast("long").alias("company_id"), F.col("leader").alias("new_company_of"), "confidence", "rank"
    )
    rank = F.when(F.col("reason") == "Exact Phone Match", 3).when(F.col("reason") == "Exact Domain Match", 2).otherwise(1)
    outside = known.select(
        "record_id", "company_id", F.lit(None).cast("long").alias("new_company_of"), "confidence", rank.alias("rank")
    )
    # on equal confidence a known company comes before one opened in this batch
    best = best_per(
        inside.unionByName(outside),
        ["record_id"],
        [F.col("confidence"), F.col("company_id").isNotNull(), -F.coalesce("company_id", "new_company_of")],
    )
    matched = best.select(
        "record_id", "company_id", "new_company_of", F.lit("EXISTING").alias("result_type"), "confidence", _reason(F.col("rank")).alias("reason")
    )
    created = opened.select(
        "record_id",
        F.lit(None).cast("long").alias("company_id"),
        F.col("record_id").alias("new_company_of"),
        F.lit("NEW").alias("result_type"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
    )
    return matched.unionByName(created)


def skip_reasons(load: DataFrame) -> DataFrame:
    """How many records of a load were linked rather than created, by reason."""
    return load.filter("result_type = 'EXISTING'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def link_companies(records: DataFrame, members: DataFrame) -> DataFrame:
    """The identity of each company's highest-quality record."""
    joined = records.filter("company_id is not null").join(members, "record_id")
    return joined.groupBy("company_id").agg(
        F.max_by("identity_id", F.struct("quality_score", -F.col("record_id"))).alias("identity_id")
    )


def promote_results(results: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """Chosen raw results become work: those without a company open one; all companies are listed.

    Gives ``companies`` (new rows), ``links`` (result to new company) and ``work_list``.
    """
    picked = results.join(chosen.select("record_id").distinct(), "record_id", "left_semi")
    unlinked = picked.filter("company_id is null")
    new_id = F.concat(F.lit("r"), F.col("record_id").cast("string"))
    companies = unlinked.select(
        new_id.alias("company_key"),
        F.coalesce(F.nullif("raw_name", F.lit("")), F.lit("Unknown")).alias("name"),
        F.col("raw_website").alias("website_url"),
        F.col("raw_phone").alias("phone"),
        F.lit("prospect").alias("status"),
        F.col("job_id").alias("discovery_job_id"),
        F.col("source").alias("discovery_source"),
    )
    links = unlinked.select("record_id", new_id.alias("company_key"))
    existing = picked.filter("company_id is not null").select(F.col("company_id").cast("string").alias("company_key"))
    work = existing.unionByName(links.select("company_key")).distinct()
    return {"companies": companies, "links": links, "work_list": work}


def merge_contacts(candidates: DataFrame) -> DataFrame:
    """Contacts of a company with the same name, ignoring case, as one row.

    The longer name and title win (the later on ties), the first e-mail, phone and profile link are kept, scores take
    their maximum and reasons are joined without repeats.
    """

    def first(name: str) -> Column:
        return F.min_by(name, F.when(present(name), F.col("seq"))).alias(name)

    def longest(name: str) -> Column:
        return F.max_by(name, F.struct(F.length(name), F.col("seq"))).alias(name)

    reason = candidates.select(
        "company_id", F.lower("name").alias("name_key"), "seq", F.posexplode("reasons").alias("pos", "reason")
    )
    reason = reason.groupBy("company_id", "name_key", "reason").agg(F.min(F.struct("seq", "pos")).alias("at"))
    # distinct reasons of one person come from a fixed rule set, so the list is short
    reasons = reason.groupBy("company_id", "name_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("reasons")
    )
    rolled = candidates.groupBy("company_id", F.lower("name").alias("name_key")).agg(
        longest("name"),
        longest("title"),
        first("email"),
        first("phone"),
        first("linkedin_url"),
        F.max("confidence_score").alias("confidence_score"),
        F.max("decision_maker_score").alias("decision_maker_score"),
    )
    return rolled.join(reasons, ["company_id", "name_key"], "left")


def merge_profiles(contacts: DataFrame) -> DataFrame:
    """Profiles with the same link (else the same name) as one row.

    The first one of highest confidence is kept; if it has no title, the first title after it fills in.
    """
    keyed = contacts.withColumn("profile_key", F.coalesce(F.nullif("linkedin_url", F.lit("")), F.lower("full_name")))
    keyed = keyed.filter(present("profile_key"))
    kept = best_per(keyed, ["profile_key"], [F.col("confidence"), -F.col("seq")])
    later = (
        keyed.filter(present("title"))
        .join(kept.select("profile_key", F.col("seq").alias("kept_seq")), "profile_key")
        .filter("seq > kept_seq")
        .groupBy("profile_key")
        .agg(F.min_by("title", "seq").alias("later_title"))
    )
    title = F.coalesce(F.nullif("title", F.lit("")), "later_title")
    return kept.join(later, "profile_key", "left").withColumn("title", title).select(
        "profile_key", "full_name", "title", "confidence"
    )
