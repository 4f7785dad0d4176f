"""Hand-made rows with hand-worked results."""
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import extraction as ext
from tessera.operators import filters as flt
from tessera.operators import fusion, projections as prj, resolution as res, scoring
from tessera.sources import dumps, sinks
from tessera.sources.pages import page_nodes

RECORD = (
    "record_id long, source string, raw_name string, raw_phone string, raw_email string, raw_website string, raw_address string, "
    "gstin string, cin string, quality_score int"
)


def records(spark, *rows):
    names = [f.split()[0] for f in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORD)


def pairs(df):
    return {(r.record_id, r.duplicate_of, r["pass"]) for r in df.collect()}


def test_duplicates_by_phone_name_and_completeness(spark):
    by_phone = records(
        spark,
        {"record_id": 1, "source": "google_maps", "raw_name": "Test Co", "raw_phone": "+1 (555) 123-4567"},
        {"record_id": 2, "source": "justdial", "raw_name": "Test Company", "raw_phone": "5551234567"},
        {"record_id": 3, "source": "indiamart", "raw_name": "Other Co", "raw_phone": "9999999999"},
    )
    assert pairs(res.dedup_pairs(by_phone)) == {(2, 1, "phone")}
    by_name = records(
        spark,
        {"record_id": 1, "raw_name": "Dr. Smith Dental Clinic"},
        {"record_id": 2, "raw_name": "Dr Smith Dental Clinic"},
        {"record_id": 3, "raw_name": "Completely Different Name"},
    )
    assert pairs(res.dedup_pairs(by_name)) == {(2, 1, "name")}
    fuller = records(
        spark,
        {"record_id": 1, "raw_name": "Test Co", "raw_phone": "5551234567"},
        {"record_id": 2, "raw_name": "Test Co", "raw_phone": "5551234567", "raw_website": "test.com", "raw_email": "hello@test.com"},
    )
    assert pairs(res.dedup_pairs(fuller)) == {(1, 2, "phone")}
    assert pairs(res.dedup_pairs(records(spark))) == set()


def test_identities_close_over_all_keys(spark):
    rows = records(
        spark,
        {"record_id": 0, "source": "google_maps", "raw_name": "ABC Dental Clinic", "raw_phone": "9876543210", "quality_score": 70},
        {"record_id": 1, "source": "duckduckgo", "raw_name": "Alpha Smiles", "raw_phone": "+91-98765-43210", "raw_website": "https://abcdental.in/contact", "quality_score": 50},
        {"record_id": 2, "source": "grotal", "raw_name": "Zeta", "raw_website": "www.abcdental.in", "quality_score": 10},
        {"record_id": 3, "source": "zauba", "raw_name": "ABC Dental Pvt Ltd", "quality_score": 15},
        {"record_id": 4, "source": "overpass", "raw_name": "Harbour Books", "quality_score": 20},
    )
    members = res.resolve_identities(rows)
    assert {r.record_id: r.identity_id for r in members.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    got = {r.identity_id: (r.normalized_name, r.source_count, r.identity_confidence) for r in res.identities(rows, members).collect()}
    assert got == {0: ("abc dental", 4, 100.0), 4: ("harbour books", 1, 50.0)}


def test_merge_keeps_the_first_and_fills_its_gaps(spark):
    rows = records(
        spark,
        {"record_id": 1, "raw_name": "Acme Pvt Ltd", "quality_score": 50},
        {"record_id": 2, "raw_name": "acme", "raw_phone": "9876543210", "quality_score": 40},
        {"record_id": 3, "raw_name": "Other", "raw_phone": "98765 43210", "raw_email": "a@b.in", "quality_score": 98},
        {"record_id": 4, "raw_name": "other ltd", "quality_score": 10},
    )
    # 2 joins 1 by name, so its phone takes no place in the index and 3 is kept; 4 joins 3 by name
    got = {r.record_id: (r.raw_phone, r.raw_email, r.quality_score, r.duplicates) for r in res.merge_sources(rows).collect()}
    assert got == {1: ("9876543210", None, 55, 1), 3: ("98765 43210", "a@b.in", 100, 1)}


def test_ingest_links_later_rows_to_earlier_new_ones(spark):
    rows = records(
        spark,
        {"record_id": 1, "raw_name": "Harbour Book House"},
        {"record_id": 2, "raw_name": "Zeta", "raw_website": "zeta.in", "raw_phone": "9876500001"},
        {"record_id": 3, "raw_name": "Zeta Labs Two", "raw_website": "www.zeta.in/x", "raw_phone": "9876500002"},
        {"record_id": 4, "raw_name": "Known", "raw_phone": "9876500009"},
    )
    companies = spark.createDataFrame([(7, "Someone", "+91 98765 00009", None)], "company_id long, name string, phone string, website_url string")
    got = {r.record_id: (r.company_id, r.new_company_of, r.result_type, r.reason) for r in res.ingest_results(rows, companies).collect()}
    # 2 and 3 share a host, so one of them is set aside before the load
    assert got[1] == (None, 1, "NEW", None)
    assert got[4] == (7, None, "EXISTING", "Exact Phone Match")
    assert len(got) == 3


CANDIDATE = "entity_id long, field string, seq long, value string, source string, confidence double"


def test_fusion(spark):
    industry = spark.createDataFrame(
        [(1, "industry", 1, "Dentist", "google_maps", 90.0), (1, "industry", 2, "Dental Hospital", "website", 80.0), (1, "industry", 3, "Healthcare", "ModernBERT", 93.0)],
        CANDIDATE,
    )
    r = fusion.fuse_fields(industry).first()
    assert (r.value, r.confidence, r.candidate_count) == ("Healthcare", 92.1, 3)
    strict = fusion.fuse_fields(industry, strict_reference=True).first()
    # (0.90 + 0.80 + 0.93 * 0.5) / 3 * 100 + 6
    assert strict.confidence == 78.2
    phones = spark.createDataFrame(
        [(1, "phone", 1, "+91 98765 43210", "google_maps", 98.0), (1, "phone", 2, "9876543210", "website", 85.0), (1, "phone", 3, "9123456789", "grotal", 99.0)],
        CANDIDATE,
    )
    p = fusion.fuse_phones(phones).first()
    assert (p.value, p.confidence) == ("+91 98765 43210", 100.0)
    assert fusion.fuse_fields(industry.limit(0)).count() == 0


def test_source_reliability(spark):
    runs = spark.createDataFrame(
        [(1, "s", 10, 6, 5, 1, 1.0, None), (2, "s", 5, 5, 5, 1, 1.0, None), (3, "s", 5, 4, 5, 0, 1.0, None), (4, "s", 0, 0, 0, 0, 1.0, "403 blocked")],
        "run_id long, source string, results long, contacts long, websites long, duplicates long, duration_sec double, error string",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    r = agg.source_reliability(runs).first()
    assert (r.success_rate, r.blocked_rate, r.duplicate_rate, r.reliability_score) == (0.75, 0.25, 0.10, 63.0)
    assert agg.source_status(agg.source_reliability(runs)).first().status == "degraded"


def test_maturity_services_and_inverse_score(spark):
    schema = (
        "id int, has_website boolean, website_score int, has_crm boolean, has_booking_system boolean, has_whatsapp_widget boolean, "
        "has_contact_form boolean, social_profiles array<string>"
    )
    rows = [
        (1, False, None, False, False, False, False, []),
        (2, True, 95, True, True, True, True, ["x"]),
        (3, True, 100, True, True, True, True, ["x"]),
        (4, True, 80, True, True, False, True, []),
    ]
    got = {r.id: (r.digital_maturity_score, r.lead_score, r.services_needed) for r in scoring.company_features(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (0, 50, ["Website Development", "CRM Development", "WhatsApp Automation", "Booking System Setup", "AI Chatbot"])
    assert got[2] == (99, 1, [])
    assert got[3] == (100, 0, [])
    assert got[4] == (76, 24, ["WhatsApp Automation", "AI Chatbot"])


def test_buying_signals(spark):
    rows = [
        (1, True, True, True, True, True, 90, 95),
        (2, False, False, False, False, False, 0, 0),
        (3, True, False, False, False, False, 20, 40),
        (4, True, True, False, True, False, 80, 90),
    ]
    schema = (
        "company_id int, has_website boolean, has_crm boolean, has_whatsapp_widget boolean, has_booking_system boolean, has_chatbot boolean, "
        "seo_score int, page_speed_estimate int"
    )
    got = {r.company_id: r.intent_score for r in scoring.buying_signals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 0, 2: 70, 3: 70, 4: 20}


def test_composite_score(spark):
    companies = spark.createDataFrame(
        [(1, "1", "e", "w", "c", None), (2, None, None, None, None, None), (3, None, None, None, None, None)],
        "company_id int, phone string, email string, website_url string, city string, country string",
    )
    intel = spark.createDataFrame([(1, 40, ["a", "b", "c"]), (3, 0, [])], "company_id int, digital_maturity_score int, services_needed array<string>")
    signals = spark.createDataFrame(
        [(1, False, True, True, False, False, False, None)],
        "company_id int, no_website boolean, no_crm boolean, no_whatsapp boolean, poor_seo boolean, slow_website boolean, no_booking_system boolean, intent_score int",
    )
    contacts = spark.createDataFrame([(1, True, True, False)], "company_id int, is_decision_maker boolean, email_verified boolean, phone_verified boolean")
    got = {r.company_id: (r.intent_score, r.opportunity_score, r.fit_score, r.lead_score) for r in scoring.lead_scores(companies, intel, signals, contacts).collect()}
    # 30 * .35 + 60 * .35 + 100 * .30 = 61.5, rounded up
    assert got[1] == (30, 60, 100, 62)
    assert got[2] == (50, 50, 0, 35)
    assert got[3][1] == 35


@pytest.mark.parametrize(
    "title,first,second",
    [
        ("CEO", 95, 90), ("Owner", 95, 100), ("Co-Owner", 95, 100), ("Founder", 95, 95), ("Co-Founder", 95, 95), ("VP of Engineering", 80, 80),
        ("Director of Sales", 80, 80), ("Vice President", 95, 80), ("Chief Technology Officer", 20, 80), ("CTO", 20, 30),
        ("Marketing Manager", 65, 70), ("Staff", 40, 30), ("Intern", 20, 30), (None, 20, 30),
    ],
)
def test_titles(spark, title, first, second):
    t = F.lit(title).cast("string")
    r = spark.range(1).select(scoring.decision_maker_score(t).alias("a"), scoring.decision_maker_score(t, "contacts").alias("b")).first()
    assert (r.a, r.b) == (first, second)


def test_verification(spark):
    rows = [
        ("Acme", "https://acme.in", None, None), ("Unknown", "https://a.in", None, "no name"), ("Acme", "acme.in", None, "website not http"),
        ("Acme", "https://www.justdial.com/x", None, "website blacklisted"), ("Acme", None, "12345", "phone too short"),
        ("Acme", None, "9999999999", "fake phone"), ("Acme", None, None, "no contact"),
    ]
    df = spark.createDataFrame(rows, "raw_name string, raw_website string, raw_phone string, want string")
    assert [r.reject_reason for r in flt.verify_records(df).collect()] == [r[3] for r in rows]


def test_person_names(spark):
    rows = [
        ("Jane Doe", "https://acme.in", None), ("Acme Doe", "https://acme.in", "NAME_CONTAINS_DOMAIN_BRAND"),
        ("Zest India", None, "COMPANY_COUNTRY_SUFFIX_DETECTED"), ("Cloud Vault", None, "PRODUCT_NAME_DETECTED"),
        ("Jane DataFlow", None, "BRAND_CASING_DETECTED"), ("Angus MacDonald", None, None),
        ("Smile Clinic", None, "Contains rejected keyword: clinic"), ("Jane", None, "Not a valid human name format"),
    ]
    df = spark.createDataFrame(rows, "name string, website string, want string")
    assert [r.reject_reason for r in flt.filter_human_names(df).collect()] == [r[2] for r in rows]


def test_entities(spark):
    rows = [(1, 0, "Raj", "B-PER", 0.9), (1, 1, "##esh", "I-PER", 0.8), (1, 2, "Shah", "I-PER", 0.9), (1, 3, "of", "O", 0.9), (1, 4, "Ann", "B-PER", 0.95)]
    got = ext.merge_entities(spark.createDataFrame(rows, "doc_id long, pos int, word string, label string, score double")).collect()
    assert [(r.name, round(r.score, 3)) for r in got] == [("Rajesh Shah", 0.867)]


GOOD_PAGE = """<html lang="en"><head><title>Acme</title><meta name="description" content="We fix teeth">
<meta name="viewport" content="width=device-width"><script>var p='+91 98765 11111'</script></head>
<body><nav><a href="/about">About</a></nav><h1>Hello</h1><form></form><a href="https://wa.me/919876543210">Chat</a>
<a href="https://linkedin.com/company/acme">in</a><div style="display: none">secret 9876522222</div><!-- mail x@y.in -->
<section id="about">Our story.</section>
<div class="team"><div class="team-card"><img src="a.png"><h3>Jane Doe</h3><p>Director of Care</p><a href="mailto:jane@acme.in?x=1">m</a></div>
<div class="team-card"><h3>Our Team</h3><span>Ravi Kumar</span></div></div>
<div class="faq-list"><h3>Ann Lee</h3></div>
<footer><a href="mailto:info@acme.in">mail</a><a href="tel:+919876543210">call</a><a href="/contact-us#x">contact</a>
<address>12 Main Road, Pune 411001</address></footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "https://acme.in/home", GOOD_PAGE), (2, "http://bare.in", "<html><head></head><body><div>x</div></body></html>")],
        "page_id long, url string, html string",
    )


def test_audit(pages):
    a = {r.page_id: r for r in ext.audit_pages(pages).collect()}
    assert (a[1].seo_score, a[1].mobile_friendly, a[1].has_contact_form, a[1].has_whatsapp_widget) == (80, True, True, True)
    assert a[1].social_links == ["https://linkedin.com/company/acme"]
    assert [i.message for i in a[1].issues] == ["Missing canonical link"]
    assert (a[2].seo_score, a[2].has_contact_form, a[2].has_whatsapp_widget, a[2].mobile_friendly) == (0, False, False, False)
    assert ("Missing <title> tag", "high") in [(i.message, i.severity) for i in a[2].issues]
    assert "No contact forms detected" in [i.message for i in a[2].issues]


def test_page_text_people_and_footer(pages):
    nodes = page_nodes(pages)
    text = {r.page_id: r.text for r in ext.clean_pages(nodes).collect()}
    assert "Our story." in text[1] and "Hello" in text[1]
    assert not any(x in text[1] for x in ("98765 11111", "9876522222", "x@y.in", "info@acme.in", "About"))
    sections = {r.page_id: r for r in ext.page_sections(nodes).collect()}
    assert sections[1].about == "Our story." and sections[1].hero == "Hello"
    people = {(r.name, r.title, r.section_type, r.email, r.reject_reason) for r in ext.person_candidates(nodes).filter("page_id = 1").collect()}
    assert ("Jane Doe", "Director of Care", "TEAM_SECTION", "jane@acme.in", None) in people
    assert ("Ravi Kumar", None, "TEAM_SECTION", None, None) in people
    assert not any(p[0] == "Ann Lee" for p in people)
    foot = {(r.kind, r.value) for r in ext.footer_contacts(nodes).collect()}
    assert foot == {
        ("EMAIL", "info@acme.in"), ("PHONE", "+919876543210"), ("CONTACT_PAGE", "/contact-us"), ("ADDRESS", "12 Main Road, Pune 411001"),
        ("LinkedIn", "https://linkedin.com/company/acme"),
    }


def test_fallback_people(spark):
    html = "<body><div><img src=x>Jane Doe, Dentist</div><div>Plain words here</div><p><a href='https://linkedin.com/in/sam-hill'>s</a></p></body>"
    nodes = page_nodes(spark.createDataFrame([(1, "https://x.in", html)], "page_id long, url string, html string"))
    got = {(r.name, r.title, r.section_type, r.score) for r in ext.person_candidates(nodes).filter("reject_reason is null").collect()}
    # occupation 15 + image 15 + short box 20 = 50; an inferred name from a profile link scores 40 + 20
    assert got == {("Jane Doe", "Dentist", "FALLBACK_RELATIONSHIP_SCAN", 50), ("Sam Hill", "", "LINKEDIN_PROFILE", 60)}


def test_listing_cards_and_registry_pages(spark):
    html = """<div class="eachPopular"><a class="eachPopularTitle">Acme Dental</a><a class="businessContact" href="tel: 98765">x</a>
    <address class="businessArea">Main <b>Road</b></address></div>"""
    other = """<div class="product-card x"><h2>Beta</h2><span>+91-9876543210</span><div class="location-x">Pune</div></div>"""
    nodes = page_nodes(spark.createDataFrame([(1, "u", html), (2, "u", other)], "page_id long, url string, html string"))
    nodes = nodes.withColumn("source", F.when(F.col("page_id") == 1, "yellowpages").otherwise("tradeindia"))
    got = {(r.source, r.raw_name, r.raw_phone, r.raw_address) for r in ext.listing_cards(nodes).collect()}
    assert got == {("yellowpages", "Acme Dental", "98765", "Main Road"), ("tradeindia", "Beta", "+91-9876543210", "Pune")}
    page = """<p>Email ID: </p><p>a@b.in</p><b>Registered Address</b><p>1 Road, Pune</p>
    <table class="table table-striped"><tr><th>DIN</th><th>Name</th></tr><tr><td>1</td><td>RAJ SHAH</td></tr><tr><td>2</td><td>ANN LEE</td></tr></table>"""
    r = ext.registry_details(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert (r.email, r.address, r.directors) == ("a@b.in", "1 Road, Pune", ["RAJ SHAH", "ANN LEE"])


def test_names_are_looked_up_a_few_texts_at_a_time(spark):
    class Rows:
        schema = spark.createDataFrame([], "doc_id long, text string, low string, people array<struct<name_key:string,name:string,score:double>>").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    names = [f"ann {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    row = {"text": " ".join(names).title() * 10, "people": [{"name_key": n, "name": n.title(), "score": 0.5} for n in names]}
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, **row, "low": row["text"].lower()} for i in range(3000)])
    tracemalloc.start()
    rows = 0
    for out in ext._near_names(Rows(), "doc_id")([batch]):
        assert set(out.column("at").to_pylist()) == {1 + 7 * i for i in range(90)}
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert rows == 3000 * 90 and peak < 10


def test_contacts_near_names(spark):
    persons = spark.createDataFrame([(1, 0, "Raj Shah", 0.9)], "doc_id long, start int, name string, score double")
    texts = spark.createDataFrame([(1, "Meet Raj Shah, Managing Director\nof Acme")], "doc_id long, text string")
    r = ext.persons_to_contacts(persons, texts).first()
    assert (r.title, r.decision_maker_score, r.category, r.confidence) == ("Managing Director", 80, "LEADERSHIP", 90)


def test_many_persons_of_one_text_read_it_once(spark):
    text = "Énna Müller, xx\nAnn Lee\n" + "ann lee, Head of Sales\n" + "Bo Di - Chief Cook\n" * 50
    people = [(1, 0, "Ann Lee", 0.9), (1, 9, "ANN LEE", 0.8), (1, 4, "Bo Di", 0.9), (1, 5, "nna Mü", 0.9), (1, 6, "Not There", 0.9), (1, 7, "B D", 0.9), (2, 0, "Ann Lee", 0.9)]
    persons = spark.createDataFrame(people, "doc_id long, start int, name string, score double")
    contacts = ext.persons_to_contacts(persons, spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    got = {(r.doc_id, r.name, r.title, r.decision_maker_score) for r in contacts.collect()}
    assert got == {(1, "Ann Lee", "Ann Lee", 50), (1, "Bo Di", "Head of Sales", 80), (1, "nna Mü", "Ann Lee", 50), (1, "Not There", None, 20), (2, "Ann Lee", None, 20)}
    # a text meets the list of its persons: no row of a join is made for each of them
    joined = contacts._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "collect_list" in joined and "lower(text" in joined


def test_csv_export(spark, tmp_path):
    frame = spark.createDataFrame(
        [("Test Company, Inc.", "555-1234", "test@example.com", "test.com", "123 Main St\nSuite 100", "google_maps", "85", "new", None, None)],
        "raw_name string, raw_phone string, raw_email string, raw_website string, raw_address string, source string, lead_score string, stage string, name string, phone string",
    ).withColumn("website_url", F.lit(None).cast("string")).coalesce(1)
    out = sinks.csv_frame(frame)
    sinks.export_csv(out, str(tmp_path / "full"))
    sinks.export_csv(out.limit(0), str(tmp_path / "empty"))
    header = "Company Name,Phone,Email,Website,Address,Source,Lead Score,Pipeline Stage\n"
    text = "".join(p.read_text() for p in (tmp_path / "full").glob("part-*"))
    assert text == header + '"Test Company, Inc.",555-1234,test@example.com,test.com,"123 Main St\nSuite 100",google_maps,85,new\n'
    assert "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*")) == header


def test_raw_load_and_run_log(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text('{"source": "a", "business_name": "X", "osm": 5}\n{"source": \n')
    good, bad = dumps.load_raw(spark, str(tmp_path / "dump.jsonl"))
    r = good.select("source", "raw_name", F.variant_get("extra", "$.osm", "int").alias("osm")).collect()
    assert [(x.source, x.raw_name, x.osm) for x in r] == [("a", "X", 5)]
    assert bad.count() == 1
    sinks.log_run(spark, str(tmp_path / "runs"), {"task": "t", "status": "ok", "duration_sec": 1.5, "metrics": {"rows": 3.0}, "ts": None})
    sinks.log_run(spark, str(tmp_path / "runs"), {"task": "u", "status": "failed", "duration_sec": 0.5, "errors": ["x"], "ts": None})
    assert {(x.task, x.status) for x in spark.read.parquet(str(tmp_path / "runs")).collect()} == {("t", "ok"), ("u", "failed")}


def test_upsert_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int").write.parquet(path)
    updates = spark.createDataFrame([(2, "B", 1), (3, "C", 1), (3, "old", 0)], "k int, v string, seq int")
    once = sinks.upsert_files(spark, path, updates, ["k"], "seq")
    twice = sinks.upsert_files(spark, once, updates, ["k"], "seq")
    want = {(1, "a"), (2, "B"), (3, "C")}
    assert {(r.k, r.v) for r in spark.read.parquet(once).collect()} == want
    assert {(r.k, r.v) for r in spark.read.parquet(twice).collect()} == want


def test_template_fill(spark):
    r = spark.range(1).select(prj.fill_first(F.lit("Hi {{name}}, {{name}}"), F.lit("Ann")).alias("t"), prj.fill_first(F.lit("none"), F.lit("x")).alias("u")).first()
    assert (r.t, r.u) == ("Hi Ann, {{name}}", "none")


def test_long_query_lists_give_the_same_hits(spark):
    companies = spark.createDataFrame(
        [(i, f"name {i % 7} cafe", "retail", None, "Pune", "mh") for i in range(40)],
        "company_id long, name string, industry string, description string, city string, state string",
    )
    queries = spark.createDataFrame([(1, "cafe", None), (2, "Retail", "pune"), (3, "3", None), (4, "zzz", None)], "query_id long, keyword string, location string")
    near = {tuple(r) for r in flt.keyword_search(companies, queries, 5).collect()}
    far = {tuple(r) for r in flt.keyword_search(companies, queries, 5, small=0).collect()}
    assert near == far and len(near) == 15


def test_site_texts_and_lists_are_whole_by_default(spark):
    from tessera.operators.extraction import company_profile
    from tessera.operators.projections import profile_text

    items = [f"service {i} " + "x" * 90 + " end" for i in range(20)]
    row = ("s", "t", None, "h", "a" * 3000, items, items[::-1], ["WordPress"], "Health", "Unknown")
    docs = spark.createDataFrame([row], "site string, title string, description string, hero string, about string, services array<string>, products array<string>, technology array<string>, industry string, business_model string")
    r = profile_text(docs).first()
    assert r.classification_text == ". ".join(["t", "h", "a" * 3000, *items]) and r.profile_text == "t. h. " + "a" * 3000 + ". Industry: Health"
    assert r.services_text == ". ".join([*items, *items[::-1]])
    assert profile_text(docs, profile_about=5, profile_chars=9, services=(1, 7), products=(0, None)).select("profile_text", "services_text").first()[:] == ("t. h. aaa", "service")
    p = company_profile(docs).first()
    assert len(p.description) == 3000 and len(p.services_listed) == 20
