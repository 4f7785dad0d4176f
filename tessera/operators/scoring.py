"""Rule-based scores, each a whole-table pass over generated column sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import clamp, compact, points, present, round_half_up, truthy


def _missing(name: str) -> Column:
    return ~truthy(name)


def lead_scores(companies: DataFrame, intelligence: DataFrame, signals: DataFrame, contacts: DataFrame) -> DataFrame:
    """Composite score of every company: 0.35 intent + 0.35 opportunity + 0.30 fit, rounded, 0 to 100.

    A stored maturity of 0 or null counts as 50 (so does a company without intelligence), a company
    without signals has intent 50. Contacts are folded to flags before the join, so they never fan out.
    """
    people = contacts.groupBy("company_id").agg(
        F.max(truthy("is_decision_maker")).alias("has_decision_maker"),
        F.max(truthy("email_verified") | truthy("phone_verified")).alias("has_verified"),
        F.lit(True).alias("has_contacts"),
    )
    intel = intelligence.select("company_id", "digital_maturity_score", "services_needed", F.lit(True).alias("has_intel"))
    sig = signals.select(
        "company_id", "no_website", "no_crm", "no_whatsapp", "poor_seo", "slow_website", "no_booking_system",
        F.col("intent_score").alias("stored_intent"), F.lit(True).alias("has_signals"),
    )
    base = companies.select("company_id", "phone", "email", "website_url", "city", "country")
    joined = base.join(intel, "company_id", "left").join(sig, "company_id", "left").join(people, "company_id", "left")

    by_rule = points(
        (truthy("no_website"), 25),
        (truthy("no_crm"), 15),
        (truthy("no_whatsapp"), 15),
        (truthy("poor_seo"), 15),
        (truthy("slow_website"), 10),
        (truthy("no_booking_system"), 10),
    )
    intent = F.least(F.lit(100), F.greatest(by_rule, F.coalesce("stored_intent", F.lit(0))))
    maturity = F.coalesce(F.nullif("digital_maturity_score", F.lit(0)), F.lit(50))
    bonus = F.least(F.lit(30), F.coalesce(F.size("services_needed"), F.lit(0)) * 6)
    opportunity = clamp(round_half_up((100 - maturity) * F.lit(0.7) + bonus))
    fit = points(
        (present("phone"), 20),
        (present("email"), 15),
        (present("website_url"), 15),
        (truthy("has_contacts"), 15),
        (truthy("has_decision_maker"), 20),
        (truthy("has_verified"), 10),
        (present("city") | present("country"), 5),
    )
    parts = joined.select(
        "company_id",
        F.when(truthy("has_signals"), intent).otherwise(50).cast("int").alias("intent_score"),
        F.when(truthy("has_intel"), opportunity).otherwise(50).cast("int").alias("opportunity_score"),
        F.least(F.lit(100), fit).cast("int").alias("fit_score"),
    )
    lead = F.col("intent_score") * 0.35 + F.col("opportunity_score") * 0.35 + F.col("fit_score") * 0.30
    return parts.withColumn("lead_score", clamp(round_half_up(lead)).cast("int"))


def digital_maturity() -> Column:
    """0 to 100 from website, its score, messaging, booking, CRM, form and social profiles."""
    quality = F.when(
        truthy("has_website") & (F.coalesce("website_score", F.lit(0)) > 0), round_half_up(F.col("website_score") / 100 * 20)
    ).otherwise(0)
    return clamp(
        points(
            (truthy("has_website"), 30),
            (truthy("has_whatsapp_widget"), 15),
            (truthy("has_booking_system"), 15),
            (truthy("has_crm"), 10),
            (truthy("has_contact_form"), 5),
            (F.coalesce(F.size("social_profiles"), F.lit(0)) > 0, 5),
        )
        + quality
    ).cast("int")


def services_needed() -> Column:
    """Services suggested by what is missing, in a fixed order."""
    scored = F.col("website_score")
    return F.array_distinct(
        compact(
            F.when(_missing("has_website") | F.coalesce(scored < 50, F.lit(False)), F.lit("Website Development")),
            F.when(_missing("has_crm"), F.lit("CRM Development")),
            F.when(_missing("has_whatsapp_widget"), F.lit("WhatsApp Automation")),
            F.when(_missing("has_booking_system"), F.lit("Booking System Setup")),
            F.when(scored < 70, F.lit("SEO")),
            F.when(_missing("has_contact_form") | _missing("has_whatsapp_widget"), F.lit("AI Chatbot")),
        )
    )


def inverse_score(maturity: Column) -> Column:
    """100 minus maturity; no presence at all gives 50."""
    return F.when(maturity == 0, 50).otherwise(clamp(100 - maturity)).cast("int")


def company_features(features: DataFrame) -> DataFrame:
    """Maturity, services needed and inverse lead score for a table of feature flags."""
    scored = features.withColumns({"digital_maturity_score": digital_maturity(), "services_needed": services_needed()})
    return scored.withColumn("lead_score", inverse_score(F.col("digital_maturity_score")))


# Intent rules of the audit-based score (flag missing from the audit, points, label).
AUDIT_INTENT_RULES = (
    ("has_whatsapp_widget", 18, "No WhatsApp integration"),
    ("has_booking_system", 15, "No booking/appointment system"),
    ("has_crm", 15, "No CRM detected"),
    ("poor_seo", 15, "Poor SEO score (<50)"),
    ("ssl_enabled", 12, "No SSL/HTTPS"),
    ("has_contact_form", 12, "No contact form"),
    ("has_analytics", 8, "No analytics tracking"),
    ("has_chatbot", 5, "No chatbot"),
)

# Service, priority order, priority, confidence, and the flag whose absence calls for it.
AUDIT_SERVICES = (
    ("WhatsApp Automation", 0, "critical", 95, "has_whatsapp_widget"),
    ("Online Booking System", 1, "high", 90, "has_booking_system"),
    ("CRM Integration", 1, "high", 85, "has_crm"),
    ("AI Chatbot", 1, "high", 88, "has_chatbot"),
    ("SEO Optimization", 1, "high", 92, "poor_seo"),
    ("Analytics & Tracking Setup", 2, "medium", 80, "has_analytics"),
    ("Website Security (SSL)", 0, "critical", 99, "ssl_enabled"),
    ("Mobile-Responsive Website", 0, "critical", 95, "mobile_friendly"),
)

# Signals that mark a strong buyer.
HIGH_VALUE_SIGNALS = ("book demo", "book consultation", "pricing", "case studies", "awards", "certifications")


def _audit_gap(flag: str) -> Column:
    """Is the thing behind a rule missing? Poor SEO is a gap of its own."""
    return F.coalesce(F.col("seo_score"), F.lit(0)) < 50 if flag == "poor_seo" else _missing(flag)


def grade(score: Column) -> tuple[Column, Column]:
    letter = F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 45, "C").when(score >= 25, "D").otherwise("F")
    priority = (
        F.when(score >= 80, "hot").when(score >= 45, "warm").when(score >= 25, "cold").otherwise("skip")
    )
    return letter, priority


def distinct_signals(*columns: str) -> Column:
    """Signals of several arrays, lower-cased and trimmed, without repeats."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return F.array_distinct(F.transform(F.concat(*arrays), lambda s: F.lower(F.trim(s))))


def lead_intelligence(audits: DataFrame, sites: DataFrame, people: DataFrame) -> DataFrame:
    """Audit-based scores, grade, ordered recommendations, signal strength and contact summary.

    ``audits`` holds flags, ``seo_score`` and ``audit_signals``; ``sites`` holds ``document_signals``,
    ``about_length``, ``company_size``, ``industry_confidence`` and ``description``; ``people`` holds
    contact counts and flags. All have one row per ``company_id``.
    """
    j = audits.join(sites, "company_id", "left").join(people, "company_id", "left")
    maturity = clamp(
        F.lit(100)
        - points(
            (_missing("ssl_enabled"), 15),
            (_missing("mobile_friendly"), 15),
            (_missing("has_contact_form"), 10),
            (_missing("has_whatsapp_widget"), 10),
            (_missing("has_booking_system"), 10),
            (_missing("has_crm"), 10),
            (_missing("has_chatbot"), 10),
            (_missing("has_analytics"), 8),
            (_audit_gap("poor_seo"), 12),
        )
    )
    intent = F.least(F.lit(100), points(*[(_audit_gap(flag), value) for flag, value, _ in AUDIT_INTENT_RULES]))
    triggered = compact(*[F.when(_audit_gap(flag), F.lit(label)) for flag, _, label in AUDIT_INTENT_RULES])
    fit = F.least(
        F.lit(100),
        points(
            (F.coalesce("contacts_found", F.lit(0)) > 0, 20),
            (F.coalesce("leadership_found", F.lit(0)) > 0, 20),
            (truthy("has_personal_email"), 15),
            (truthy("has_phone"), 10),
            (truthy("has_linkedin"), 10),
            (F.coalesce("about_length", F.lit(0)) > 100, 5),
            (F.coalesce("company_size", F.lit("Unknown")) != "Unknown", 5),
            (F.coalesce("industry_confidence", F.lit(0)) > 60, 10),
            (F.length(F.coalesce("description", F.lit(""))) > 30, 5),
        ),
    )
    ordered = sorted(enumerate(AUDIT_SERVICES), key=lambda item: (item[1][1], item[0]))
    recommendations = compact(
        *[
            F.when(
                _audit_gap(flag),
                F.struct(F.lit(service).alias("service"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence")),
            )
            for _, (service, _, priority, confidence, flag) in ordered
        ]
    )
    out = j.withColumns(
        {
            "maturity_score": maturity.cast("int"),
            "intent_score": intent.cast("int"),
            "triggered_signals": triggered,
            "fit_score": fit.cast("int"),
            "recommendations": recommendations,
            "detected_signals": distinct_signals("document_signals", "audit_signals"),
        }
    )
    bonus = F.least(F.lit(25), F.size("triggered_signals") * 5)
    out = out.withColumn(
        "opportunity_score", F.least(F.lit(100), round_half_up((100 - F.col("maturity_score")) * 0.75 + bonus)).cast("int")
    )
    lead = F.col("intent_score") * 0.35 + F.col("opportunity_score") * 0.35 + F.col("fit_score") * 0.30
    out = out.withColumn("lead_score", clamp(round_half_up(lead)).cast("int"))
    letter, priority = grade(F.col("lead_score"))
    high = F.size(F.filter("detected_signals", lambda s: s.rlike("|".join(HIGH_VALUE_SIGNALS))))
    strength = (
        F.when(high >= 3, "strong").when(high >= 1, "moderate").when(F.size("detected_signals") > 0, "weak").otherwise("none")
    )
    return out.withColumns({"grade": letter, "priority": priority, "signal_strength": strength}).select(
        "company_id", "maturity_score", "intent_score", "opportunity_score", "fit_score", "lead_score", "grade", "priority",
        "triggered_signals", "recommendations", "detected_signals", "signal_strength",
        F.coalesce("contacts_found", F.lit(0)).alias("contacts_found"),
        F.coalesce("leadership_found", F.lit(0)).alias("leadership_found"),
        (F.coalesce("leadership_found", F.lit(0)) > 0).alias("decision_maker_present"),
    )


def buying_signals(inputs: DataFrame) -> DataFrame:
    """Seven need flags and their intent; SEO and speed count only with a website."""
    site = truthy("has_website")
    flags = {
        "no_website": ~site,
        "poor_seo": site & (F.coalesce("seo_score", F.lit(0)) < 50),
        "slow_website": site & (F.coalesce("page_speed_estimate", F.lit(0)) < 80),
        "no_crm": _missing("has_crm"),
        "no_whatsapp": _missing("has_whatsapp_widget"),
        "no_booking_system": _missing("has_booking_system"),
        "no_chatbot": _missing("has_chatbot"),
    }
    weights = {"no_website": 30, "poor_seo": 15, "slow_website": 15}
    intent = F.least(F.lit(100), points(*[(c, weights.get(name, 10)) for name, c in flags.items()]))
    return inputs.select("company_id", *[c.alias(name) for name, c in flags.items()], intent.cast("int").alias("intent_score"))


def stateless_scores(audits: DataFrame, people: DataFrame) -> DataFrame:
    """Variant from one audit and contact flags: maturity 50 minus gaps, recommendations, fit by contacts."""
    seo_poor = F.col("seo_score") < 50
    slow = F.col("page_speed_estimate") < 80
    j = audits.join(people, "company_id", "left")
    maturity = clamp(
        F.lit(50)
        - points(
            (_missing("has_whatsapp_widget"), 10),
            (_missing("has_crm"), 15),
            (_missing("has_booking_system"), 10),
            (_missing("has_chatbot"), 10),
            (seo_poor, 15),
            (_missing("mobile_friendly"), 20),
            (slow, 10),
        )
    )

    def advice(condition: Column, service: str, confidence: int) -> Column:
        return F.when(condition, F.struct(F.lit(service).alias("service"), F.lit(confidence).alias("confidence")))

    recommended = compact(
        advice(_missing("has_whatsapp_widget"), "WhatsApp Automation", 95),
        advice(_missing("has_crm"), "CRM Development", 85),
        advice(_missing("has_booking_system"), "Booking System", 80),
        advice(_missing("has_chatbot"), "AI Chatbot", 90),
        advice(seo_poor, "SEO Optimization", 95),
        advice(_missing("mobile_friendly"), "Website Development", 95),
        advice(slow & truthy("mobile_friendly"), "Website Development", 80),
    )
    fit = points(
        (truthy("has_contacts"), 30), (truthy("has_decision_maker"), 30), (truthy("has_email"), 20), (truthy("has_phone"), 20)
    )
    out = j.select(
        "company_id", maturity.cast("int").alias("digital_maturity_score"), fit.cast("int").alias("fit_score"), recommended.alias("recommended_services")
    )
    need = 100 - F.col("digital_maturity_score")
    bonus = F.least(F.lit(30), F.size("recommended_services") * 6)
    out = out.withColumns(
        {"intent_score": need.cast("int"), "opportunity_score": clamp(round_half_up(need * 0.7 + bonus)).cast("int")}
    )
    lead = F.col("intent_score") * 0.35 + F.col("opportunity_score") * 0.35 + F.col("fit_score") * 0.30
    return out.withColumn("lead_score", clamp(round_half_up(lead)).cast("int"))


def document_scores(sites: DataFrame) -> DataFrame:
    """Variant from a site document; the composite is rounded half to even."""
    has_url = present("url")
    tech = F.coalesce(F.col("technology_count"), F.lit(0))
    maturity = points(
        (has_url, 20),
        (truthy("has_contact_form"), 10),
        (truthy("has_whatsapp_widget"), 15),
        (truthy("has_booking_system"), 15),
        (truthy("has_crm_integration"), 15),
        (truthy("has_ecommerce"), 15),
    ) + F.least(F.lit(10), tech * 2)
    intent = F.when(has_url, 0).otherwise(30)
    fit = points(
        (F.coalesce("phone_count", F.lit(0)) > 0, 30),
        (F.coalesce("email_count", F.lit(0)) > 0, 20),
        (F.coalesce("address_count", F.lit(0)) > 0, 15),
        (F.coalesce("leadership_count", F.lit(0)) > 0, 15),
        (present("industry"), 20),
    )
    lead = F.bround(intent * F.lit(0.35) + (100 - maturity) * F.lit(0.35) + fit * F.lit(0.30))
    return sites.select(
        "site",
        F.least(F.lit(100), maturity).cast("int").alias("digital_maturity"),
        intent.cast("int").alias("intent_score"),
        clamp(100 - maturity).cast("int").alias("opportunity_score"),
        F.least(F.lit(100), fit).cast("int").alias("fit_score"),
        clamp(lead).cast("int").alias("lead_score"),
    )


def audit_total(audits: DataFrame) -> DataFrame:
    """0.3 speed + 0.3 SEO + 10 each for SSL, mobile, form and messaging, cut to a whole number."""
    total = F.col("page_speed_estimate") * 0.3 + F.col("seo_score") * 0.3 + points(
        (truthy("ssl_enabled"), 10), (truthy("mobile_friendly"), 10), (truthy("has_contact_form"), 10), (truthy("has_whatsapp_widget"), 10)
    )
    advice = compact(
        F.when(_missing("ssl_enabled"), F.lit("ssl")),
        F.when(F.col("page_speed_estimate") < 50, F.lit("speed")),
        F.when(F.col("seo_score") < 100, F.lit("seo")),
        F.when(_missing("mobile_friendly"), F.lit("mobile")),
        F.when(_missing("has_contact_form"), F.lit("form")),
        F.when(_missing("has_whatsapp_widget"), F.lit("whatsapp")),
    )
    return audits.withColumns(
        {
            "overall_score": F.least(F.lit(100), total.cast("int")),
            "recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("none"))),
        }
    )


def identity_completeness(identities: DataFrame) -> DataFrame:
    """40/20/20/10/10 for site, phone, e-mail, leadership and social, and whether more work is needed."""
    score = points(
        (truthy("has_website"), 40),
        (truthy("has_phone"), 20),
        (truthy("has_email"), 20),
        (truthy("has_leadership"), 10),
        (truthy("has_social"), 10),
    )
    out = identities.withColumn("identity_confidence", score.cast("int"))
    return out.withColumn(
        "needs_enrichment", (F.col("identity_confidence") < 80) | _missing("has_phone") | _missing("has_email")
    )


def decision_maker_score(title: Column, ruleset: str = "discovery") -> Column:
    """Decision-maker score of a job title; two rule sets are in use."""
    t = F.lower(title)
    if ruleset == "discovery":
        score = (
            F.when(t.rlike("founder|ceo|owner|president|chairman|chief executive"), 95)
            .when(t.rlike("director|partner|vp"), 80)
            .when(t.rlike("head|lead|manager|principal"), 65)
            .when(t.rlike("staff|associate|executive|coordinator"), 40)
        )
        return F.coalesce(score, F.lit(20))
    score = (
        F.when(t.contains("owner"), 100)
        .when(t.contains("founder"), 95)
        .when(t.rlike("ceo|chief executive"), 90)
        .when(t.rlike("chief|vp|vice president|director"), 80)
        .when(t.rlike("manager|head|lead"), 70)
    )
    return F.coalesce(score, F.lit(30))


LEADERSHIP_TITLE = "founder|ceo|coo|cto|cfo|cmo|director|president|vp|partner|owner|chairperson|managing"


def decision_makers(contacts: DataFrame) -> DataFrame:
    """Both scores, the flags at their usual cut-offs, and a contact category."""
    title = F.col("title")
    a, b = decision_maker_score(title), decision_maker_score(title, "contacts")
    leading = (a >= 60) | F.coalesce(F.lower(title).rlike(LEADERSHIP_TITLE), F.lit(False))
    category = (
        F.when(leading, "LEADERSHIP_CONTACT").when(F.trim(title) != "", "TEAM_CONTACT").otherwise("UNKNOWN_CONTACT")
    )
    return contacts.withColumns(
        {
            "discovery_score": a.cast("int"),
            "contact_score": b.cast("int"),
            "is_decision_maker": a >= 60,
            "is_contact_decision_maker": b >= 70,
            "category": category,
        }
    )


def contact_confidence(candidates: DataFrame) -> DataFrame:
    """Confidence of a person candidate with the reasons behind it, raised to a floor by category."""
    kind = F.col("section_type")
    rules = (
        (F.col("name") != "Business Contact", 30, "Human name detected"),
        (F.coalesce(F.trim("title") != "", F.lit(False)), 25, "Professional title detected"),
        (kind == "LEADERSHIP_SECTION", 20, "Appears in leadership section"),
        (kind == "TEAM_SECTION", 20, "Appears in team section"),
        (truthy("has_linkedin") | (kind == "LINKEDIN_PROFILE"), 20, "LinkedIn profile present"),
        (truthy("has_email"), 20, "Email address present"),
        (kind.isin("PROFILE_CARD", "AUTHOR_CARD"), 15, "Appears in profile card"),
        (truthy("has_image"), 15, "Profile image present"),
        (truthy("has_phone"), 10, "Phone number present"),
    )
    raw = points(*[(c, v) for c, v, _ in rules])
    reasons = compact(*[F.when(c, F.lit(text)) for c, _, text in rules])
    out = decision_makers(candidates).withColumns({"raw_score": raw, "reasons": reasons})
    capped = F.least(F.lit(100), F.col("raw_score"))
    final = (
        F.when(F.col("category") == "LEADERSHIP_CONTACT", F.greatest(capped, F.lit(70)))
        .when(F.col("category") == "TEAM_CONTACT", F.greatest(capped, F.lit(50)))
        .otherwise(capped)
    )
    clamps = (F.col("raw_score") > 100).cast("int") + (final > capped).cast("int")
    return out.withColumns(
        {"base_score": capped.cast("int"), "confidence_score": final.cast("int"), "clamp_events": clamps}
    )


def needs_more(coverage_row: DataFrame, target: int) -> DataFrame:
    """Next-step flags of a result set: more sources when coverage or count fall short."""
    return coverage_row.select(
        "records",
        "coverage_pct",
        (F.col("websites") == 0).alias("needs_fallback_tier"),
        ((F.col("coverage_pct") < 80) | (F.col("records") < target)).alias("needs_adaptive_tier"),
    )
