"""Each rule that bars a company or a message, alone; the cap and its order; the report's numbers by hand."""

import datetime as dt

from pyspark.sql import functions as F

from prospectra.operators import pages, staging

COMPANY = "id long, domain string, website_url string, last_crawled_at timestamp"
SCORE = "id long, company_id long, opportunity_score double, priority_tier string"
CONTACT = "id long, company_id long, email string, email_status string, source string, verification_source string"
NOW = dt.datetime(2026, 1, 5)


def eligible(spark, company=(1, "a.com", "https://a.com", NOW), scores=((1, 1, 70.0, "high"),), contacts=((1, 1, "Jo@a.com", "valid", "website", None),), signals=(), sent=()):
    frames = [spark.createDataFrame([company], COMPANY), spark.createDataFrame(scores, SCORE), spark.createDataFrame(contacts, CONTACT), spark.createDataFrame(list(signals), "company_id long, type string"), spark.createDataFrame(list(sent), "company_id long, recipient string")]
    return [(r.company_id, r.no_website) for r in staging.outreach_eligible(*frames).collect()]


def test_an_eligible_company(spark):
    assert eligible(spark) == [(1, False)]
    assert eligible(spark, company=(1, "a.local", None, None)) == [(1, True)]
    assert eligible(spark, contacts=((1, 1, "x@b.gov", "valid", "website", None), (2, 1, "jo@a.com", "catch_all", "website", None), (3, 1, "di@a.com", "valid", "website", None))) == [(1, False)]
    assert eligible(spark, contacts=((1, 1, "jo@a.com", "valid", "email_permutator", "smtp_handshake"),)) == [(1, False)]
    assert eligible(spark, signals=[(1, "funding"), (2, "crawl_audit_failed")], sent=[(2, "else@x.com"), (None, "who@x.com")]) == [(1, False)]


BARRING = [
    {"company": (1, "a.com", "https://a.com", None)},
    {"scores": ((1, 1, 49.9, "high"),)},
    {"scores": ((1, 1, 90.0, "immediate"), (2, 1, 20.0, "low"))},
    *({"scores": ((1, 1, 90.0, tier),)} for tier in ("ignore", "disqualified", "pending_audit")),
    {"signals": [(1, "crawl_audit_failed")]},
    {"sent": [(1, "other@a.com")]},
    {"sent": [(9, "jo@A.com")]},
    {"contacts": ()},
    *({"contacts": ((1, 1, email, "valid", "website", None),)} for email in ("x@city.gov", "x@a.gov.uk", "x@base.mil", "x@uni.edu", "x@b.local", "x@b.SG", "x@b.com.au", "x@qq.com", "x@yelp.com", None)),
    *({"contacts": ((1, 1, "jo@a.com", status, "website", None),)} for status in ("unverified", "bounced", None)),
    {"contacts": ((1, 1, "jo@a.com", "valid", "email_permutator", None),)},
    {"contacts": ((1, 1, "jo@a.com", "catch_all", "canonical_synthesizer", "smtp_handshake"),)},
    {"contacts": ((1, 1, "jo@a.com", "valid", None, "smtp_handshake"),)},
]


def test_what_bars_a_company(spark):
    """Every case has a company, addresses and tables of its own, and one company is barred by nothing."""
    tables = {"company": [], "scores": [], "contacts": [], "signals": [], "sent": []}
    plain = {"company": (1, "a.com", "https://a.com", NOW), "scores": ((1, 1, 70.0, "high"),), "contacts": ((1, 1, "Jo@a.com", "valid", "website", None),), "signals": (), "sent": ()}
    own_id = {"company": 0, "scores": 1, "contacts": 1, "signals": 0, "sent": 0}
    for i, case in enumerate([*BARRING, {}], 1):
        for name, rows in {**plain, **case}.items():
            for row in [rows] if name == "company" else rows:
                text = [v.replace("a.com", f"a{i}.com").replace("A.com", f"A{i}.com") if isinstance(v, str) else v for v in row]
                at = own_id[name]
                text[at] = i if text[at] == 1 else None if text[at] is None else 10_000 + i
                tables[name].append(tuple(text))
    schemas = (COMPANY, SCORE, CONTACT, "company_id long, type string", "company_id long, recipient string")
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(tables.values(), schemas, strict=True)]
    assert [r.company_id for r in staging.outreach_eligible(*frames, limit=None).collect()] == [len(BARRING) + 1]


CANDIDATE = {
    "contact_id": 1, "company_id": 1, "domain": "harbor.com", "name": "Harbor Cafe", "website_url": "https://harbor.com", "last_crawled_at": NOW, "opportunity_score": 70.0, "cms": None, "frontend_stack": None, "performance_score": None,
    "lcp_ms": None, "n_opportunities": None, "hiring": None, "segment": "speed_optimization", "body": "Hi", "email": "Jo@harbor.com", "email_status": "valid", "source": "website", "verification_source": None,
}
TYPES = "contact_id long, company_id long, domain string, name string, website_url string, last_crawled_at timestamp, opportunity_score double, cms string, frontend_stack array<string>, performance_score int, lcp_ms int, n_opportunities int, hiring boolean, segment string, body string, email string, email_status string, source string, verification_source string"


def staged(spark, rows, suppressed=(), sent=(), verdicts=(), cap=50):
    frame = spark.createDataFrame([tuple({**CANDIDATE, **r}.values()) for r in rows], TYPES)
    stop = spark.createDataFrame([(e,) for e in suppressed], "email string")
    gone = spark.createDataFrame(list(sent), "company_id long, contact_id long, recipient string")
    judged = spark.createDataFrame(list(verdicts), "email string, deliverable boolean, status string")
    return {r.contact_id: (r.reject_reason, r.evidence_snapshot) for r in staging.stage_messages(frame, stop, gone, judged, cap).collect()}


REASONS = [
    ({}, {}, None),
    ({"last_crawled_at": None}, {}, "nothing_known"),
    ({"last_crawled_at": None, "frontend_stack": ["jQuery"]}, {}, None),
    ({"last_crawled_at": None, "hiring": True}, {}, None),
    ({}, {"suppressed": ["JO@harbor.com "]}, "suppressed"),
    ({"email": None}, {}, "no_email"),
    ({"email": "jo@city.gov"}, {}, "blocked_domain"),
    ({"email_status": "unverified"}, {}, "unusable_status"),
    ({"source": "email_permutator"}, {}, "unverified_guess"),
    ({}, {"sent": [(1, None, None)]}, "already_contacted"),
    ({}, {"sent": [(None, 1, None)]}, "already_contacted"),
    ({}, {"sent": [(None, None, "jo@HARBOR.com")]}, "already_contacted"),
    ({"domain": ""}, {}, "no_domain"),
    ({"email": "j@harbor.com"}, {}, "blocked_prefix"),
    ({"domain": "harbor-cafe-miami.local", "website_url": None, "email": "jo@oak.io"}, {}, "custom_domain_mismatch"),
    ({}, {"verdicts": [("jo@harbor.com", False, "invalid")]}, "undeliverable"),
    ({}, {"verdicts": [("jo@harbor.com", True, "risky")]}, "undeliverable"),
    ({}, {"verdicts": [("jo@harbor.com", True, "catch_all")]}, None),
    ({"segment": None}, {}, "no_evidence"),
    ({"body": ""}, {}, "no_evidence"),
]


def test_what_bars_a_message(spark):
    """Every case is a company and a contact of its own."""
    rows, want, all_tables = [], {}, {"suppressed": [], "sent": [], "verdicts": []}
    for i, (change, tables, reason) in enumerate(REASONS, 1):
        own = lambda v, i=i: v.replace("harbor.com", f"harbor{i}.com").replace("HARBOR.com", f"HARBOR{i}.com") if isinstance(v, str) else i if v == 1 and v is not True else v
        rows.append({k: own(v) if isinstance(v, str) or k.endswith("_id") else v for k, v in {**CANDIDATE, **change}.items()})
        for name, more in tables.items():
            all_tables[name] += [tuple(map(own, m)) if isinstance(m, tuple) else own(m) for m in more]
        want[i] = reason
    got = staged(spark, rows, **all_tables)
    assert {i: r for i, (r, _) in got.items()} == want
    assert all((snapshot is not None) == (reason is None) for reason, snapshot in got.values())


def test_one_message_a_company_and_the_cap(spark):
    rows = [{"contact_id": i, "company_id": 10 + i // 2, "domain": f"harbor{i // 2}.com", "email": f"jo{i}@gmail.com", "opportunity_score": 50.0 + i // 2} for i in range(8)]
    rows += [{"contact_id": 90, "company_id": 90, "email": "jo7@gmail.com"}, {"contact_id": 91, "company_id": 91, "domain": "x.local", "website_url": None, "email": "jo91@gmail.com", "opportunity_score": 1.0}]
    got = staged(spark, rows, cap=3)
    assert [i for i, (reason, _) in sorted(got.items()) if reason is None] == [6, 90, 91]  # no website first, then 70 and 53
    assert {got[i][0] for i in (1, 3, 5, 7)} == {"already_contacted"} and {got[i][0] for i in (0, 2, 4)} == {"daily_limit"}
    assert got[6][1] == '{"segment":"speed_optimization","opportunities_count":0}'
    assert staged(spark, [{}], cap=0)[1][0] == "daily_limit" and staged(spark, []) == {}


def test_warm_up_days(spark):
    days = spark.range(0, 20).select(staging.warmup_limit(F.lit("2026-01-01").cast("date"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int"))).alias("n"))
    assert [r.n for r in days.collect()] == [5] * 3 + [15] * 4 + [30] * 7 + [50] * 6
    assert spark.range(1).select(staging.warmup_limit(F.lit("2026-01-01").cast("date"), F.lit("2026-01-01").cast("date"), F.lit(7)).alias("n")).first().n == 7


AUDIT = "company_id long, lighthouse_score int, homepage_ms int, https boolean, cert_days int, cert_valid boolean, exposed_users boolean, has_schema boolean, broken_social boolean, deliverability_risk boolean, broken_links int, speed_discrepancy boolean, ttfb_ms int, missing_tel_link boolean, max_form_inputs int, sticky_cta boolean, lcp_ms int, legacy_images int"


def test_report_numbers(spark):
    rows = [
        (1, 90, 100, True, 60, True, False, True, False, False, 0, False, 100, False, 3, True, 1000, 0),  # (90 + 100 + 100) / 3
        (2, None, 1800, False, 10, False, True, False, True, True, 2, True, 800, True, 7, False, 0, 3),  # 60, 10, 15
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),  # 33, 60, 75
        (4, 0, 9000, True, 29, True, False, True, False, False, 0, False, 799, False, 6, True, 2500, 2),  # 0, 70, 100
    ]
    frame = spark.createDataFrame(rows, AUDIT)
    assert [(r.health, r.label) for r in pages.health_score(frame).orderBy("company_id").collect()] == [(96, "good"), (28, "poor"), (56, "fair"), (56, "fair")]
    assert [tuple(r) for r in pages.pillar_summary(frame).orderBy("company_id").collect()] == [(1, 0, 0, 0, 0), (2, 1, 3, 3, 3), (3, 1, 1, 1, 1), (4, 1, 0, 0, 1)]
    passed = {}
    for r in pages.audit_findings(frame).collect():
        passed.setdefault(r.company_id, {})[r.check] = r.passed
    assert [len(passed[i]) for i in (1, 2, 3, 4)] == [14, 12, 12, 14] and all(passed[1].values()) and [k for k, v in passed[2].items() if v] == ["homepage_load"]
    assert [k for k, v in passed[4].items() if not v] == ["homepage_load", "pagespeed_performance", "largest_contentful_paint", "certificate"]
