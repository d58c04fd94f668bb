"""Readers of landed files and the written lead report."""

import json

from pyspark.sql import functions as F

from prospectra.sources import tables


def test_job_answers_as_files(spark, tmp_path):
    board = {"jobs": [{"title": "Engineer", "content": "<p>Build\n things</p>" + "x" * 400, "absolute_url": "https://b/1"}, {"title": None}]}
    (tmp_path / "blue_fox-co.json").write_text(json.dumps(board))
    got = {r.job_title: r for r in tables.read_job_postings_json(spark, str(tmp_path / "*.json"), "ats_greenhouse").collect()}
    assert (got["Engineer"].company_name, got["Engineer"].domain, got["Engineer"].confidence) == ("Blue_fox-co", "bluefoxco.com", None)
    assert got["Engineer"].summary.startswith("Build things x") and len(got["Engineer"].summary) == 350 and got[""].job_url is None
    answer = {"jobs": [{"title": " Dev ", "company_name": " Acme Retail ", "description": "See https://www.acme-retail.com/x", "url": "u"}, {"title": "Other", "company_name": ""}, {"company_name": None}]}
    rows = spark.createDataFrame([(json.dumps(answer),), ("not json",), ("",), (None,), ('{"jobs": null}',)], "payload string")
    (r,) = tables.flatten_job_postings(rows, "remotive_api").collect()
    assert (r.company_name, r.domain, r.website_url, r.job_title, r.confidence) == ("Acme Retail", "acme-retail.com", "https://acme-retail.com", "Dev", 65.0)
    assert all(tables.flatten_job_postings(rows.limit(0).withColumn("slug", F.lit("x")), s).count() == 0 for s in (*tables.JOB_APIS, *tables.HIRING_BOARDS))


def test_feed_as_a_file(spark, tmp_path):
    item = "<item><title>{}</title><link>https://l/{}</link><description>&lt;b&gt;Apply&lt;/b&gt; now</description></item>"
    path = tmp_path / "feed.xml"
    path.write_text("<rss><channel>" + item.format("Acme: PHP developer", 1) + item.format("nobody", 2) + "</channel></rss>")
    (r,) = tables.read_job_feed_xml(spark, str(path), "larajobs").collect()
    assert (r.company_name, r.domain, r.job_title, r.summary, r.source, r.confidence) == ("Acme", "acme.com", "PHP developer", "Apply now", "rss_larajobs", 75.0)
    assert r.default_industry == "Custom Laravel & Web Applications" and r.job_url == "https://l/1"


def test_people_and_speed_payloads(spark):
    people = spark.createDataFrame([(1, '{"people": [{"name": "Ann Lee", "title": null, "email": null}]}'), (2, "{}"), (3, None)], "company_id int, payload string")
    (r,) = tables.flatten_people(people, "people_search").collect()
    assert (r.full_name, r.title, r.role_category, r.email, r.email_score) == ("Ann Lee", "Technical Decision Maker", "technical_executive", None, 85.0)
    listed = spark.createDataFrame([(1, '{"data": {"emails": [{"value": "jo@x.com", "confidence": 0}, {"value": null}]}}')], "company_id int, payload string")
    (r,) = tables.flatten_people(listed, "domain_search").collect()
    assert (r.full_name, r.title, r.role_category, r.email_score) == ("jo", "Unknown", "general", 0.0)
    speed = spark.createDataFrame([("u", '{"categories": {"performance": {"score": 0.29}}, "audits": {"first-contentful-paint": {"numericValue": 99.9}}}'), ("v", "junk")], "url string, payload string")
    got = {r.url: r for r in tables.flatten_lighthouse(speed).collect()}
    assert (got["u"].performance_score, got["u"].fcp_ms, got["u"].cls) == (28, 99, None) and got["v"].performance_score is None


def test_report_is_written_in_order(spark, tmp_path):
    companies = spark.createDataFrame([(i, f"d{i}.com", "N", "s", None, None, "2026") for i in range(1, 5)], "id int, domain string, name string, source string, industry string, employees string, created_at string")
    scores = spark.createDataFrame([(1, 1, 99.0, "high"), (2, 1, 10.0, "low"), (3, 2, 9.96, None), (4, 3, 100.0, "immediate")], "id int, company_id int, opportunity_score double, priority_tier string")
    for c in ("company_fit", "technology_gap", "pain_signal", "buying_signal"):
        scores = scores.withColumn(c, F.lit(None).cast("double"))
    none = spark.createDataFrame([], "id int, company_id int, cms string, frontend_stack string, backend_stack string, https boolean, hsts boolean, ttfb_ms int")
    people = spark.createDataFrame([(1, 3, "A", None, "a@b.com", "bounced"), (2, 3, "B", "CEO", "b@b.com", "valid")], "id int, company_id int, full_name string, title string, email string, email_status string")
    report = tables.lead_report(companies, none, scores, people)
    assert len(report.columns) == 23
    path = str(tmp_path / "out")
    tables.export_leads(report, path)
    lines = [r.value.split(",") for r in spark.read.text(path).where("value not like 'Company ID%'").collect()]
    assert [(x[0], x[3], x[4], x[5], x[8]) for x in lines] == [("3", "IMMEDIATE", "100.0", "B", "VALID"), ("2", "UNSCORED", "10.0", '""', '""'), ("1", "LOW", "10.0", '""', '""'), ("4", "UNSCORED", "N/A", '""', '""')]
    assert {r["Company ID"] for r in tables.lead_report(companies, none, scores, people, 10.0).collect()} == {1, 3}


def test_landed_pages(spark, tmp_path):
    rows = [
        {"domain": "a.com", "source_url": "https://a.com/", "http_status": 200, "headers": {"Server": "x"}, "raw_html": "<p>hi</p>", "ttfb_ms": 12},
        {"source_url": "https://www.B.com/path", "http_status": 404},
        {"domain": "c.com", "source_url": "https://c.com/", "http_status": 200, "raw_html": "partial", "ttfb_ms": 3, "error": "reset"},
        {"domain": "d.com", "source_url": "https://d.com/", "error": "timeout"},
    ]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, rows)) + "\nno record\n{}\n")
    got = {r.domain: r for r in tables.read_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.com", "b.com", "c.com", "d.com"}
    assert (got["a.com"].http_status, got["a.com"].headers, got["a.com"].raw_html, got["a.com"].ttfb_ms) == (200, {"Server": "x"}, "<p>hi</p>", 12)
    assert (got["b.com"].http_status, got["b.com"].headers, got["b.com"].raw_html) == (404, {}, "")
    assert all((got[d].http_status, got[d].headers, got[d].raw_html, got[d].ttfb_ms) == (0, {}, "", None) for d in ("c.com", "d.com"))
