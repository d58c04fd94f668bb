"""Golden vectors of the column functions, sequential folds against plain loops, streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.functions import text as T
from prospectra.operators import feeds, outreach, pages, relational, scoring
from prospectra.streaming import feeds as streams


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names_and_domains(spark):
    urls = ["HTTP://EXAMPLE.COM:8080/test", "http://sub.domain.co.uk/path/to/page?query=1", "", None, " www.a.org "]
    assert column(spark, urls, T.normalize_domain) == ["example.com", "sub.domain.co.uk", "", "", "a.org"]
    assert column(spark, ["Dr. Smith DDS & Associates PC", "Aspen Dental, LLC", None], T.normalize_company_name) == ["dr-smith-associates", "aspen-dental", ""]
    excluded = column(spark, ["business.yellowpages.com.au", "test.local", "", "sydneyplumbing.com.au", "notyelp.com"], lambda c: D.is_excluded_domain(c)["excluded"])
    assert excluded == [True, True, True, False, False]


def test_retryable(spark):
    rows = [(404, ""), (410, ""), (503, ""), (None, "timeout"), (None, "Name or service not known"), (200, "DNS_PROBE_FINISHED_NXDOMAIN")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, e string")
    assert [r.x for r in df.select("i", D.is_retryable_failure(F.col("s"), F.col("e")).alias("x")).orderBy("i").collect()] == [False, False, True, True, False, False]


def test_emails_and_roles(spark):
    bad = column(spark, ["jane@biz.com", "a..b@biz.com", ".a@biz.com", "a@b@c.com", "a@biz", "a@-biz.com", "a@biz.c", "a@biz.c0m", "", None, "x" * 65 + "@a.com"], D.validate_email_syntax)
    assert bad == [None, "local_dots", "local_edge_dot", "several_at", "no_tld", "label_edge_hyphen", "tld_too_short", "tld_invalid", "empty", "empty", "local_too_long"]
    assert column(spark, ["support+tier1@x.com", "billing-team@x.com", "jane@x.com", None], outreach.role_account) == ["support", "billing", None, None]
    assert column(spark, ["Mail A.B@X.com, or c@d.org; logo@2x.png A.B@x.com"], T.extract_emails) == [["a.b@x.com", "c@d.org"]]


def test_employees_and_confidence(spark):
    got = column(spark, ["10 - 49", "1,000+", "5", "50 to 249", "mid", None], lambda c: T.parse_employee_bounds(c))
    assert [(g.lo, g.hi) if g else None for g in got] == [(10, 49), (1000, 2000), (5, 5), (50, 249), None, None]
    assert column(spark, ["0.5", "85", "junk", None, "-1", "250"], T.normalize_confidence) == [0.5, 0.85, 1.0, 1.0, 0.0, 1.0]


def test_generated_text_and_phone(spark):
    raw = "<think>hm</think>**Subject: Your site**\nHello\nthere"
    got = column(spark, [raw], T.clean_generated_text)[0]
    assert (got.subject, got.body) == ("Your site", "Hello\nthere")
    assert [p and p.national for p in column(spark, ["+1 (305) 555-0100", "12345", None], T.normalize_phone)] == ["(305) 555-0100", None, None]


def test_scores(spark):
    c = spark.createDataFrame([(1, "Shop", "shop.com", "Retail", "500 - 999", "x"), (2, "Shop", "shop.com", "Retail", "10 - 49", "x"), (3, "X", "x.dev", "IT Services", "5", "clutch")], "id int, name string, domain string, industry string, employees string, source string")
    assert [r.company_fit for r in scoring.company_fit(c).orderBy("id").collect()] == [70.0, 90.0, 0.0]
    ages = spark.sql("select timestamp'2026-01-31 12:00:00' as now, timestamp'2026-01-11 12:00:00' as a, timestamp'2025-12-27 12:00:00' as b, cast(null as timestamp) as c")
    got = ages.select(*(scoring.staleness(F.col(k), F.col("now")).alias(k) for k in "abc")).first()
    assert [(x.factor, x.recrawl) for x in got] == [(0.88, False), (0.7, True), (1.0, False)]
    p = spark.createDataFrame([(1, "a", "high", 1.0, 0), (1, "b", "high", 1.0, 1), (1, "c", "critical", 1.0, 2), (1, "a", "critical", 1.0, 3)], "company_id int, type string, severity string, confidence double, position int")
    assert scoring.pain_signal(p).first().pain_signal == 95.0
    s = spark.createDataFrame([(1, "hiring_skill_match", None, ["laravel", "react"]), (2, "other", 50, None)], "company_id int, type string, confidence int, skills array<string>")
    assert {r.company_id: r.buying_signal for r in scoring.buying_signal(s).collect()} == {1: 65.0, 2: 25.0}


def test_version_debt(spark):
    df = spark.createDataFrame([("jquery", "1.8.3"), ("jquery", "3.7.1"), ("wordpress", "5.4.1"), ("leftpad", "1.0")], "l string, v string")
    got = [r.d for r in df.select(pages.version_debt(F.col("l"), F.col("v"), 2026).alias("d")).collect()]
    assert [(d.eol, d.major_gap, d.risk) if d else None for d in got] == [(True, 2, "critical"), (False, 0, "low"), (True, 1, "critical"), None]


def test_greedy_two_keys_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, f"d{rng.randrange(25)}", f"n{rng.randrange(25)}") for i in range(120)]
    seen_d, seen_n, want = set(), set(), []
    for i, d, n in rows:
        if d not in seen_d and n not in seen_n:
            seen_d.add(d)
            seen_n.add(n)
            want.append(i)
    got = relational.greedy_two_keys(spark.createDataFrame(rows, "id int, d string, n string"), "d", "n", "id")
    assert sorted(r.id for r in got.collect()) == want


def test_greedy_two_keys_settles_a_long_chain(spark):
    """Row i shares a key with the next one; every other row is accepted, one a round, and nothing is left over."""
    rows = [(i, f"d{(i + 1) // 2}", f"n{i // 2}") for i in range(1, 107)] + [(200, None, "x"), (201, None, "y")]
    got = relational.greedy_two_keys(spark.createDataFrame(rows, "id int, d string, n string"), "d", "n", "id")
    assert sorted(r.id for r in got.collect()) == [*range(1, 107, 2), 200]


def test_folds_hold_no_whole_key(spark):
    """One key over many batches: the fold carries its state from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select("id", F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") / 10).alias("v"), F.lit("low").alias("tier"))
        for found in (relational.spaced_events(df, ["k"], "ts", 600), relational.changed_rows(df, "k", "id", ["v"], "tier", 0.999)):
            assert sorted(r.id for r in found.collect()) == list(range(0, 100, 10))
            assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folds_against_loops(spark):
    rng = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    rows = [(i, f"e{rng.randrange(3)}", "soft_bounce", start + dt.timedelta(minutes=rng.randrange(20000))) for i in range(80)]
    last, want = {}, []
    for i, e, _, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if e not in last or t - last[e] >= dt.timedelta(days=1):
            last[e] = t
            want.append(i)
    df = spark.createDataFrame(rows, "id int, email string, bounce_type string, ts timestamp")
    assert sorted(r.id for r in feeds.bounce_dedup(df).collect()) == sorted(want)
    drift = spark.createDataFrame([(i, 1, 50 + i * 0.004, "low") for i in range(10)], "id int, k int, v double, tier string")
    assert [r.id for r in relational.changed_rows(drift, "k", "id", ["v"], "tier").orderBy("id").collect()] == [0, 3, 6, 9]


def test_page_contacts_keeps_all_addresses(spark, tmp_path):
    from prospectra.plans import catalog, catalog_rest  # noqa: F401

    spark.createDataFrame([(1, " ".join(f"u{i}@biz.com" for i in range(1500)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.QUERIES["page_contacts"](spark, str(tmp_path)).count() == 1500


def test_merge_and_any_joins(spark):
    old = spark.createDataFrame([("a", "A", "x"), ("b", "", "y")], "domain string, name string, industry string")
    new = spark.createDataFrame([("b", "B", None), ("c", "C", "z")], "domain string, name string, industry string")
    got = sorted(tuple(r) for r in relational.merge_snapshot(old, new, "domain", ["name"], ["industry"]).collect())
    assert got == [("a", "A", "x"), ("b", "B", "y"), ("c", "C", "z")]
    left = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id int, k string")
    other = spark.createDataFrame([(1, "r")], "oid int, ok string")
    pairs = [(other, "id", "oid"), (other, "k", "ok")]
    assert [r.id for r in relational.anti_any(left, pairs).collect()] == [2]
    assert sorted(r.id for r in relational.semi_any(left, "id", pairs).collect()) == [1, 3]


@pytest.fixture()
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    base = spark.range(200).select(
        F.col("id"), F.col("id").alias("company_id"), F.concat(F.lit("biz"), "id", F.lit(".com")).alias("domain"), F.when(F.col("id") % 3 == 0, "HTTP 503").otherwise("HTTP 404").alias("error"),
        (F.col("id") % 6).cast("int").alias("retry_count"), (F.lit("2026-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"),
        F.concat(F.lit("u"), F.col("id") % 40, F.lit("@x.com")).alias("email"), F.lit("4.2.2").alias("dsn"), F.lit("mailbox full").alias("body"), F.lit("Returned mail").alias("subject"), F.lit("postmaster@x").alias("sender"),
    )
    base.write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(base.schema).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batches(events):
    batch, stream = events
    assert sorted(map(str, drain(streams.retry_stream(stream), "retries").collect())) == sorted(map(str, feeds.retry_schedule(batch).collect()))
    soft = batch.withColumn("bounce_type", F.lit("soft_bounce"))
    got = drain(streams.soft_bounce_state(stream.withColumn("bounce_type", F.lit("soft_bounce"))), "soft", "complete").where("suppress")
    assert sorted((r.email, r.n_soft) for r in got.collect()) == sorted((r.email, r.n_soft) for r in feeds.soft_bounce_promotion(soft).collect())
    once = drain(streams.bounce_stream(stream), "bounces")
    assert once.select("email").distinct().count() == 40 and once.count() == once.select("email", "bounce_type").distinct().count()


def test_ingest_candidates_in_order_of_arrival(spark):
    from prospectra.operators import intake

    old = spark.createDataFrame([(1, "Old Firm LLC", "old.com")], "id long, name string, domain string")
    rows = [
        (1, "Bright Dental", "https://www.bright.com/x", None, "clinic", "clutch_client", None),
        (2, "Bright Dental, LLC", "other.com", None, "", "a", None),  # name of 1
        (3, "Third", "other.com", None, "Masonry", "a", None),  # row 2 blocks nothing
        (4, "Acme Software Development", "acme.com", None, None, "a", None),  # agency
        (5, "old firm", "new.com", None, None, "a", None),  # known name
        (6, "Any", "OLD.com", None, None, "a", None),  # known domain
        (7, "No Domain", "", None, None, "a", None),
        (8, "", "blank1.com", None, None, "a", "freight"),
        (9, None, "", "http://blank2.com", None, "some_review", "text"),
    ]
    new = spark.createDataFrame(rows, "id long, name string, domain string, website_url string, industry string, source string, summary string")
    taken, signals = intake.ingest_candidates(new, old)
    assert sorted((r.id, r.domain, r.industry) for r in taken.collect()) == [
        (1, "bright.com", "Healthcare & Life Sciences"), (3, "other.com", "Masonry"), (8, "blank1.com", "Logistics & Supply Chain"), (9, "blank2.com", "Commercial Business & Services"),
    ]
    assert sorted((r.domain, r.detail) for r in signals.collect()) == [("blank2.com", "text"), ("bright.com", "Verified client review case study")]
    assert intake.ingest_candidates(new.limit(0), old)[0].count() == 0


def test_ingest_listings_splits_by_website(spark):
    from prospectra.operators import intake

    rows = [(1, "Bay Spa", "Miami", None), (2, "Bay Spa", "Miami", "bay.com"), (3, "Bay Spa", "Tampa", "bay.com"), (4, "Old", "Miami", "http://old.com")]
    frame = spark.createDataFrame(rows, "id long, name string, city string, website_url string")
    for c in ("phone", "rating", "review_count"):
        frame = frame.withColumn(c, F.lit(None).cast("string"))
    listed = intake.normalize_local_listings(frame.withColumn("categories", F.array(F.lit("day_spa"))))
    out = intake.ingest_listings(listed, spark.createDataFrame([("old.com", "Else", "X")], "domain string, name string, city string"))
    assert sorted((r.domain, r.priority_tier, r.opportunity_score) for r in out["scores"].collect()) == [("bay-spa-miami.local", "immediate", 100.0), ("bay.com", "pending_audit", 0.0)]
    assert [r.type for r in out["opportunities"].collect()] == ["new_website_creation"] and out["signals"].count() == 1


def test_golden_versions_and_fields(spark):
    from prospectra.functions import extract

    rows = [("angularjs", "1.8.3", True, 0, "critical", 2020), ("jquery", "1.5", True, 2, "critical", 2011), ("jquery", "3.3", False, 0, "critical", 2018), ("wordpress", "6.6", False, 0, "low", 2024), ("react", "0.14.2", True, 18, "critical", 2015), ("vue", "2.7", True, 1, "critical", 2022), ("jquery", "3.7.1", False, 0, "low", 2023)]
    df = spark.createDataFrame(rows, "l string, v string, eol boolean, gap int, risk string, year int")
    assert all(r.d.asDict() == {"release_year": r.year, "major_gap": r.gap, "years_outdated": 2026 - r.year, "eol": r.eol, "risk": r.risk} for r in df.withColumn("d", pages.version_debt(F.col("l"), F.col("v"), 2026)).collect())
    empty = spark.createDataFrame([(None,), ("",)], "c string")
    c = F.col("c")
    none = empty.select(extract.infer_employer_domain(c, c), extract.extract_name_title(c), extract.dsn_code(c, c), extract.bounce_recipient(c, c, c, c)).collect()
    assert all(v is None for r in none for v in r)
    assert [len(r[0]) for r in empty.select(extract.parse_stack(c)).collect()] == [0, 0]


def test_probe_verdicts_do_not_depend_on_the_order_of_answers(spark):
    """Several answers of one host for one address are a tie that the other columns break."""
    from prospectra.operators import outreach

    rows = [("a@m.com", 0, 550, "user unknown", False, "zoho"), ("a@m.com", 0, 250, "ok", True, "custom_smtp"), ("b@m.com", 0, 450, "later", False, "zoho"), ("b@m.com", 0, 0, "no", False, "zoho"), ("b@m.com", 1, 0, "no", False, "zoho")]
    seen = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "email string, mx_idx int, code int, message string, catch_all boolean, provider string").coalesce(1)
        seen.add(str(sorted(map(tuple, outreach.classify_probe(frame).collect()))))
    assert seen == {"[('a@m.com', 'catch_all', 40.0), ('b@m.com', 'connection_failed', 0.0)]"}


def test_buying_score_is_the_sum_of_its_parts(spark):
    from prospectra.operators import scoring

    rows = [(1, 1, "client_past_spend_verified", 30, None), (2, 1, "hiring_skill_match", 90, ["Laravel", "cobol"]), (3, 1, "hiring_skill_match", None, ["React"]), (4, 1, "unknown", 100, None), (5, 2, "career_page_detected", 50, None), (6, 3, "other", None, None), (7, 4, "funding_round", 0, [])]
    frame = spark.createDataFrame(rows, "id int, company_id int, type string, confidence int, skills array<string>")
    parts = {}
    for r in scoring.buying_attribution(frame).collect():
        parts.setdefault(r.company_id, {})[r.reason] = (r.points, list(r.skills))
    assert parts[1] == {"baseline_signals_present": (25.0, []), "past_spend_client_past_spend_verified": (27.0, []), "hiring_skills_capped": (40.0, ["laravel (+27.0)", "cobol (+13.5)", "react (+25.0)"])}
    assert parts[2] == {"baseline_signals_present": (25.0, []), "career_page": (5.0, [])} and parts[3] == {"baseline_signals_present": (25.0, [])}
    assert parts[4] == {"baseline_signals_present": (25.0, []), "growth_funding_round": (0.0, [])}
    scores = {r.company_id: r.buying_signal for r in scoring.buying_signal(frame).collect()}
    assert scores == {c: min(100.0, sum(p for p, _ in x.values())) for c, x in parts.items()}


def test_postings_give_one_signal_a_company(spark):
    from prospectra.operators import intake

    schema = "id int, company_name string, domain string, job_title string, summary string, source string, job_url string, confidence double, default_industry string"
    rows = [
        (1, "Bright Dental", "bright.com", "PHP developer", "x" * 400, "rss", "", None, None), (2, "Bright Dental LLC", "else.com", "Other", None, "rss", "u", 70.0, "Apps"), (3, "Acme Software Development", "acme.com", "Dev", "", "rss", "u", 70.0, "Apps"),
        (4, "Old", "old.com", "Dev", "", "rss", "u", 70.0, "Apps"), (5, "Quiet", "quiet.org", None, None, "rss", None, 75.0, "Apps"), (6, "None", None, "Dev", "", "rss", "u", 70.0, "Apps"),
    ]
    taken, signals = intake.ingest_postings(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "Gone", "old.com")], "id int, name string, domain string"))
    assert sorted((r.domain, r.industry) for r in taken.collect()) == [("bright.com", "Healthcare & Life Sciences"), ("quiet.org", "Apps")]
    got = {r.domain: r for r in signals.collect()}
    assert (got["bright.com"].confidence, got["bright.com"].job_url, len(got["bright.com"].snippet), got["bright.com"].job_title) == (60.0, "https://bright.com", 250, "PHP developer")
    assert (got["quiet.org"].confidence, got["quiet.org"].job_url, got["quiet.org"].snippet) == (75.0, "https://quiet.org", "")
