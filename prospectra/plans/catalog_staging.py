"""Queries of outreach staging; importing this module adds them to the catalog. The SQL has the rules' values of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.operators import staging
from prospectra.plans import views as V
from prospectra.plans.catalog import query
from prospectra.plans.catalog_leads import LATEST

PEOPLE = """
SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'unverified' ELSE 'valid' END AS email_status,
  CASE o_orderkey % 5 WHEN 0 THEN 'email_permutator' WHEN 1 THEN 'canonical_synthesizer' WHEN 2 THEN NULL ELSE 'website' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'smtp_handshake' END AS verification_source,
  ' P' || CAST(o_orderkey % 3000 AS STRING) || CASE o_orderkey % 9 WHEN 0 THEN '@city.gov.uk' WHEN 1 THEN '@x.Local' WHEN 2 THEN '@yelp.com' WHEN 3 THEN '@shop.com.au' WHEN 4 THEN '@notyelp.com' WHEN 5 THEN '@qq.com' ELSE '@shop.com' END AS email
FROM {orders}
"""
MARKS = "SELECT user_id AS company_id, CASE WHEN event_id % 60 = 0 THEN 'crawl_audit_failed' ELSE event_type END AS type FROM {events}"
SENT = "SELECT event_id AS contact_id, CASE WHEN event_id % 70 = 1 THEN user_id END AS company_id, 'p' || CAST(event_id % 2000 AS STRING) || '@shop.com' AS recipient FROM {events}"
BARRED = " AND ".join(
    f"lower(email) NOT LIKE '{p}'"
    for p in (
        "%.local", "%.gov%", "%.mil%", "%.edu%", "%.sg", "%.fi", "%.co.nz", "%.com.hk", "%.com.au", "%@qq.com", "%@163.com", "%@126.com", "%@realtor.com", "%@cpadirectory.com", "%@yellowpages.com", "%@yelp.com", "%@angi.com",
        "%@thumbtack.com", "%@angelone.in", "%@remax.com", "%@wxxi.org", "%@digitalrealty.com",
    )
)
PROVEN = "((source NOT IN ('canonical_synthesizer', 'email_permutator') AND email_status IN ('valid', 'catch_all')) OR (source IN ('canonical_synthesizer', 'email_permutator') AND verification_source = 'smtp_handshake' AND email_status = 'valid'))"
query(
    "outreach_eligible",
    f"SELECT c.id AS company_id, s.opportunity_score, s.priority_tier, (c.website_url IS NULL OR c.domain LIKE '%.local') AS no_website FROM {V.sql(V.COMPANIES)} c JOIN {LATEST} s ON s.company_id = c.id WHERE s.opportunity_score >= 50 "
    f"AND (c.last_crawled_at IS NOT NULL OR c.website_url IS NULL OR c.domain LIKE '%.local') AND s.priority_tier NOT IN ('ignore', 'disqualified', 'pending_audit') AND NOT EXISTS (SELECT 1 FROM {V.sql(MARKS)} m WHERE m.company_id = c.id AND m.type = 'crawl_audit_failed') "
    f"AND NOT EXISTS (SELECT 1 FROM {V.sql(SENT)} o WHERE o.company_id = c.id) AND EXISTS (SELECT 1 FROM (SELECT *, lower(trim(email)) AS mail FROM {V.sql(PEOPLE)} p WHERE {BARRED} AND {PROVEN}) k WHERE k.company_id = c.id AND NOT EXISTS (SELECT 1 FROM {V.sql(SENT)} o2 WHERE o2.recipient = k.mail))",
)(lambda spark, d: staging.outreach_eligible(*(V.frame(spark, d, v) for v in (V.COMPANIES, V.SCORES, PEOPLE, MARKS, SENT)), limit=None))

CANDIDATES = """
SELECT o_orderkey AS contact_id, o_custkey AS company_id, CASE WHEN o_custkey % 6 = 0 THEN 'harbor-' || CAST(o_custkey AS STRING) || '.local' WHEN o_custkey % 19 = 0 THEN '' ELSE 'firm' || CAST(o_custkey AS STRING) || '.com' END AS domain, 'Harbor Cafe' AS name,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'https://f.com' END AS website_url, CASE WHEN o_custkey % 4 = 0 THEN o_orderdate END AS last_crawled_at, CAST(o_custkey % 101 AS DOUBLE) AS opportunity_score,
  CASE WHEN o_custkey % 5 = 0 THEN 'WordPress' END AS cms, CASE WHEN o_custkey % 7 = 0 THEN 61 END AS performance_score, CASE WHEN o_custkey % 11 = 0 THEN 2600 END AS lcp_ms, o_custkey % 2 AS n_opportunities, o_custkey % 23 = 0 AS hiring,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'speed_optimization' END AS segment, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Hi' END AS body,
  CASE o_orderkey % 8 WHEN 0 THEN 'bounced' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'unverified' ELSE 'valid' END AS email_status, CASE o_orderkey % 5 WHEN 0 THEN 'email_permutator' ELSE 'website' END AS source,
  CASE WHEN o_orderkey % 3 = 0 THEN 'smtp_handshake' END AS verification_source,
  CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'j@firm.com' WHEN 2 THEN 'jo@city.gov' WHEN 3 THEN 'Jo' || CAST(o_orderkey AS STRING) || '@oak.io' WHEN 4 THEN 'jo' || CAST(o_orderkey % 50 AS STRING) || '@gmail.com' ELSE 'jo' || CAST(o_orderkey AS STRING) || '@firm' || CAST(o_custkey AS STRING) || '.com' END AS email
FROM {orders}
"""
STOP = "SELECT 'JO' || CAST(s_suppkey % 20 AS STRING) || '@Gmail.com' AS email FROM {supplier}"
GONE = "SELECT event_id * 4 AS contact_id, CASE WHEN event_id % 97 = 0 THEN user_id END AS company_id, 'jo' || CAST(event_id AS STRING) || '@oak.io' AS recipient FROM {events}"
JUDGED = "SELECT 'Jo' || CAST(l_orderkey AS STRING) || '@firm' || CAST(o_custkey AS STRING) || '.com' AS email, l_linenumber <> 3 AS deliverable, CASE l_partkey % 9 WHEN 0 THEN 'risky' WHEN 1 THEN 'catch_all' ELSE 'valid' END AS status FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"
CAP = 40
BARE = "(website_url IS NULL OR domain LIKE '%.local')"
KNOWN = f"(last_crawled_at IS NOT NULL OR cms IS NOT NULL OR performance_score > 0 OR lcp_ms > 0 OR n_opportunities > 0 OR hiring OR {BARE})"
GATE = f"CASE WHEN split_part(mail, '@', 1) = 'j' THEN 'blocked_prefix' WHEN {BARE} AND split_part(mail, '@', 2) NOT IN ('gmail.com') AND NOT starts_with(split_part(mail, '@', 2), 'har') THEN 'custom_domain_mismatch' WHEN domain = '' AND split_part(mail, '@', 2) <> 'gmail.com' THEN 'custom_domain_mismatch' END"
REASON = (
    f"CASE WHEN NOT coalesce({KNOWN}, false) THEN 'nothing_known' WHEN mail IN (SELECT lower(email) FROM {V.sql(STOP)} s) THEN 'suppressed' WHEN mail = '' THEN 'no_email' WHEN mail LIKE '%.gov' THEN 'blocked_domain' WHEN email_status NOT IN ('valid', 'catch_all') THEN 'unusable_status' "
    f"WHEN source = 'email_permutator' AND (verification_source IS NULL OR email_status <> 'valid') THEN 'unverified_guess' WHEN company_id IN (SELECT company_id FROM {V.sql(GONE)} g WHERE company_id IS NOT NULL) OR mail IN (SELECT recipient FROM {V.sql(GONE)} g) OR contact_id IN (SELECT contact_id FROM {V.sql(GONE)} g) THEN 'already_contacted' "
    f"WHEN domain = '' AND NOT {BARE} THEN 'no_domain' WHEN {GATE} IS NOT NULL THEN {GATE} WHEN mail IN (SELECT lower(email) FROM {V.sql(JUDGED)} j WHERE NOT (deliverable AND status IN ('valid', 'catch_all'))) THEN 'undeliverable' WHEN segment IS NULL OR body = '' THEN 'no_evidence' END"
)
ONCE = "QUALIFY row_number() OVER (PARTITION BY reason IS NULL, {} ORDER BY contact_id) = 1"
query(
    "stage_messages",
    f"WITH judged AS MATERIALIZED (SELECT *, {REASON} AS reason FROM (SELECT *, lower(trim(coalesce(email, ''))) AS mail FROM {V.sql(CANDIDATES)} c) m), "
    f"a AS (SELECT contact_id FROM judged WHERE reason IS NULL {ONCE.format('company_id')}), b AS (SELECT contact_id FROM judged WHERE reason IS NULL AND contact_id IN (SELECT contact_id FROM a) {ONCE.format('mail')}), "
    f"t AS (SELECT contact_id FROM judged WHERE contact_id IN (SELECT contact_id FROM b) ORDER BY {BARE} DESC, opportunity_score DESC, company_id LIMIT {CAP}) "
    "SELECT contact_id, CASE WHEN reason IS NOT NULL THEN reason WHEN contact_id NOT IN (SELECT contact_id FROM b) THEN 'already_contacted' WHEN contact_id NOT IN (SELECT contact_id FROM t) THEN 'daily_limit' END AS reject_reason FROM judged",
)(
    lambda spark, d: staging.stage_messages(V.frame(spark, d, CANDIDATES).withColumn("frontend_stack", F.array().cast("array<string>")), V.frame(spark, d, STOP), V.frame(spark, d, GONE), V.frame(spark, d, JUDGED), CAP).select("contact_id", "reject_reason")
)
DAYS = "(SELECT CAST(ts AS DATE) AS day, count(*) AS n_sent, min(CAST(ts AS DATE)) OVER () AS first_day FROM events GROUP BY 1)"
query("warmup_schedule", f"SELECT CAST(day AS VARCHAR) AS day, n_sent, CASE WHEN date_diff('day', first_day, day) < 3 THEN 5 WHEN date_diff('day', first_day, day) < 7 THEN 15 WHEN date_diff('day', first_day, day) < 14 THEN 30 ELSE 50 END AS cap FROM {DAYS} v")(
    lambda spark, d: sending_days(spark, d)
)


def sending_days(spark, d):
    from prospectra.operators.feeds import daily_send_count

    days = daily_send_count(spark.read.parquet(f"{d}/events.parquet").select("ts"))
    first = days.agg(F.min("day").alias("first_day"))
    # one row
    return days.join(F.broadcast(first)).select(F.col("day").cast("string").alias("day"), "n_sent", staging.warmup_limit(F.col("first_day"), F.col("day")).alias("cap"))
