"""Input views over the given tables, in SQL that Spark and DuckDB both read. Table names stand in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-01-31 12:00:00"

COMPANIES = """
SELECT c_custkey AS id,
  CASE c_custkey % 8 WHEN 0 THEN 'Acme Software Development LLC' WHEN 1 THEN 'Bright Dental, LLC' WHEN 2 THEN 'Harbor Fashion Group'
    WHEN 3 THEN 'Codebase Partners' WHEN 4 THEN 'North Freight Co' WHEN 5 THEN 'Corner Cafe Inc.' WHEN 6 THEN 'Lake Realty & Sons PC' ELSE 'Plain Works' END
    || ' ' || CAST(c_custkey % 97 AS STRING) AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'biz' || CAST(c_custkey AS STRING) || '.local' WHEN c_custkey % 11 = 0 THEN 'shop' || CAST(c_custkey % 40 AS STRING) || '.yelp.com'
    WHEN c_custkey % 13 = 0 THEN 'fine' || CAST(c_custkey AS STRING) || '.studio' ELSE 'biz' || CAST(c_custkey % 1000 AS STRING) || '.com' END AS domain,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'https://www.Biz' || CAST(c_custkey % 1000 AS STRING) || '.com:8080/Path?q=' || CAST(c_custkey AS STRING) END AS website_url,
  CASE c_custkey % 9 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Healthcare' WHEN 2 THEN 'IT Services' WHEN 3 THEN lower(c_mktsegment) WHEN 4 THEN '' WHEN 5 THEN 'Mobile App Development'
    WHEN 6 THEN 'Real Estate' WHEN 7 THEN NULL ELSE 'Plumbing' END AS industry,
  CASE c_custkey % 10 WHEN 0 THEN '10 - 49' WHEN 1 THEN '500 - 999' WHEN 2 THEN '1,000+' WHEN 3 THEN '5' WHEN 4 THEN 'mid-size' WHEN 5 THEN NULL WHEN 6 THEN '50 to 249'
    WHEN 7 THEN '300-400' WHEN 8 THEN 'unknown' ELSE '12+' END AS employees,
  CASE c_custkey % 5 WHEN 0 THEN 'clutch' WHEN 1 THEN 'google_maps' WHEN 2 THEN 'job_feed' WHEN 3 THEN 'Yelp_AU' ELSE 'local_business_directory' END AS source,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(CASE WHEN c_custkey % 2 = 0 THEN '2026-01-' ELSE '2025-12-' END || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || ' 08:00:00' AS TIMESTAMP) END AS last_crawled_at,
  CASE c_custkey % 4 WHEN 0 THEN 'San Jose' WHEN 1 THEN 'Miami' WHEN 2 THEN '' ELSE 'New York, NY' END AS city,
  c_acctbal AS balance
FROM {customer}
"""
SIGNALS = """
SELECT event_id AS id, user_id AS company_id,
  CASE event_id % 9 WHEN 0 THEN 'client_past_spend_verified' WHEN 1 THEN 'directory_client_review' WHEN 2 THEN 'active_hiring_intent' WHEN 3 THEN 'hiring_ats_detected'
    WHEN 4 THEN 'career_page_detected' WHEN 5 THEN 'funding_round' WHEN 6 THEN 'company_signal_scale' WHEN 7 THEN 'missing_phone' ELSE event_type END AS type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 101 END AS confidence, ts
FROM {events}
"""
TECH = """
SELECT c_custkey AS company_id, CASE c_custkey % 5 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Joomla' WHEN 2 THEN '' ELSE NULL END AS cms,
  CASE WHEN c_custkey % 5 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN '5.' || CAST(c_custkey % 9 AS STRING) || '.1' WHEN 1 THEN '6.' || CAST(c_custkey % 4 AS STRING) ELSE '' END END AS wp_version,
  CASE c_custkey % 7 WHEN 0 THEN '1.12.4' WHEN 1 THEN '3.7.1' WHEN 2 THEN '2.2.0' WHEN 3 THEN '' ELSE NULL END AS jquery_version,
  CASE WHEN c_custkey % 19 = 0 THEN '1.8' END AS angular_version,
  c_custkey % 6 <> 0 AS https, c_custkey % 4 <> 0 AS hsts, c_custkey % 23 = 0 AS speed_discrepancy,
  (c_custkey * 37) % 6000 AS homepage_ms, (c_custkey * 53) % 2500 AS ttfb_ms, c_custkey % 10 AS max_form_inputs, c_custkey % 3 = 0 AS has_schema,
  CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 5 ELSE 0 END AS broken_links, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 END AS lighthouse_score,
  CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 90 END AS cert_days,
  c_custkey % 12 = 1 AS missing_tel_link, c_custkey % 10 = 2 AS broken_social, c_custkey % 9 = 3 AS deliverability_risk, c_custkey % 31 = 4 AS exposed_users,
  CASE WHEN c_custkey % 14 = 5 THEN 'laravel' END AS skill, c_custkey % 2 = 1 AS cert_checked, c_custkey % 4 = 1 AS cert_valid, c_custkey % 13 = 6 AS image_issues,
  c_custkey % 15 < 7 AS sticky_cta, c_custkey % 6 AS legacy_images, CASE WHEN c_custkey % 3 <> 2 THEN (c_custkey * 71) % 5000 END AS lcp_ms
FROM {customer}
"""
SCORES = """
SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderkey % 101 AS DOUBLE) AS opportunity_score,
  CASE o_orderkey % 5 WHEN 0 THEN 'ignore' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'immediate' ELSE 'nurture' END AS priority_tier, o_orderdate AS scored_at
FROM {orders}
"""
OUTCOMES = """
SELECT o_orderkey AS id, 'source' || CAST(o_custkey % 12 AS STRING) AS source, CAST(o_orderkey % 101 AS DOUBLE) AS opportunity_score,
  o_orderkey % 2 = 0 AS opened, o_orderkey % 5 = 0 AS replied, o_orderkey % 13 = 0 AS closed_won, CASE WHEN o_orderkey % 13 = 0 THEN floor(o_totalprice) * 1.0 END AS revenue
FROM {orders}
"""
BOUNCES = """
SELECT event_id AS id, 'user' || CAST(user_id % 50 AS STRING) || '@mail' || CAST(user_id % 7 AS STRING) || '.com' AS email, ts,
  CASE event_id % 6 WHEN 0 THEN '5.1.1' WHEN 1 THEN '4.2.2' WHEN 2 THEN NULL WHEN 3 THEN '2.0.0' WHEN 4 THEN '' ELSE '4.7.1' END AS dsn,
  CASE event_id % 7 WHEN 0 THEN 'User unknown in table' WHEN 1 THEN 'Mailbox full, try again' WHEN 2 THEN 'This was marked as SPAM complaint' WHEN 3 THEN 'smtp; 554 rejected' ELSE 'deferred by host' END AS body,
  CASE event_id % 4 WHEN 0 THEN 'Delivery Status Notification' WHEN 1 THEN 'Re: hello' WHEN 2 THEN 'Returned mail' ELSE 'Abuse report' END AS subject,
  CASE event_id % 3 WHEN 0 THEN 'MAILER-DAEMON@x.com' WHEN 1 THEN 'bob@y.com' ELSE 'postmaster@z.org' END AS sender
FROM {events}
"""
REPLIES = """
SELECT conv_id * 1000 + turn AS id, conv_id, role AS subject,
  CASE (conv_id + turn) % 9 WHEN 0 THEN 'I am out of the office until Monday' WHEN 1 THEN 'Please remove me from this' WHEN 2 THEN 'Sounds great, tell me more' WHEN 3 THEN 'Who is this?'
    WHEN 4 THEN 'ok' WHEN 5 THEN 'We already have a team' WHEN 6 THEN 'Yes' ELSE '' END || ' ' || coalesce(text, '') AS body
FROM {conversations}
"""
FAILURES = """
SELECT event_id AS id, user_id AS company_id, CASE WHEN user_id % 9 = 0 THEN 'a.yelp.com' WHEN user_id % 10 = 0 THEN '' ELSE 'biz' || CAST(user_id AS STRING) || '.com' END AS domain,
  CASE event_id % 6 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 503 busy' WHEN 2 THEN 'Could not resolve host' WHEN 3 THEN 'timeout' WHEN 4 THEN 'HTTP  403' ELSE 'reset' END AS error, event_id % 6 AS retry_count, ts
FROM {events}
"""
RUNS = """
SELECT event_id AS id, CASE user_id % 6 WHEN 0 THEN 'scoring' WHEN 1 THEN 'audit' WHEN 2 THEN 'enrichment' WHEN 3 THEN 'bounce_check' WHEN 4 THEN 'outreach' ELSE 'discovery' END AS stage_name,
  CASE event_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status, ts AS started_at, event_id % 40 AS items_processed, (event_id * 7) % 900 AS duration_seconds
FROM {events}
"""
CONTACTS = """
SELECT s_suppkey AS id, s_suppkey % 40 AS company_id, CASE s_suppkey % 9 WHEN 0 THEN 'info' WHEN 1 THEN 'a..b' WHEN 2 THEN '.jo' WHEN 3 THEN '' WHEN 4 THEN 'support.team' WHEN 5 THEN 'x@y' ELSE 'jane' || CAST(s_suppkey % 30 AS STRING) END
  || '@' || CASE s_suppkey % 6 WHEN 0 THEN 'biz.com' WHEN 1 THEN '-bad.com' WHEN 2 THEN 'nodot' WHEN 3 THEN 'sub.biz.c' WHEN 4 THEN 'biz.c0m' ELSE 'biz.co.uk' END AS email,
  CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'bounced' WHEN 2 THEN 'unverified' ELSE 'catch_all' END AS email_status
FROM {supplier}
"""


def tables(view: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", view)))


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a DataFrame over the tables of a folder."""
    return spark.sql(view, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(view)})


def sql(view: str) -> str:
    """A view as a subquery for the other engine."""
    return "(" + view.format(**{t: t for t in tables(view)}).strip() + ")"
