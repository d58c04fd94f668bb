"""Queries of landed payloads and of the lead report; importing this module adds them to the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.operators import leads
from prospectra.plans import views as V
from prospectra.plans.catalog import projection, query
from prospectra.plans.catalog_leads import TITLES
from prospectra.sources import tables

OPEN, CLOSE = "{{", "}}"  # braces of JSON in a view, where single ones name tables


def answers(source: str) -> str:
    """A view of answers of a job API (a notice and an item, some without a company) or of a board (an item); some are broken or null."""
    items, title, *company, text, url = (tables.JOB_APIS[source][:5] if source in tables.JOB_APIS else tables.HIRING_BOARDS[source])
    key, maker = "CAST(p_partkey AS STRING)", "CASE p_partkey % 5 WHEN 0 THEN '' ELSE ' Maker ' || CAST(p_partkey AS STRING) || ' ' END"
    item = f"""'{OPEN}"{title}":"Role ' || {key} || '","{text}":"<p>We <b>hire</b></p> {"word " * 80}","{url}":"https://board/' || {key} || '\""""
    if company:
        item = f"""'{OPEN}"legal":"notice"{CLOSE},' || {item},"{company[0]}":"' || {maker} || '\""""
    array = f"'[' || {item}{CLOSE}]'"
    payload = f"""'{OPEN}"{items}":' || {array} || '{CLOSE}'""" if items else array
    return f"SELECT p_partkey AS id, 'Big-Shop_' || {key} AS slug, CASE WHEN p_partkey % 7 = 0 THEN 'broken {OPEN}' WHEN p_partkey % 11 = 0 THEN NULL ELSE {payload} END AS payload FROM {{part}}"


LONG = "substr('We hire " + "word " * 80 + "', 1, 350)"
POSTED = (
    "SELECT 'Maker ' || CAST(p_partkey AS VARCHAR) AS company_name, 'maker' || CAST(p_partkey AS VARCHAR) || '.com' AS domain, 'https://maker' || CAST(p_partkey AS VARCHAR) || '.com' AS website_url, 'Role ' || CAST(p_partkey AS VARCHAR) AS job_title, "
    f"{LONG} AS summary, 'https://board/' || CAST(p_partkey AS VARCHAR) AS job_url, source, CAST(confidence AS DOUBLE) AS confidence FROM part, (VALUES ('remotive_api', 65.0), ('arbeitnow_api', 60.0), ('jobicy_api', 60.0), ('remoteok_api', 60.0)) s(source, confidence) "
    "WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 UNION ALL "
    "SELECT 'Big-shop_' || CAST(p_partkey AS VARCHAR), 'bigshop' || CAST(p_partkey AS VARCHAR) || '.com', 'https://bigshop' || CAST(p_partkey AS VARCHAR) || '.com', 'Role ' || CAST(p_partkey AS VARCHAR), "
    f"{LONG}, 'https://board/' || CAST(p_partkey AS VARCHAR), source, NULL FROM part, (VALUES ('ats_greenhouse'), ('ats_lever'), ('ats_ashby')) s(source) WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"
)


@query("read_job_postings_json", POSTED)
def postings(spark, d) -> DataFrame:
    found = [tables.flatten_job_postings(V.frame(spark, d, answers(s)), s) for s in (*tables.JOB_APIS, *tables.HIRING_BOARDS)]
    return reduce(DataFrame.unionByName, found)


FEED_ITEMS = "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Firm ' || CAST(s_suppkey AS STRING) || ': PHP developer' WHEN 1 THEN 'Designer at Shop ' || CAST(s_suppkey AS STRING) WHEN 2 THEN 'No company here' ELSE 'Q: x' END AS title, 'https://feed/' || CAST(s_suppkey AS STRING) AS link, '<p>Apply  <i>now</i></p>' AS description FROM {supplier}"
query(
    "read_job_feeds_xml",
    "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Firm ' ELSE 'Shop ' END || CAST(s_suppkey AS VARCHAR) AS company_name, CASE s_suppkey % 4 WHEN 0 THEN 'firm' ELSE 'shop' END || CAST(s_suppkey AS VARCHAR) || '.com' AS domain, CASE s_suppkey % 4 WHEN 0 THEN 'PHP developer' ELSE 'Designer' END AS job_title, "
    "'Apply now' AS summary, 'https://feed/' || CAST(s_suppkey AS VARCHAR) AS job_url, source, CAST(confidence AS DOUBLE) AS confidence, industry AS default_industry FROM supplier, (VALUES ('rss_larajobs', 75.0, 'Custom Laravel & Web Applications'), ('rss_vuejobs', 65.0, 'Modern Frontend & Web Apps')) f(source, confidence, industry) WHERE s_suppkey % 4 < 2",
)(lambda spark, d: tables.flatten_feed_items(V.frame(spark, d, FEED_ITEMS), "larajobs").unionByName(tables.flatten_feed_items(V.frame(spark, d, FEED_ITEMS), "vuejobs")).drop("website_url"))
PERSON = "CASE c_custkey % 3 WHEN 0 THEN '\"Ann\"' ELSE 'null' END"
SEARCHED = f"SELECT c_custkey AS company_id, '{{{{\"people\":[{{{{\"first_name\":' || {PERSON} || ',\"last_name\":\"Lee\",\"title\":\"' || CASE c_custkey % 5 WHEN 0 THEN 'CTO' WHEN 1 THEN 'President' WHEN 2 THEN 'Head of Product' WHEN 3 THEN 'Owner' ELSE '' END || '\",\"email\":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '\"a' || CAST(c_custkey AS STRING) || '@b.com\"' END || '}}}}]}}}}' AS payload FROM {{customer}}"
LISTED = f"SELECT c_custkey AS company_id, '{{{{\"data\":{{{{\"emails\":[{{{{\"value\":\"' || CASE WHEN c_custkey % 4 = 0 THEN 'nobody' ELSE 'a' || CAST(c_custkey AS STRING) || '@b.com' END || '\",\"first_name\":' || {PERSON} || ',\"position\":\"' || CASE c_custkey % 5 WHEN 0 THEN 'Software Architect' WHEN 1 THEN 'Owner' WHEN 2 THEN 'Design' ELSE '' END || '\",\"confidence\":' || CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE CAST(c_custkey % 100 AS STRING) END || '}}}}]}}}}}}}}' AS payload FROM {{customer}}"
query(
    "flatten_people_api",
    "SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'Ann Lee' ELSE 'Lee' END AS full_name, CASE c_custkey % 5 WHEN 0 THEN 'CTO' WHEN 1 THEN 'President' WHEN 2 THEN 'Head of Product' WHEN 3 THEN 'Owner' ELSE 'Technical Decision Maker' END AS title, "
    "CASE c_custkey % 5 WHEN 0 THEN 'technical_executive' WHEN 1 THEN 'founder' WHEN 2 THEN 'product_lead' WHEN 3 THEN 'general' ELSE 'technical_executive' END AS role_category, CASE WHEN c_custkey % 4 <> 0 THEN 'a' || CAST(c_custkey AS VARCHAR) || '@b.com' END AS email, CAST(85 AS DOUBLE) AS email_score FROM customer UNION ALL "
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ann' ELSE 'a' || CAST(c_custkey AS VARCHAR) END, CASE c_custkey % 5 WHEN 0 THEN 'Software Architect' WHEN 1 THEN 'Owner' WHEN 2 THEN 'Design' ELSE 'Unknown' END, "
    "CASE c_custkey % 5 WHEN 0 THEN 'technical_executive' WHEN 1 THEN 'founder' WHEN 2 THEN 'product_lead' ELSE 'general' END, 'a' || CAST(c_custkey AS VARCHAR) || '@b.com', CASE WHEN c_custkey % 2 = 0 THEN 80 ELSE c_custkey % 100 END FROM customer WHERE c_custkey % 4 <> 0",
)(lambda spark, d: tables.flatten_people(V.frame(spark, d, SEARCHED), "people_search").unionByName(tables.flatten_people(V.frame(spark, d, LISTED), "domain_search")).select("company_id", "full_name", "title", "role_category", "email", "email_score"))
SPEEDS = (
    "SELECT url, page_id AS id, '{{\"categories\":{{\"performance\":{{\"score\":0.' || lpad(CAST(page_id % 100 AS STRING), 2, '0') || '}},\"seo\":{{' || CASE WHEN page_id % 3 = 0 THEN '\"score\":1' ELSE '\"id\":\"seo\"' END || '}}}},\"audits\":{{\"largest-contentful-paint\":{{\"numericValue\":' || CAST(page_id % 5000 AS STRING) || '.7}},"
    "\"cumulative-layout-shift\":{{\"numericValue\":0.25}}' || CASE WHEN page_id % 2 = 0 THEN ',\"server-response-time\":{{\"numericValue\":' || CAST(page_id % 900 AS STRING) || '}}' ELSE '' END || '}}}}' AS payload FROM {pages}"
)
query(
    "flatten_lighthouse",
    "SELECT url, CAST(floor(CAST('0.' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 100) AS INT) AS performance_score, CAST(NULL AS INT) AS accessibility_score, CASE WHEN page_id % 3 = 0 THEN 100 ELSE 0 END AS seo_score, CAST(page_id % 5000 AS INT) AS lcp_ms, CAST(NULL AS INT) AS fcp_ms, CAST(0.25 AS DOUBLE) AS cls, "
    "CAST(NULL AS INT) AS inp_ms, CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 900 AS INT) END AS ttfb_ms FROM pages",
)(lambda spark, d: tables.flatten_lighthouse(V.frame(spark, d, SPEEDS)))
ROLE = lambda column, classes: "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({column}, '')), '{words}') THEN '{name}'" for name, words in classes) + " ELSE 'general' END"
projection(
    "role_class", TITLES, lambda: {"id": F.col("id"), **{o: leads.role_class(F.col("title"), o) for o in leads.ROLE_WORDS}},
    "id, " + ROLE("title", [("technical_executive", "cto|engineering|technical|developer"), ("founder", "founder|ceo|president"), ("product_lead", "product|design")]) + " AS people_search, "
    + ROLE("title", [("technical_executive", "cto|technology|engineering|technical|developer|architect|software"), ("founder", "founder|ceo|president|owner"), ("product_lead", "product|design")]) + " AS domain_search, "
    + ROLE("title", [("founder", "founder|ceo|director|partner"), ("technical_executive", "tech|dev|engineering|cto")]) + " AS page",
)
STACKS = "SELECT event_id AS id, user_id AS company_id, CASE event_id % 3 WHEN 0 THEN 'WordPress' WHEN 1 THEN '' END AS cms, CASE WHEN event_id % 2 = 0 THEN '[\"jQuery\"]' END AS frontend_stack, CAST(NULL AS STRING) AS backend_stack, event_id % 2 = 0 AS https, CASE WHEN event_id % 4 = 0 THEN true END AS hsts, event_id % 5 AS ttfb_ms FROM {events}"
RATED = "SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderkey % 101 AS DOUBLE) AS opportunity_score, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'low' ELSE 'high' END AS priority_tier, CAST(o_orderkey % 90 AS DOUBLE) AS company_fit, CAST(o_orderkey % 7 AS DOUBLE) AS technology_gap, CASE WHEN o_orderkey % 2 = 0 THEN 12.5 END AS pain_signal, CAST(20 AS DOUBLE) AS buying_signal FROM {orders}"
REACHED = "SELECT s_suppkey AS id, s_suppkey % 40 AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Jo Day' END AS full_name, '' AS title, 'jo' || CAST(s_suppkey AS STRING) || '@biz.com' AS email, CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'bounced' WHEN 2 THEN 'unverified' ELSE 'catch_all' END AS email_status FROM {supplier}"
FOUND = V.COMPANIES.replace("AS balance", "AS balance, '2026-01-' || CAST(10 + c_custkey % 20 AS STRING) AS created_at")
LAST = lambda view, order, cond="true": f"(SELECT * FROM {V.sql(view)} v WHERE {cond} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id {order}) = 1)"
TENTHS = lambda c: f"coalesce(printf('%.1f', CAST({c} AS DOUBLE)), 'N/A')"
query(
    "export_leads",
    f"SELECT c.id AS \"Company ID\", c.domain AS \"Domain\", c.name AS \"Name\", upper(coalesce(s.priority_tier, 'Unscored')) AS \"Priority Tier\", {TENTHS('s.opportunity_score')} AS \"Opportunity Score\", coalesce(k.full_name, '') AS \"Decision Maker Name\", '' AS \"Decision Maker Title\", coalesce(k.email, '') AS \"Verified Email\", "
    f"upper(coalesce(k.email_status, '')) AS \"Email Status\", {TENTHS('s.company_fit')} AS \"Company Fit\", {TENTHS('s.technology_gap')} AS \"Tech Gap\", {TENTHS('s.pain_signal')} AS \"Pain Signal\", {TENTHS('s.buying_signal')} AS \"Buying Signal\", c.source AS \"Source\", coalesce(c.industry, '') AS \"Industry\", coalesce(c.employees, '') AS \"Employees\", "
    "coalesce(t.cms, '') AS \"CMS\", coalesce(t.frontend_stack, '[]') AS \"Frontend Stack\", '[]' AS \"Backend Stack\", CASE WHEN t.https THEN 'Yes' ELSE 'No' END AS \"HTTPS\", CASE WHEN t.hsts THEN 'Yes' ELSE 'No' END AS \"HSTS\", CASE WHEN t.ttfb_ms > 0 THEN CAST(t.ttfb_ms AS VARCHAR) ELSE '' END AS \"TTFB (ms)\", c.created_at AS \"Discovered At\" "
    f"FROM {V.sql(FOUND)} c LEFT JOIN {LAST(STACKS, 'DESC')} t ON t.company_id = c.id LEFT JOIN {LAST(RATED, 'DESC')} s ON s.company_id = c.id LEFT JOIN {LAST(REACHED, 'ASC', 'email_status <> ' + chr(39) + 'bounced' + chr(39))} k ON k.company_id = c.id WHERE coalesce(s.opportunity_score, 0) >= 0",
)(lambda spark, d: tables.lead_report(*(V.frame(spark, d, v) for v in (FOUND, STACKS, RATED, REACHED))))
