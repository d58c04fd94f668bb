"""Remaining queries of section 2; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.functions import text as T
from prospectra.operators import feeds, leads, pages, relational, scoring, worklists
from prospectra.plans import catalog as C
from prospectra.plans import views as V
from prospectra.plans.catalog import projection, query, sql_contains

SEEN = "(SELECT user_id FROM events WHERE event_id % 5 = 0)"
query("data_completeness", f"SELECT company_id, CAST(round(0.35 + CASE WHEN library IS NOT NULL THEN 0.15 ELSE 0.0 END + CASE WHEN ttfb_ms > 0 THEN 0.35 ELSE 0.0 END + CASE WHEN company_id % 4 = 0 THEN 0.15 ELSE 0.0 END, 2) AS DOUBLE) AS completeness FROM {V.sql(C.WITH_STACK)} v")(
    lambda spark, d: V.frame(spark, d, C.WITH_STACK).select("company_id", scoring.data_completeness(F.lit(True), F.col("library").isNotNull(), F.col("ttfb_ms") > 0, F.col("company_id") % 4 == 0).alias("completeness"))
)
query("deal_range", f"SELECT c.id AS company_id, CAST(CASE WHEN website_url IS NULL AND o.estimated_value_high IS NULL THEN 2500 ELSE coalesce(o.estimated_value_low, 0) END AS BIGINT) AS low, CAST(CASE WHEN website_url IS NULL AND o.estimated_value_high IS NULL THEN 5000 ELSE coalesce(o.estimated_value_high, 0) END AS BIGINT) AS high FROM {V.sql(V.COMPANIES)} c LEFT JOIN ({C.OPPS}) o ON o.company_id = c.id")(
    lambda spark, d: worklists.deal_range(V.frame(spark, d, V.COMPANIES), scoring.detect_opportunities(C.pains(spark, d)))
)
query("one_message_per_company", f"SELECT company_id, id FROM {V.sql(V.CONTACTS)} c QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id) = 1")(
    lambda spark, d: relational.keep_first(V.frame(spark, d, V.CONTACTS), [F.col("company_id")], "id").select("company_id", "id")
)
query("outreach_ready_count", f"SELECT count(DISTINCT company_id) AS ready, count(*) AS contacts FROM {V.sql(V.CONTACTS)} c WHERE {C.USABLE} AND company_id NOT IN {SEEN}")(
    lambda spark, d: worklists.outreach_ready_count(V.frame(spark, d, V.CONTACTS).where(C.USABLE), spark.read.parquet(f"{d}/events.parquet").where("event_id % 5 = 0").select(F.col("user_id").alias("company_id")))
)
query("ingest_job_postings", f"SELECT id, 'active_hiring_intent' AS type FROM {V.sql(V.COMPANIES)} c WHERE domain IN (SELECT 'biz' || CAST(p_partkey AS STRING) || '.com' FROM part) AND NOT {sql_contains(C.ALL_TEXT, D.AGENCY_WORDS)}")(
    lambda spark, d: worklists.ingest_job_postings(V.frame(spark, d, V.COMPANIES), spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("biz"), F.col("p_partkey").cast("string"), F.lit(".com")).alias("domain")))
)
#: Local businesses with stand-in domains; some stems begin with others'.
PLACED = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Harbor Cafe ' WHEN 1 THEN 'Lake & Sons ' ELSE 'Plain Works ' END || CAST(c_custkey % 60 AS STRING) AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'harbor-cafe-' WHEN 1 THEN 'lake-sons-' ELSE 'Plain-Works-' END || CAST(c_custkey % 45 AS STRING) || CASE c_custkey % 4 WHEN 0 THEN '-miami' WHEN 1 THEN '-san-jose' WHEN 2 THEN '-san-jose-west' ELSE '' END || '.local' AS domain
FROM {customer}
"""
WANTED = """
SELECT s_suppkey AS wanted_id, CASE s_suppkey % 5 WHEN 0 THEN ' harbor cafe ' || CAST(s_suppkey % 70 AS STRING) WHEN 1 THEN 'LAKE -- SONS ' || CAST(s_suppkey % 50 AS STRING) WHEN 2 THEN 'plain   works ' || CAST(s_suppkey % 90 AS STRING) WHEN 3 THEN '' ELSE 'nobody' END AS wanted,
  CASE s_suppkey % 4 WHEN 0 THEN 'Miami' WHEN 1 THEN 'San Jose' WHEN 2 THEN 'San' ELSE NULL END AS city
FROM {supplier}
"""
SLUG = "trim(regexp_replace(lower(trim(coalesce({}, ''))), '[^a-z0-9]+', '-', 'g'), '-')"
query(
    "find_company_by_name",
    f"SELECT wanted_id, coalesce(same.id, begun.id) AS id FROM (SELECT *, {SLUG.format('wanted')} || '-' || {SLUG.format('city')} AS key FROM {V.sql(WANTED)} v) w LEFT JOIN (SELECT lower(trim(name)) AS name, min(id) AS id FROM {V.sql(PLACED)} c GROUP BY 1) same ON same.name = lower(trim(wanted)) AND wanted <> '' "
    f"LEFT JOIN (SELECT key, min(c.id) AS id FROM (SELECT DISTINCT {SLUG.format('wanted')} || '-' || {SLUG.format('city')} AS key FROM {V.sql(WANTED)} v WHERE {SLUG.format('wanted')} <> '' AND {SLUG.format('city')} <> '') k JOIN {V.sql(PLACED)} c ON lower(c.domain) LIKE k.key || '%' GROUP BY key) begun ON begun.key = w.key",
)(lambda spark, d: worklists.find_company_by_name(V.frame(spark, d, PLACED), V.frame(spark, d, WANTED)))
REDIRECT = "SELECT 'biz' || CAST(s_suppkey AS STRING) || '.com' AS domain, 'new' || CAST(s_suppkey % 9 AS STRING) || '.com' AS target FROM {supplier}"
query("canonical_domain", f"SELECT c.id, coalesce(r.target, c.domain) AS domain FROM {V.sql(V.COMPANIES)} c LEFT JOIN {V.sql(REDIRECT)} r ON r.domain = c.domain")(
    lambda spark, d: worklists.canonical_domain(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, REDIRECT)).select("id", "domain")
)
SENT = "SELECT event_id AS id, user_id % 120 AS contact_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'e' || CAST(event_id AS STRING) || '@x.com' END AS email FROM {events}"
query("validate_or_drop_messages", f"SELECT m.id, c.id AS contact_id, coalesce(m.email, c.email) AS email FROM {V.sql(SENT)} m LEFT JOIN {V.sql(V.CONTACTS)} c ON c.id = m.contact_id")(
    lambda spark, d: worklists.validate_messages(V.frame(spark, d, SENT), V.frame(spark, d, V.CONTACTS)).select("id", "contact_id", "email")
)
query("stage_baseline", f"SELECT id, baseline, avg_duration, n_before FROM ({C.ANOMALY}) a")(lambda spark, d: feeds.stage_baseline(V.frame(spark, d, V.RUNS)).select("id", "baseline", "avg_duration", "n_before"))
CERTS = "SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN '2026-02-' ELSE '2026-03-' END || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS expires FROM {customer}"
query("certificate_metrics", f"SELECT id, date_diff('day', CAST({C.AS_OF} AS DATE), CAST(expires AS DATE)) AS days, date_diff('day', CAST({C.AS_OF} AS DATE), CAST(expires AS DATE)) < 30 AS expiring FROM {V.sql(CERTS)} v")(
    lambda spark, d: worklists.certificate_metrics(V.frame(spark, d, CERTS), C.as_of()).select("id", "days", "expiring")
)
FAST = "(lighthouse_score >= 75 OR (homepage_ms < 2200 AND NOT speed_discrepancy))"
query(
    "pillar_summary",
    f"SELECT company_id, CASE WHEN {FAST} THEN 0 ELSE 1 END AS speed, CAST(missing_tel_link AS INT) + CAST(max_form_inputs >= 7 AS INT) + CAST(NOT sticky_cta AS INT) AS conversion, CAST(NOT has_schema AS INT) + CAST(broken_social AS INT) + CAST(deliverability_risk AS INT) AS search, "
    f"CAST(NOT https AS INT) + CAST(coalesce(cert_days < 30, false) AS INT) + CAST(exposed_users AS INT) AS security FROM {V.sql(V.TECH)} v",
)(lambda spark, d: pages.pillar_summary(V.frame(spark, d, V.TECH)))
projection("fingerprint_transport", "SELECT page_id, url FROM {pages}", lambda: {"page_id": F.col("page_id"), "https": F.col("url").startswith("https://")}, "page_id, starts_with(url, 'https://') AS https")
query("catchall_ttl", "SELECT user_id, arg_max(event_type, ts) AS verdict FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00'")(
    lambda spark, d: worklists.catchall_ttl(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_type").alias("verdict"), "ts"), F.lit("2024-01-31").cast("timestamp")).select(F.col("key").alias("user_id"), "verdict")
)
query("query_matrix", "SELECT category, city FROM (SELECT category, city, row_number() OVER (ORDER BY category, city) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT p_type AS category FROM part), (SELECT n_name AS city FROM nation)) x WHERE ((n - 17) % total + total) % total < 40")(
    lambda spark, d: leads.query_matrix(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("category")).distinct(), spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("city")), 17, 40).select("category", "city")
)
GENERATED = "SELECT conv_id * 100 + turn AS id, '<think>' || role || '</think>**Subject: Hello ' || CAST(conv_id AS STRING) || '**' || chr(10) || 'Body ' || CAST(turn AS STRING) AS raw FROM {conversations}"
projection("clean_generated_text", GENERATED, lambda: {"id": F.col("id"), "subject": T.clean_generated_text(F.col("raw"))["subject"], "body": T.clean_generated_text(F.col("raw"))["body"]}, "id, 'Hello ' || CAST(id // 100 AS STRING) AS subject, 'Body ' || CAST(id % 100 AS STRING) AS body")
query("page_contacts", r"SELECT doc_id, email FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})', 1))) AS email FROM documents) x")(
    lambda spark, d: leads.page_contacts(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text"), F.lit("example.com"), T.extract_emails(F.col("text")), None).select(F.col("page_id").alias("doc_id"), "email")
)
