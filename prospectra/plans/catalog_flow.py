"""Queries of intake and messages; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.operators import intake, messages
from prospectra.plans import catalog as C
from prospectra.plans import views as V
from prospectra.plans.catalog import projection, query

ENTRIES = """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN 'plain' || CAST(c_custkey AS STRING) || '.com' ELSE '' END AS domain,
  CASE c_custkey % 3 WHEN 0 THEN 'https://www.Site' || CAST(c_custkey AS STRING) || '.com/a' WHEN 1 THEN '' END AS website_url, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS industry, '10-49' AS employees
FROM {customer}
"""
ENTRY_URL = "CASE WHEN id % 3 = 0 THEN website_url WHEN id % 5 = 0 THEN domain ELSE '' END"
ENTRY_DOMAIN = "CASE WHEN id % 3 = 0 THEN 'site' || CAST(id AS STRING) || '.com' WHEN id % 5 = 0 THEN domain ELSE '' END"
query(
    "normalize_directory_entries",
    " UNION ALL ".join(
        f"SELECT id, CASE WHEN id % 4 IN (2, 3) THEN name ELSE {ENTRY_DOMAIN} END AS name, {ENTRY_DOMAIN} AS domain, {ENTRY_URL} AS website_url, '{s}' AS source, coalesce(industry, '{i}') AS industry FROM {V.sql(ENTRIES)} v"
        for s, i in (("clutch", "Software & Web Development"), ("goodfirms", "Software & Web Development"), ("yelp", "Commercial Business & Services"))
    ),
)(lambda spark, d: directories(spark, d))


def directories(spark, d):
    found = [intake.normalize_directory_entries(V.frame(spark, d, ENTRIES), s) for s in ("clutch", "goodfirms", "yelp")]
    return found[0].unionByName(found[1]).unionByName(found[2]).drop("employees")


LISTINGS = """
SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Bay Dental & Spa' ELSE 'Shop No ' || CAST(s_suppkey % 300 AS STRING) END AS name, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Miami ' ELSE 'New York' END AS city,
  CASE s_suppkey % 4 WHEN 0 THEN 'https://www.Place' || CAST(s_suppkey % 200 AS STRING) || '.com/x' WHEN 1 THEN 'place' || CAST(s_suppkey AS STRING) || '.net' WHEN 2 THEN 'None' END AS website_url,
  CASE s_suppkey % 3 WHEN 0 THEN 'hair_care' WHEN 1 THEN 'dentist' END AS category, CAST(s_suppkey AS STRING) AS phone, s_suppkey % 50 AS rating, s_suppkey % 90 AS review_count
FROM {supplier}
"""
listed = lambda spark, d: intake.normalize_local_listings(V.frame(spark, d, LISTINGS).withColumn("categories", F.array_compact(F.array("category"))))
L_NAME = "CASE id % 6 WHEN 0 THEN 'business' WHEN 1 THEN 'bay-dental-spa' ELSE 'shop-no-' || CAST(id % 300 AS STRING) END"
L_CITY = "CASE id % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'miami' ELSE 'new-york' END"
L_DOMAIN = f"CASE id % 4 WHEN 0 THEN 'place' || CAST(id % 200 AS STRING) || '.com' WHEN 1 THEN website_url ELSE {L_NAME} || '-' || {L_CITY} || '.local' END"
query(
    "normalize_local_listings",
    f"SELECT id, CASE WHEN id % 6 = 0 THEN {L_DOMAIN} ELSE name END AS name, {L_DOMAIN} AS domain, CASE id % 4 WHEN 0 THEN website_url WHEN 1 THEN 'https://' || website_url END AS website_url, id % 4 IN (0, 1) AS has_website, "
    f"CASE id % 3 WHEN 0 THEN 'Hair Care' WHEN 1 THEN 'Dentist' ELSE 'Local Business & Services' END AS industry, trim(city) AS city FROM {V.sql(LISTINGS)} v",
)(lambda spark, d: listed(spark, d).select("id", "name", "domain", "website_url", "has_website", "industry", "city"))
REGISTRY = """
SELECT 'dom' || CAST(c_custkey AS STRING) || '.com' AS domain, c_custkey AS id, '{{"entities":[{{"roles":["technical","abuse"],"vcardArray":["vcard",[["version",{{}},"text","4.0"],["fn",{{}},"text","' || CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Privacy Service' ELSE '' END
  || '"],["email",{{}},"text","' || CASE c_custkey % 4 WHEN 0 THEN 'Who@Domainsbyproxy.com' WHEN 1 THEN '' ELSE ' Ann' || CAST(c_custkey AS STRING) || '@Dom.com' END || '"]]]}},{{"roles":[],"vcardArray":["vcard",[["email",{{}},"text","x@y.org"]]]}}]}}' AS payload
FROM {customer}
"""
query(
    "flatten_registry_contacts",
    f"SELECT domain, 'x@y.org' AS email, 'Dom' || CAST(id AS STRING) || ' Admin' AS full_name, 'Domain Administrator' AS title FROM {V.sql(REGISTRY)} v UNION ALL "
    f"SELECT domain, 'ann' || CAST(id AS STRING) || '@dom.com', CASE WHEN id % 3 = 0 THEN 'Ann Lee' ELSE 'Dom' || CAST(id AS STRING) || ' Admin' END, 'Technical / Abuse' FROM {V.sql(REGISTRY)} v WHERE id % 4 IN (2, 3)",
)(lambda spark, d: intake.flatten_registry_contacts(V.frame(spark, d, REGISTRY)).select("domain", "email", "full_name", "title"))
NEW = """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Acme Web Agency' WHEN 1 THEN '' ELSE 'Firm ' || CAST(p_partkey % 400 AS STRING) || ' LLC' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'nodot' WHEN 2 THEN 'biz' || CAST(p_partkey % 50 AS STRING) || '.com' ELSE 'http://www.firm' || CAST(p_partkey AS STRING) || '.com/' END AS domain,
  CASE WHEN p_partkey % 14 = 0 THEN 'https://own' || CAST(p_partkey AS STRING) || '.com' END AS website_url, CASE p_partkey % 4 WHEN 0 THEN 'dental' WHEN 1 THEN 'Freight' WHEN 2 THEN 'Masonry' ELSE '' END AS industry,
  CASE p_partkey % 3 WHEN 0 THEN 'clutch_client_review' ELSE 'discovery' END AS source, CASE WHEN p_partkey % 9 = 0 THEN 'did work' END AS summary
FROM {part}
"""


def sql_greedy(rows: str) -> str:
    """Rows (``id``, ``domain``, ``slug``) that are accepted in order of id where neither key is taken, one a step."""
    free = "NOT (list_contains(s.domains, c.domain) OR list_contains(s.slugs, c.slug))"
    grow = lambda held, key: f"CASE WHEN {free} THEN list_append(s.{held}, c.{key}) ELSE s.{held} END"
    return (
        f"WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS n FROM {rows} r), s AS (SELECT CAST(0 AS BIGINT) AS n, false AS accepted, CAST([] AS VARCHAR[]) AS domains, CAST([] AS VARCHAR[]) AS slugs UNION ALL "
        f"SELECT c.n, {free}, {grow('domains', 'domain')}, {grow('slugs', 'slug')} FROM s JOIN c ON c.n = s.n + 1) SELECT c.* FROM c JOIN s ON s.n = c.n WHERE s.accepted"
    )


PROPOSED = f"(SELECT id, name, industry, source, summary, {C.HOST.format("coalesce(nullif(domain, ''), website_url)")} AS domain, coalesce(nullif({C.NAME}, ''), 'id:' || CAST(id AS VARCHAR)) AS slug FROM {V.sql(NEW)} v)"
FRESH = (
    f"(SELECT * FROM {PROPOSED} p WHERE contains(domain, '.') AND NOT {C.sql_contains(C.ALL_TEXT, D.AGENCY_WORDS)} AND domain NOT IN (SELECT {C.HOST.format('domain')} FROM {V.sql(V.COMPANIES)} k) AND slug NOT IN (SELECT {C.NAME} FROM {V.sql(V.COMPANIES)} k))"
)
KIND = C.sql_case([(C.sql_contains("lower(name || ' ' || coalesce(industry, '') || ' ' || coalesce(summary, ''))", words), f"'{label}'") for label, words in D.INDUSTRIES.items()], "NULL")
query(
    "ingest_candidates",
    f"SELECT id, domain, coalesce({KIND}, nullif(industry, ''), 'Commercial Business & Services') AS industry, CASE WHEN contains(source, 'client') OR contains(source, 'review') THEN 'directory_client_review' END AS signal FROM ({sql_greedy(FRESH)}) g",
)(lambda spark, d: taken(spark, d))


def taken(spark, d):
    rows, signals = intake.ingest_candidates(V.frame(spark, d, NEW), V.frame(spark, d, V.COMPANIES))
    return rows.join(signals.select("domain", F.col("type").alias("signal")), "domain", "left").select("id", "domain", "industry", "signal")


SLUGGED = f"{C.NAME} || ':' || {C.CITY}"
SHOWN = f"(SELECT *, {SLUGGED} AS slug FROM (SELECT id, CASE WHEN id % 6 = 0 THEN {L_DOMAIN} ELSE name END AS name, {L_DOMAIN} AS domain, city, id % 4 IN (0, 1) AS has_website FROM {V.sql(LISTINGS)} v) n)"
UNSEEN = f"(SELECT * FROM {SHOWN} p WHERE domain NOT IN (SELECT {C.HOST.format('domain')} FROM {V.sql(V.COMPANIES)} k) AND slug NOT IN (SELECT {SLUGGED} FROM {V.sql(V.COMPANIES)} k))"
query(
    "ingest_listings",
    "SELECT id, domain, CAST(CASE WHEN has_website THEN 0 ELSE 100 END AS DOUBLE) AS opportunity_score, CASE WHEN has_website THEN 'pending_audit' ELSE 'immediate' END AS priority_tier, CASE WHEN NOT has_website THEN 'new_website_creation' END AS offer, "
    f"CASE WHEN NOT has_website THEN 'missing_website' END AS signal FROM ({sql_greedy(UNSEEN)}) g",
)(lambda spark, d: places(spark, d))


def places(spark, d):
    out = intake.ingest_listings(listed(spark, d), V.frame(spark, d, V.COMPANIES))
    rows = out["companies"].select("id", "domain").join(out["scores"], "domain")
    return rows.join(out["opportunities"].select("domain", F.col("type").alias("offer")), "domain", "left").join(out["signals"].select("domain", F.col("type").alias("signal")), "domain", "left")


from prospectra.plans.catalog_site import EMPLOYER, POSTS  # noqa: E402

BUDGET = r"coalesce(nullif(regexp_extract(coalesce(description, ''), '(\$[0-9][0-9,]*(?:\.[0-9]+)?[kK]?)', 1), ''), 'Not specified')"
query(
    "ingest_freelance_posts",
    f"SELECT domain, arg_max(company, id) AS name, 'https://' || domain AS website_url, 'Upwork Job: ' || arg_max(title, id) || ' (' || arg_max(budget, id) || ')' AS project_summary, count(*) AS n_signals "
    f"FROM (SELECT id, company, title, {EMPLOYER} AS domain, {BUDGET} AS budget FROM {V.sql(POSTS)} v) x WHERE domain IS NOT NULL GROUP BY domain",
)(lambda spark, d: posts(spark, d))


def posts(spark, d):
    rows, signals = intake.ingest_freelance_posts(V.frame(spark, d, POSTS))
    return rows.join(signals.groupBy("domain").agg(F.count("*").alias("n_signals")), "domain").select("domain", "name", "website_url", "project_summary", "n_signals")


OLD = f"(SELECT domain, name, industry, employees FROM {V.sql(V.COMPANIES)} a WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id) = 1)"
LATE = f"(SELECT domain, name, industry, employees FROM {V.sql(V.COMPANIES)} a WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id DESC) = 1)"
query(
    "upsert_companies",
    f"SELECT coalesce(o.domain, n.domain) AS domain, coalesce(nullif(o.name, ''), n.name) AS name, coalesce(n.industry, o.industry) AS industry, coalesce(n.employees, o.employees) AS employees FROM {OLD} o FULL JOIN {LATE} n ON o.domain = n.domain",
)(lambda spark, d: intake.upsert_companies(V.frame(spark, d, V.COMPANIES).where("id % 3 = 0"), V.frame(spark, d, V.COMPANIES).where("id % 3 <> 0")))
DEALS = """
SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderkey % 3 WHEN 0 THEN 'a' ELSE 'b' END AS type, o_orderkey % 900 AS estimated_value_low, o_orderkey % 900 + 100 AS estimated_value_high, CAST(o_orderkey % 10 AS DOUBLE) AS confidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'converted' ELSE 'in_discussion' END AS status FROM {orders}
"""
DEAL = lambda cond, order: f"(SELECT * FROM {V.sql(DEALS)} v WHERE {cond} QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY id {order}) = 1)"
query(
    "upsert_opportunities",
    "SELECT coalesce(o.company_id, n.company_id) AS company_id, coalesce(o.type, n.type) AS type, coalesce(n.estimated_value_low, o.estimated_value_low) AS estimated_value_low, coalesce(n.estimated_value_high, o.estimated_value_high) AS estimated_value_high, "
    f"coalesce(n.confidence, o.confidence) AS confidence, coalesce(o.status, n.status) AS status FROM {DEAL('id % 2 = 0', 'ASC')} o FULL JOIN {DEAL('id % 2 = 1', 'DESC')} n ON o.company_id = n.company_id AND o.type = n.type",
)(lambda spark, d: intake.upsert_opportunities(V.frame(spark, d, DEALS).where("id % 2 = 0"), V.frame(spark, d, DEALS).where("id % 2 = 1")))
query(
    "append_history",
    f"SELECT c.id, greatest(c.last_crawled_at, e.seen) AS last_crawled_at, coalesce(n_rows, 0) AS n_rows, confidence FROM {V.sql(V.COMPANIES)} c LEFT JOIN (SELECT company_id, max(CASE WHEN id % 2 = 1 THEN ts END) AS seen, count(*) AS n_rows, sum(confidence) AS confidence FROM {V.sql(V.SIGNALS)} s GROUP BY company_id) e ON e.company_id = c.id",
)(lambda spark, d: appended(spark, d))


def appended(spark, d):
    """Both results: the longer history, counted by company, beside the companies' times."""
    signals = V.frame(spark, d, V.SIGNALS)
    history, touched = intake.append_history(signals.where("id % 2 = 0"), signals.where("id % 2 = 1"), V.frame(spark, d, V.COMPANIES), "ts")
    rows = history.groupBy("company_id").agg(F.count("*").alias("n_rows"), F.sum("confidence").alias("confidence"))
    return touched.join(rows, F.col("id") == F.col("company_id"), "left").select("id", "last_crawled_at", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "confidence")


BARE = "(website_url IS NULL OR ends_with(domain, '.local'))"
query(
    "upgrade_no_website",
    f"SELECT id AS company_id, 'opportunity' AS kind, 'discovered' AS value FROM {V.sql(V.COMPANIES)} c WHERE {BARE} AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL "
    f"SELECT id, 'score', 'immediate' FROM {V.sql(V.COMPANIES)} c WHERE {BARE} AND id NOT IN (SELECT company_id FROM {V.sql(V.SCORES)} s WHERE opportunity_score = 100 AND priority_tier = 'immediate') UNION ALL "
    f"SELECT id, 'contact', CASE WHEN company_id IN (SELECT id FROM {V.sql(V.COMPANIES)} c WHERE {BARE}) AND NOT ends_with(email, '.local') THEN 'valid' ELSE email_status END FROM {V.sql(V.CONTACTS)} k",
)(lambda spark, d: upgraded(spark, d))


def upgraded(spark, d):
    companies = V.frame(spark, d, V.COMPANIES)
    offers = companies.where("id % 2 = 0").select(F.col("id").alias("company_id"), F.lit("new_website_creation").alias("type"))
    out = intake.upgrade_no_website(companies, offers, V.frame(spark, d, V.SCORES), V.frame(spark, d, V.CONTACTS), C.as_of())
    long = lambda t, key, kind, value: out[t].select(F.col(key).alias("company_id"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
    return long("opportunities", "company_id", "opportunity", "status").unionByName(long("scores", "company_id", "score", "priority_tier")).unionByName(long("contacts", "id", "contact", "email_status"))


INDEX = "SELECT s_suppkey AS position, CASE s_suppkey % 4 WHEN 0 THEN 'works ' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'The Bright Dental, LLC ' || CAST(s_suppkey AS STRING) || ' of Town' WHEN 2 THEN 'no' ELSE 'Lake Realty' END AS name FROM {supplier}"
query(
    "firmographic_match",
    f"SELECT c.id, arg_min(lower(trim(i.name)), i.position) AS entry FROM {V.sql(V.COMPANIES)} c JOIN {V.sql(INDEX)} i ON contains(lower(trim(c.name)), lower(trim(i.name))) OR contains(lower(trim(i.name)), lower(trim(c.name))) GROUP BY c.id",
)(lambda spark, d: intake.firmographic_match(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, INDEX)))
CANDIDATES = "SELECT l_orderkey AS company_id, l_linenumber % 2 AS person, l_partkey % 5 AS position, 'u' || CAST(l_suppkey AS STRING) || '@m.com' AS email FROM {lineitem}"
ACCEPTED = "SELECT 'u' || CAST(s_suppkey AS STRING) || '@m.com' AS email, s_suppkey % 3 <> 0 AS accepted, s_suppkey % 4 = 1 AS catch_all FROM {supplier}"
query(
    "verified_candidates",
    f"SELECT company_id, person, arg_min(email, lpad(CAST(position AS STRING), 3, '0') || email) AS email FROM {V.sql(CANDIDATES)} c WHERE email IN (SELECT email FROM {V.sql(ACCEPTED)} p WHERE accepted AND NOT catch_all) GROUP BY company_id, person",
)(lambda spark, d: intake.verified_candidates(V.frame(spark, d, CANDIDATES), V.frame(spark, d, ACCEPTED)))
FOUND = """
SELECT l_orderkey AS company_id, l_linenumber AS source_rank, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://s' || CAST(l_partkey % 40 AS STRING) || '.com' END AS website_url,
  CASE WHEN l_partkey % 2 = 0 THEN '555' || CAST(l_partkey AS STRING) END AS phone, CASE l_suppkey % 4 WHEN 0 THEN 'A' || CAST(l_suppkey % 9 AS STRING) || '@b.com' WHEN 1 THEN 'noreply@b.com' WHEN 2 THEN 'a@b.gov' END AS email FROM {lineitem}
"""
FIRST = lambda c: f"(SELECT company_id, arg_min({c}, lpad(CAST(source_rank AS STRING), 3, '0') || {c}) AS v FROM {V.sql(FOUND)} v WHERE coalesce({c}, '') <> '' GROUP BY company_id)"
query(
    "merge_lookup_sources",
    f"SELECT f.company_id, w.v AS website_url, p.v AS phone, coalesce(e.v, '') AS emails FROM (SELECT DISTINCT company_id FROM {V.sql(FOUND)} v) f LEFT JOIN {FIRST('website_url')} w ON w.company_id = f.company_id LEFT JOIN {FIRST('phone')} p ON p.company_id = f.company_id "
    f"LEFT JOIN (SELECT company_id, string_agg(email, ',' ORDER BY rank, email) AS v FROM (SELECT company_id, lower(email) AS email, min(source_rank) AS rank FROM {V.sql(FOUND)} v WHERE email LIKE 'A%' GROUP BY company_id, lower(email)) g GROUP BY company_id) e ON e.company_id = f.company_id",
)(lambda spark, d: intake.merge_lookup_sources(V.frame(spark, d, FOUND), F.col("email").isNotNull() & F.lower("email").endswith("@b.com") & ~F.lower("email").startswith("noreply")).withColumn("emails", F.array_join("emails", ",")))
SKILLS = "SELECT event_id, user_id AS company_id, CASE WHEN event_id % 3 = 0 THEN 'hiring_skill_match' ELSE 'other' END AS type, CASE event_id % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'laravel' ELSE 'devops' END AS skill, CASE WHEN event_id % 6 = 0 THEN 'php' END AS more FROM {events}"
query(
    "skill_list",
    f"SELECT company_id, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills, count(*) AS n_matches FROM (SELECT company_id, skill FROM {V.sql(SKILLS)} v WHERE type = 'hiring_skill_match' UNION ALL SELECT company_id, more FROM {V.sql(SKILLS)} v WHERE type = 'hiring_skill_match' AND more IS NOT NULL) x GROUP BY company_id",
)(lambda spark, d: intake.skill_list(V.frame(spark, d, SKILLS).withColumn("skills", F.array_compact(F.array("skill", "more")))).withColumn("skills", F.array_join("skills", ",")))
PEOPLE = "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 400 AS company_id, l_partkey % 4 AS tier, l_suppkey % 7 AS position, CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' Jo@X.com' ELSE 'ann' || CAST(l_suppkey % 6 AS STRING) || '@x.com' END AS email FROM {lineitem}"
query("dedupe_contacts", f"SELECT company_id, lower(trim(email)) AS email, id FROM {V.sql(PEOPLE)} v WHERE trim(email) <> '' QUALIFY row_number() OVER (PARTITION BY company_id, lower(trim(email)) ORDER BY tier, position, id) = 1")(
    lambda spark, d: intake.dedupe_contacts(V.frame(spark, d, PEOPLE))
)
DISPOSABLE = "SELECT DISTINCT 'mail' || CAST(user_id % 3 AS STRING) || '.com' AS domain FROM {events}"
query("is_disposable_email", f"SELECT id, regexp_extract(email, '@(.*)$', 1) IN (SELECT domain FROM {V.sql(DISPOSABLE)} t) AS disposable FROM {V.sql(V.BOUNCES)} b")(
    lambda spark, d: D.is_disposable_email(V.frame(spark, d, V.BOUNCES), V.frame(spark, d, DISPOSABLE)).select("id", "disposable")
)

# ---- messages
HEARD = """
SELECT c_custkey AS id, c_custkey AS company_id, 'p' || CAST(c_custkey AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '@x.gov' WHEN 1 THEN '@x.local' ELSE '@x.com' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'email_permutator' ELSE 'website' END AS source, CASE WHEN c_custkey % 2 = 0 THEN 'smtp_handshake' ELSE 'none' END AS verification_source, CASE c_custkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'bounced' ELSE 'catch_all' END AS email_status
FROM {customer}
"""
FACTS = "SELECT c_custkey AS id, c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'Drupal' END AS cms, c_custkey % 5000 AS lcp_ms, c_custkey % 17 = 0 AS crawl_failed FROM {customer}"
SENT = "SELECT o_orderkey AS id, o_orderkey % 1000 * 7 + 3 AS company_id, 'p' || CAST(o_orderkey % 400 * 3 AS STRING) || '@x.com' AS recipient FROM {orders}"
TOP = f"(SELECT company_id, arg_max(opportunity_score, id) AS score, arg_max(priority_tier, id) AS tier FROM {V.sql(V.SCORES)} s GROUP BY company_id)"
PROVEN = "coalesce(cms IS NOT NULL OR lcp_ms > 2500, false)"
query(
    "copy_candidates",
    f"SELECT c.id AS company_id, k.id AS contact_id, k.email, s.score AS opportunity_score, {BARE} AS no_website, {PROVEN} AS proven FROM {V.sql(V.COMPANIES)} c JOIN {TOP} s ON s.company_id = c.id JOIN {V.sql(HEARD)} k ON k.company_id = c.id LEFT JOIN {V.sql(FACTS)} f ON f.company_id = c.id "
    f"WHERE CASE WHEN k.source = 'email_permutator' THEN k.verification_source = 'smtp_handshake' AND k.email_status = 'valid' ELSE k.email_status IN ('valid', 'catch_all') END AND NOT ends_with(k.email, '.gov') AND NOT ends_with(k.email, '.local') "
    f"AND s.score >= 40 AND s.tier <> 'ignore' AND NOT coalesce(crawl_failed, false) AND ({BARE} OR (c.last_crawled_at IS NOT NULL AND {PROVEN})) AND c.id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 5 = 0) "
    f"AND c.id NOT IN (SELECT company_id FROM {V.sql(SENT)} m) AND k.email NOT IN (SELECT recipient FROM {V.sql(SENT)} m)",
)(lambda spark, d: writable(spark, d))


def writable(spark, d):
    failed = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup' and user_id % 5 = 0").select(F.col("user_id").alias("company_id"))
    return messages.copy_candidates(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, HEARD), V.frame(spark, d, V.SCORES), V.frame(spark, d, FACTS), failed, V.frame(spark, d, SENT), limit=None)


KNOWN = """
SELECT c_custkey AS contact_id, CASE c_custkey % 8 WHEN 0 THEN 'laravel_modernization' WHEN 1 THEN 'frontend_modernization' WHEN 2 THEN 'staff_augmentation' WHEN 3 THEN 'speed_optimization' WHEN 4 THEN 'turnkey_modernization_overhaul' WHEN 5 THEN 'new_website_creation' WHEN 6 THEN 'general_engineering' END AS segment,
  CASE WHEN c_custkey % 3 = 0 THEN 'Joomla' ELSE '' END AS cms, CASE WHEN c_custkey % 5 < 2 THEN 'jQuery 1.12.4' END AS library, CASE WHEN c_custkey % 7 < 3 THEN 'PHP developer' END AS role, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 60) * 100 END AS lcp_ms,
  CASE WHEN c_custkey % 3 = 1 THEN 2300 END AS homepage_ms, CASE WHEN c_custkey % 9 = 0 THEN 900 END AS ttfb_ms, CASE WHEN c_custkey % 4 = 1 THEN 61 END AS performance_score, c_custkey % 3 AS reviews_count, 1 + c_custkey % 2 AS step,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Ann' END AS first_name, c_name AS company_name, 'd' || CAST(c_custkey AS STRING) || '.com' AS domain, 'p' || CAST(c_custkey AS STRING) || '@x.com' AS email
FROM {customer}
"""
STACK_ = "CASE WHEN library IS NOT NULL THEN 'legacy frontend libraries (' || library || ')' END"
TENTH = lambda c: f"CAST(CAST(floor({c} / 1000) AS BIGINT) AS STRING) || '.' || CAST(CAST(floor({c} / 100) AS BIGINT) % 10 AS STRING)"
EVIDENCE = (
    f"CASE segment WHEN 'laravel_modernization' THEN CASE WHEN cms <> '' THEN cms || ' infrastructure' ELSE {STACK_} END WHEN 'frontend_modernization' THEN {STACK_} WHEN 'staff_augmentation' THEN 'roles like ' || role "
    f"WHEN 'speed_optimization' THEN CASE WHEN lcp_ms > 0 THEN 'Core Web Vitals Largest Contentful Paint of ' || {TENTH('lcp_ms')} || 's' WHEN homepage_ms > 0 THEN 'initial mobile load time of 2.3s' WHEN ttfb_ms > 0 THEN 'server response latency (TTFB) of 900ms' WHEN performance_score > 0 THEN 'Lighthouse mobile score of 61/100' END "
    "WHEN 'turnkey_modernization_overhaul' THEN CASE WHEN homepage_ms > 0 THEN '2.3s' WHEN performance_score > 0 THEN 'elevated load time' END WHEN 'new_website_creation' THEN CASE WHEN reviews_count > 0 THEN CAST(reviews_count AS STRING) || ' verified Google reviews' ELSE 'strong local customer reputation and rating' END END"
)
known = lambda spark, d: messages.evidence_gate(V.frame(spark, d, KNOWN).withColumn("frontend", F.array_compact(F.array("library"))).withColumn("roles", F.array_compact(F.array("role"))))
query(
    "evidence_gate",
    f"SELECT contact_id, {EVIDENCE} AS evidence, CASE WHEN segment IS NULL OR segment = 'general_engineering' THEN 'unsupported_segment' WHEN {EVIDENCE} IS NULL THEN 'no_evidence_for_' || segment END AS reject_reason FROM {V.sql(KNOWN)} v",
)(lambda spark, d: known(spark, d).select("contact_id", "evidence", "reject_reason"))
SENDER = {"name": "Sam", "company": "Own Co", "address": "1 Main St", "unsubscribe": "https://own.co/u?e="}
TEXTS = "SELECT DISTINCT segment, step, variant, variant || ' note for {{{{company_name}}}}' AS subject, 'Hi {{{{first_name}}}}, we saw {{{{evidence}}}} on {{{{domain}}}}. Step ' || CAST(step AS STRING) AS body FROM (SELECT " + "segment, step, CASE contact_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant FROM (" + KNOWN.strip() + ") k) q"
VARIANT = "CASE contact_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"
query(
    "render_message",
    f"SELECT contact_id, {VARIANT} || ' note for ' || company_name AS subject, 'Hi ' || coalesce(first_name, '') || ', we saw ' || {EVIDENCE} || ' on ' || domain || '. Step ' || CAST(step AS STRING) || chr(10) || chr(10) || 'Best,' || chr(10) || 'Sam' || chr(10) || chr(10) || '---' || chr(10) || "
    f"'Own Co | 1 Main St' || chr(10) || 'Unsubscribe: https://own.co/u?e=' || email AS body FROM {V.sql(KNOWN)} v WHERE {EVIDENCE} IS NOT NULL",
)(lambda spark, d: messages.render_message(known(spark, d).where("reject_reason is null"), V.frame(spark, d, TEXTS), SENDER).select("contact_id", "subject", "body"))
MAILS = """
SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'P' || CAST(event_id % 900 AS STRING) || '@x.com' WHEN 1 THEN 'sue@biz' || CAST(event_id % 300 AS STRING) || '.com' WHEN 2 THEN 'bob@z.com' ELSE 'no address' END AS sender, CASE WHEN event_id % 3 = 0 THEN 'm' || CAST(event_id % 500 AS STRING) END AS in_reply_to,
  CASE event_id % 3 WHEN 0 THEN 'not_interested' WHEN 1 THEN 'positive_interest' ELSE 'unknown' END AS intent FROM {events}
"""
THREADS = "SELECT o_orderkey AS id, 'm' || CAST(o_orderkey % 2000 AS STRING) AS message_id, o_custkey AS company_id, o_custkey % 77 AS contact_id, o_orderkey % 5 AS opportunity_id FROM {orders}"
query(
    "attach_reply_context",
    f"SELECT r.id, coalesce(k.contact_id, t.contact_id) AS contact_id, coalesce(k.company_id, h.company_id, t.company_id) AS company_id, t.opportunity_id FROM {V.sql(MAILS)} r LEFT JOIN (SELECT lower(email) AS email, min(id) AS contact_id, arg_min(company_id, id) AS company_id FROM {V.sql(HEARD)} p GROUP BY lower(email)) k ON k.email = lower(r.sender) "
    f"LEFT JOIN (SELECT host, min(c.id) AS company_id FROM (SELECT DISTINCT regexp_extract(lower(sender), '@(.*)$', 1) AS host FROM {V.sql(MAILS)} r2) q JOIN {V.sql(V.COMPANIES)} c ON host <> '' AND contains(lower(c.domain), host) GROUP BY host) h ON h.host = regexp_extract(lower(r.sender), '@(.*)$', 1) "
    f"LEFT JOIN (SELECT message_id, arg_min(company_id, id) AS company_id, arg_min(contact_id, id) AS contact_id, arg_min(opportunity_id, id) AS opportunity_id FROM {V.sql(THREADS)} m GROUP BY message_id) t ON t.message_id = r.in_reply_to",
)(lambda spark, d: messages.attach_reply_context(V.frame(spark, d, MAILS), V.frame(spark, d, HEARD), V.frame(spark, d, V.COMPANIES), V.frame(spark, d, THREADS)).select("id", "contact_id", "company_id", "opportunity_id"))
query(
    "apply_reply",
    f"SELECT DISTINCT lower(email) AS email FROM {V.sql(V.BOUNCES)} b WHERE id % 2 = 0 UNION SELECT DISTINCT lower(sender) FROM {V.sql(MAILS)} r WHERE intent = 'not_interested'",
)(lambda spark, d: replied(spark, d))


def replied(spark, d):
    replies = V.frame(spark, d, MAILS).withColumn("company_id", F.col("id"))
    offers = V.frame(spark, d, DEALS)
    return messages.apply_reply(offers, V.frame(spark, d, V.BOUNCES).where("id % 2 = 0").select("email"), replies)[1]


STAGED = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'd.com' END AS domain, CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'a@b.gov' ELSE 'p' || CAST(s_suppkey AS STRING) || '@b.com' END AS email, CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'valid' ELSE 'bounced' END AS status,
  CASE s_suppkey % 3 WHEN 0 THEN 'email_permutator' ELSE 'website' END AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'smtp_handshake' END AS verification, s_suppkey % 13 = 0 AS suppressed, s_suppkey % 10 = 2 AS contacted FROM {supplier}
"""
projection(
    "stage_reject_reason", STAGED, lambda: {"id": F.col("id"), "reason": messages.stage_reject_reason(*(F.col(c) for c in ("domain", "email", "status", "source", "verification", "suppressed", "contacted")))},
    "id, CASE WHEN id % 13 = 0 THEN 'suppressed' WHEN id % 7 = 0 THEN 'no_email' WHEN id % 7 = 1 THEN 'blocked_domain' WHEN id % 4 = 3 THEN 'unusable_status' WHEN id % 3 = 0 AND (id % 2 = 1 OR id % 4 = 1) THEN 'unverified_guess' WHEN id % 10 = 2 THEN 'already_contacted' WHEN id % 11 = 0 THEN 'no_domain' END AS reason",
)
