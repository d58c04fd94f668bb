"""Queries of the lead flow; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.functions import text as T
from prospectra.operators import leads, pages, relational, scoring, worklists
from prospectra.plans import catalog as C
from prospectra.plans import views as V
from prospectra.plans.catalog import projection, query, quoted, sql_case, sql_contains
from prospectra.plans.catalog_pages import LINKS, RICH

projection("slugify", V.COMPANIES, lambda: {"id": F.col("id"), "slug": T.slugify(F.col("name"))}, f"id, {C.SLUG.format('name')} AS slug")
BUDGETS = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Budget: $' || CAST(o_orderkey % 900 AS STRING) || ',000 fixed' WHEN 1 THEN 'pays $' || CAST(o_orderkey % 90 AS STRING) || 'k or more' ELSE 'open' END AS text FROM {orders}"
projection("extract_budget", BUDGETS, lambda: {"id": F.col("id"), "budget": T.extract_budget(F.col("text"))}, r"id, coalesce(nullif(regexp_extract(text, '(\$[0-9][0-9,]*(?:\.[0-9]+)?[kK]?)', 1), ''), 'Not specified') AS budget")
REDIRECTS = "SELECT page_id, 'https://r.example.com/go?x=1&url=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&z=' || CAST(page_id AS STRING) AS link FROM {pages} WHERE url NOT LIKE '%#%' AND url NOT LIKE '%&%'"
projection("redirect_target", REDIRECTS, lambda: {"page_id": F.col("page_id"), "target": T.redirect_target(F.col("link"))}, "page_id, url_decode(nullif(regexp_extract(link, '[?&]url=([^&#]*)', 1), '')) AS target")
PREFIX, DOMAIN = "regexp_extract(lower(trim(email)), '^([^@]*)@', 1)", "regexp_extract(lower(trim(email)), '@(.*)$', 1)"
STOP = quoted(leads.BRAND_STOP_WORDS)
STEM = f"split_part({DOMAIN}, '.', 1)"
TOKENS = rf"list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP}))"
GATE = sql_case(
    [
        ("NOT contains(email, '@')", "'missing_or_malformed'"), (r"NOT regexp_matches(lower(trim(email)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$')", "'invalid_email_regex'"),
        (f"length({PREFIX}) < 2 OR {PREFIX} IN ('noreply') OR starts_with({PREFIX}, 'helpdesk')", "'blocked_prefix'"), (f"{DOMAIN} IN ('yelp.com', 'example.com')", "'blocked_domain'"),
        ("throwaway", "'disposable_domain'"), (f"contains({DOMAIN}, '.gov') OR contains({DOMAIN}, '.in')", "'blocked_tld_or_government'"), (f"{DOMAIN} IN ('gmail.com', 'att.net')", "'valid_common_provider'"),
        (f"{DOMAIN} = company_domain AND NOT ends_with(company_domain, '.local')", "'valid_company_domain'"),
        (f"(company_domain IS NULL OR ends_with(company_domain, '.local')) AND len({TOKENS}) > 0 AND len(list_filter({TOKENS}, lambda t: contains({STEM}, t) OR (length({STEM}) >= 4 AND contains(t, {STEM})) OR (length({STEM}) >= 3 AND starts_with(t, {STEM}[1:3])))) = 0", "'custom_domain_mismatch'"),
    ], "'valid_custom_domain'",
)
LEADS = """
SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'info' WHEN 1 THEN 'noreply' WHEN 2 THEN 'j' WHEN 3 THEN 'helpdesk1' WHEN 4 THEN 'a b' ELSE 'jo' END || CASE WHEN c_custkey % 31 = 0 THEN '' ELSE '@' END
    || CASE c_custkey % 11 WHEN 0 THEN 'Gmail.com' WHEN 1 THEN 'city.gov' WHEN 2 THEN 'biz' || CAST(c_custkey % 4 AS STRING) || '.com' WHEN 3 THEN 'yelp.com' WHEN 4 THEN 'example.com' WHEN 5 THEN 'att.net'
      WHEN 6 THEN 'harborshop.com' WHEN 7 THEN 'harb.net' WHEN 8 THEN 'oak.io' ELSE 'my.inner.com' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'biz2.com' WHEN 1 THEN 'x.local' END AS company_domain, CASE c_custkey % 4 WHEN 0 THEN 'Harbor & Sons, LLC' WHEN 1 THEN 'The Oakland Law Firm' WHEN 2 THEN 'Inc Co' ELSE 'Zed 77 Myth' END AS name,
  c_custkey % 29 = 0 AS throwaway
FROM {customer}
"""
projection(
    "lead_email_gate", LEADS, lambda: {"id": F.col("id"), "verdict": leads.lead_email_gate(F.col("email"), F.col("company_domain"), F.col("name"), None, F.col("throwaway"))}, f"id, {GATE} AS verdict"
)
projection("brand_token_match", LEADS, lambda: {"id": F.col("id"), "n_tokens": leads.brand_token_match(leads.brand_tokens(F.col("name")), F.regexp_extract(F.lower("email"), "@(.*)$", 1)).cast("long")}, f"id, len(list_filter({TOKENS}, lambda t: contains({STEM}, t))) AS n_tokens")
TITLES = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Founder & CEO' WHEN 1 THEN 'CTO' WHEN 2 THEN 'VP Marketing' WHEN 3 THEN 'Head of Operations' WHEN 4 THEN p_type ELSE NULL END AS title FROM {part}"
projection("role_category", TITLES, lambda: {"id": F.col("id"), "role": leads.role_category(F.col("title"))}, "id, " + sql_case([(f"regexp_matches(lower(coalesce(title, '')), '{p}')", f"'{n}'") for n, p in leads.ROLE_TITLES], "'other'") + " AS role")
NAMED = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'blue-fox' || CAST(c_custkey AS STRING) || '.com' WHEN 1 THEN 'Acme Inc' ELSE '' END AS company, CASE c_custkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'info' WHEN 2 THEN NULL WHEN 3 THEN 'x@y.com' ELSE 'azumo.com' END AS first FROM {customer}"
BOT = r"(first IS NULL OR contains(first, '@') OR regexp_matches(lower(first), '\.(com|net|org|io|ai|co|agency)') OR lower(first) IN ('team', 'info', 'contact', 'support', 'admin', 'sales', 'hello', 'hi', 'careers', 'office'))"
projection("greeting_name", NAMED, lambda: {"id": F.col("id"), "greeting": leads.greeting_name(F.col("first"), F.col("company"))}, f"id, CASE WHEN NOT {BOT} THEN first WHEN company <> '' THEN company || ' team' ELSE 'there' END AS greeting")
projection("display_company_name", NAMED, lambda: {"id": F.col("id"), "shown": leads.display_company_name(F.col("company"))}, "id, CASE WHEN ends_with(company, '.com') THEN 'Blue Fox' || CAST(id AS STRING) ELSE company END AS shown")
query("copy_segment", f"SELECT company_id, CASE WHEN lower(coalesce(cms, '')) = 'wordpress' THEN 'laravel_modernization' WHEN library IS NOT NULL THEN 'frontend_modernization' WHEN lcp_ms > 2500 THEN 'speed_optimization' WHEN coalesce(cms, '') <> '' THEN 'laravel_modernization' END AS segment FROM {V.sql(C.WITH_STACK)} v")(
    lambda spark, d: leads.copy_segment(V.frame(spark, d, C.WITH_STACK)).select("company_id", "segment")
)
COUNTED = f"SELECT v.*, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END AS n_contacts FROM ({V.COMPANIES}) v"
projection("contact_quality", COUNTED, lambda: {"id": F.col("id"), "quality": scoring.contact_quality()}, "id, CAST(least(100.0, 50.0 + CASE WHEN website_url IS NOT NULL THEN 25.0 ELSE 0.0 END + CASE WHEN contains(domain, '.') THEN 25.0 ELSE 0.0 END + 10.0 * coalesce(n_contacts, 0)) AS DOUBLE) AS quality")


query("service_fit", f"SELECT company_id, CAST(least(100.0, 40.0 + CASE WHEN type IN ({quoted(scoring.HIGH_VALUE)}) THEN 25.0 ELSE 15.0 END) AS DOUBLE) AS service_fit, CAST(estimated_value_low AS BIGINT) AS deal_low, CAST(estimated_value_high AS BIGINT) AS deal_high FROM ({C.OPPS}) o")(
    lambda spark, d: scoring.service_fit(scoring.detect_opportunities(C.pains(spark, d))).select("company_id", "service_fit", F.col("deal_low").cast("long").alias("deal_low"), F.col("deal_high").cast("long").alias("deal_high"))
)
SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
query("top_findings", f"SELECT company_id, type, severity FROM {C.PAINS} p QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY {SEV}, rule) <= 6")(lambda spark, d: leads.top_findings(C.pains(spark, d)).select("company_id", "type", "severity"))
query("first_pain_per_type", f"SELECT company_id, type, severity FROM {C.PAINS} p QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY rule) = 1")(
    lambda spark, d: relational.keep_first(C.pains(spark, d), [F.col("company_id"), F.col("type")], "position").select("company_id", "type", "severity")
)
query("audit_worklist", f"SELECT id FROM {V.sql(V.COMPANIES)} c WHERE website_url IS NOT NULL AND ({C.EXCLUDED}) = '' AND (last_crawled_at IS NULL OR id NOT IN (SELECT user_id FROM events) OR last_crawled_at < {C.AS_OF} - INTERVAL 7 DAY)")(
    lambda spark, d: leads.audit_worklist(V.frame(spark, d, V.COMPANIES), spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("company_id")), D.is_excluded_domain(F.col("domain"))["excluded"], C.as_of()).select("id")
)
query("resolution_worklist", f"SELECT id FROM {V.sql(V.COMPANIES)} c WHERE (ends_with(domain, '.yelp.com') AND last_crawled_at IS NULL) OR source = 'local_business_directory' ORDER BY id DESC LIMIT 50")(
    lambda spark, d: worklists.resolution_worklist(V.frame(spark, d, V.COMPANIES), "yelp.com", "local_business_directory").select("id")
)
query("crawl_backlog", f"SELECT id, domain FROM {V.sql(V.COMPANIES)} c WHERE {C.REASON} IS NULL ORDER BY id LIMIT 100")(lambda spark, d: worklists.crawl_backlog(V.frame(spark, d, V.COMPANIES)).select("id", "domain"))
LATEST = f"(SELECT * FROM {V.sql(V.SCORES)} v QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id DESC) = 1)"
MESSAGES = "SELECT event_id AS id, 'm' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) AS message_id, 'User' || CAST(user_id % 60 AS STRING) || '@mail' || CAST(user_id % 7 AS STRING) || '.com' AS email FROM {events}"
PEOPLE = "SELECT c_custkey AS id, c_custkey % 30 AS company_id, 'user' || CAST(c_custkey % 45 AS STRING) || '@mail' || CAST(c_custkey % 7 AS STRING) || '.com' AS email FROM {customer}"
THREADED = V.BOUNCES.replace("ts,", "ts, 'm' || CAST(event_id + 1 AS STRING) AS in_reply_to,")
query(
    "attach_bounce_context",
    f"SELECT b.id, p.contact_id, p.company_id, coalesce(t.id, l.latest_id) AS message FROM {V.sql(THREADED)} b LEFT JOIN (SELECT lower(email) AS email, min(id) AS contact_id, arg_min(company_id, id) AS company_id FROM {V.sql(PEOPLE)} p GROUP BY 1) p ON p.email = lower(b.email) "
    f"LEFT JOIN (SELECT lower(email) AS email, max(id) AS latest_id FROM {V.sql(MESSAGES)} m GROUP BY 1) l ON l.email = lower(b.email) LEFT JOIN (SELECT message_id, min(id) AS id FROM {V.sql(MESSAGES)} m2 GROUP BY message_id) t ON t.message_id = b.in_reply_to",
)(lambda spark, d: leads.attach_bounce_context(V.frame(spark, d, THREADED).select("id", "email", "in_reply_to"), V.frame(spark, d, PEOPLE), V.frame(spark, d, MESSAGES)).select("id", "contact_id", "company_id", "message"))
query("apply_suppression", f"SELECT id, CASE WHEN lower(email) IN (SELECT lower(email) FROM {V.sql(PEOPLE)} s WHERE id % 97 = 0) THEN 'bounced' ELSE 'valid' END AS email_status FROM {V.sql(PEOPLE)} p")(
    lambda spark, d: leads.apply_suppression(V.frame(spark, d, PEOPLE).withColumn("email_status", F.lit("valid")), V.frame(spark, d, PEOPLE).where("id % 97 = 0")).select("id", "email_status")
)
OPEN = "SELECT c_custkey AS id, c_custkey AS company_id, CASE c_custkey % 4 WHEN 0 THEN 'converted' ELSE 'detected' END AS status FROM {customer}"
SAID = "SELECT event_id AS id, user_id AS company_id, CASE event_id % 3 WHEN 0 THEN 'positive_interest' WHEN 1 THEN 'not_interested' ELSE 'unknown' END AS intent FROM {events}"
query("apply_reply_intent", f"SELECT o.id, CASE WHEN status = 'converted' THEN status WHEN intent = 'positive_interest' THEN 'in_discussion' WHEN intent = 'not_interested' THEN 'closed_lost' ELSE status END AS status FROM {V.sql(OPEN)} o LEFT JOIN (SELECT company_id, arg_max(intent, id) AS intent FROM {V.sql(SAID)} s GROUP BY company_id) s ON s.company_id = o.company_id")(
    lambda spark, d: leads.apply_reply_intent(V.frame(spark, d, OPEN), V.frame(spark, d, SAID)).select("id", "status")
)
CHANGES = "SELECT c_custkey AS id, 'biz' || CAST(c_custkey % 1200 + 300 AS STRING) || '.com' AS new_domain, 'https://new' || CAST(c_custkey AS STRING) AS new_url FROM {customer} WHERE c_custkey % 4 = 0"
query("repoint_domain", f"SELECT c.id, CASE WHEN new_domain IS NOT NULL AND (owner IS NULL OR owner = c.id) THEN new_domain ELSE c.domain END AS domain, coalesce(new_url, website_url) AS website_url FROM {V.sql(V.COMPANIES)} c LEFT JOIN {V.sql(CHANGES)} n ON n.id = c.id LEFT JOIN (SELECT domain, min(id) AS owner FROM {V.sql(V.COMPANIES)} x GROUP BY domain) t ON t.domain = n.new_domain")(
    lambda spark, d: leads.repoint_domain(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, CHANGES)).select("id", "domain", "website_url")
)
query("patch_company_columns", f"SELECT c.id, coalesce(n.new_url, c.website_url) AS website_url FROM {V.sql(V.COMPANIES)} c LEFT JOIN {V.sql(CHANGES)} n ON n.id = c.id")(
    lambda spark, d: leads.patch_columns(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, CHANGES).select("id", F.col("new_url").alias("website_url")), "id", ["website_url"]).select("id", "website_url")
)
YIELD = "SELECT event_type AS source, event_id % 40 AS page FROM {events}"
query("discovery_yield", f"SELECT source, CAST(sum(n) AS BIGINT) AS accepted, count(*) AS pages FROM (SELECT source, page, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT source, page, count(*) AS n FROM {V.sql(YIELD)} v GROUP BY 1, 2) g) h WHERE b < 50 GROUP BY source")(
    lambda spark, d: leads.discovery_yield(V.frame(spark, d, YIELD), 50)
)
RECORDS = "SELECT 'd' || CAST(c_custkey % 300 AS STRING) || '.com' AS domain, CASE c_custkey % 3 WHEN 0 THEN 'MX' ELSE 'TXT' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'v=spf1 include:x' WHEN 1 THEN 'v=DMARC1; p=none' ELSE 'other' END AS value FROM {customer}"
HAS = lambda c: f"coalesce(bool_or({c}), false)"
MXQ = f"SELECT domain, {HAS("kind = 'MX'")} AS has_mx, {HAS("kind = 'TXT' AND starts_with(lower(value), 'v=spf1')")} AS has_spf, {HAS("kind = 'TXT' AND starts_with(lower(value), 'v=dmarc1')")} AS has_dmarc FROM {V.sql(RECORDS)} v GROUP BY domain"
query("mail_dns_metrics", f"SELECT *, has_mx AND NOT (has_spf AND has_dmarc) AS risk FROM ({MXQ}) x")(lambda spark, d: leads.mail_dns_metrics(V.frame(spark, d, RECORDS)))
RESOLVED = "SELECT c_custkey AS id, 'co' || CAST(c_custkey AS STRING) AS slug, CASE WHEN c_custkey % 5 = 0 THEN 'b.com' END AS bureau_domain, CASE WHEN c_custkey % 3 = 0 THEN 'r.com' END AS registry_domain, CASE WHEN c_custkey % 7 = 0 THEN 's.com' END AS social_domain, CASE WHEN c_custkey % 2 = 0 THEN 'f.com' END AS footprint_domain FROM {customer}"
FOUND = "coalesce(bureau_domain, registry_domain, social_domain, footprint_domain)"
query("lead_resolution", f"SELECT id, coalesce({FOUND}, slug || '.local') AS resolved_domain, CASE WHEN {FOUND} IS NULL THEN 'no_website_verified' ELSE 'resolved_real_domain' END AS outcome, CAST(CASE WHEN {FOUND} IS NULL THEN 100.0 END AS DOUBLE) AS score FROM {V.sql(RESOLVED)} v")(
    lambda spark, d: leads.lead_resolution(V.frame(spark, d, RESOLVED)).select("id", "resolved_domain", "outcome", "score")
)
query("stage_run_status", "SELECT event_id AS id, CASE WHEN event_id % 5 > 0 AND event_id % 3 = 0 THEN 'failed' WHEN event_id % 5 > 0 THEN 'partial' ELSE 'success' END AS status FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), leads.stage_run_status(F.col("event_id") % 3, F.col("event_id") % 5).alias("status"))
)
query("dedupe_messages", f"SELECT id FROM {V.sql(MESSAGES)} m QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY id) = 1")(lambda spark, d: relational.keep_first(V.frame(spark, d, MESSAGES), [F.lower("email")], "id").select("id"))
query("dedupe_opportunities", f"SELECT id, company_id FROM {V.sql(V.SIGNALS)} m QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY id) = 1")(
    lambda spark, d: relational.keep_first(V.frame(spark, d, V.SIGNALS), [F.col("company_id"), F.col("type")], "id").select("id", "company_id")
)
query("purge_invalid_recipients", f"SELECT id, email, 'kept' AS kind, email_status FROM {V.sql(V.CONTACTS)} c WHERE NOT regexp_matches(email, '(^@|\\.\\.|nodot$)') UNION ALL SELECT id, email, 'all', CASE WHEN regexp_matches(email, '(^@|\\.\\.|nodot$)') THEN 'invalid' ELSE email_status END FROM {V.sql(V.CONTACTS)} c")(
    lambda spark, d: purged(spark, d)
)


def purged(spark, d):
    rows, bad = V.frame(spark, d, V.CONTACTS), r"(^@|\.\.|nodot$)"
    kept, marked = worklists.purge_invalid_recipients(rows, bad), worklists.purge_invalid_recipients(rows, bad, invalidate=True)
    return kept.select("id", "email", F.lit("kept").alias("kind"), "email_status").unionByName(marked.select("id", "email", F.lit("all").alias("kind"), "email_status"))
query("lookup_by_key", f"SELECT id, company_id, type FROM {V.sql(V.SIGNALS)} s WHERE company_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) ORDER BY id")(
    lambda spark, d: worklists.lookup_by_key(V.frame(spark, d, V.SIGNALS), spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("company_id")), "company_id").select("id", "company_id", "type")
)
