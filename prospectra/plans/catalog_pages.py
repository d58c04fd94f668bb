"""Queries of page analytics, e-mail verdicts and staging; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.operators import outreach, page_parts, pages
from prospectra.plans import views as V
from prospectra.plans.catalog import EXCLUDED, projection, query, quoted, sql_case, sql_contains  # noqa: F401

#: Pages with markup that the raw ones lack, chosen by id.
RICH = """
SELECT page_id, url, html
  || CASE page_id % 5 WHEN 0 THEN '<meta name="generator" content="WordPress 5.' || CAST(page_id % 9 AS STRING) || '">' WHEN 1 THEN '<link href="/wp-content/x.css">' WHEN 2 THEN '<script src="https://static.wixstatic.com/a.js"></script>' ELSE '' END
  || CASE page_id % 4 WHEN 0 THEN '<script src="/js/jquery-1.12.4.min.js"></script>' WHEN 1 THEN '<script src="/_next/static/jquery.3.6.0.js"></script>' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<form><input name=a><input name=b><select></select></form><form><input></form>' WHEN 1 THEN '<img src="http://x.com/a.png"><img loading="lazy" alt="b" src="/b.webp">' ELSE '' END
  || CASE page_id % 7 WHEN 0 THEN '<a href="/contact-us">Contact</a><a href="tel:123">Call</a><a href="/careers/jobs">Jobs</a>' WHEN 1 THEN '<a href="https://boards.greenhouse.io/x">Jobs</a><a href="/pricing">Pricing</a>' WHEN 2 THEN '<script type="application/ld+json">[]</script><meta property="og:title" content="x">' ELSE '' END AS html
FROM {pages}
"""
LINKS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1), 1) - 1 AS position FROM " + V.sql(RICH) + " v)"
query("key_subpages", f"SELECT page_id, href FROM {LINKS} l WHERE starts_with(href, '/') AND regexp_matches(lower(href), '{pages.KEY_PATHS}') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 4")(
    lambda spark, d: pages.key_subpages(page_parts.page_links(V.frame(spark, d, RICH))).select("page_id", F.regexp_extract("target", "^https?://[^/]*(.*)$", 1).alias("href"))
)
fp = lambda: pages.fingerprint(F.col("html"))
WPV = "regexp_extract(html, '(?i)<meta[^>]*name=\"generator\"[^>]*content=\"WordPress\\s*([0-9.]*)', 1)"
projection(
    "tech_fingerprint", RICH, lambda: {"page_id": F.col("page_id"), **fp()},
    f"page_id, CASE WHEN {WPV} <> '' THEN 'WordPress ' || {WPV} WHEN contains(lower(html), 'wp-content') OR contains(lower(html), 'wp-includes') THEN 'WordPress' WHEN contains(lower(html), 'webflow') THEN 'Webflow' WHEN contains(lower(html), 'static.wixstatic.com') THEN 'Wix' END AS cms, "
    f"nullif({WPV}, '') AS wp_version, CASE WHEN contains(lower(html), '/_next/') THEN 'Next.js' ELSE '' END AS frameworks, nullif(regexp_extract(lower(html), 'jquery[-.]([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)', 1), '') AS jquery_version",
)
m = lambda: pages.page_metrics(F.col("html"))
IMGS = "regexp_extract_all(html, '(?i)(<img[^>]*>)', 1)"
projection(
    "page_metrics", RICH, lambda: {"page_id": F.col("page_id"), **m()},
    f"page_id, strlen(html) AS size_bytes, len({IMGS}) AS n_images, len(list_filter({IMGS}, lambda i: NOT contains(lower(i), 'loading='))) AS images_not_lazy, len(list_filter({IMGS}, lambda i: NOT contains(lower(i), 'alt='))) AS images_without_alt, "
    "CAST(coalesce(list_max(list_transform(regexp_extract_all(html, '(?is)<form[^>]*>(.*?)</form>', 1), lambda f: len(regexp_extract_all(f, '(?i)<(input|select|textarea)[\\s>]')))), 0) AS BIGINT) AS max_form_inputs, "
    "regexp_matches(lower(html), 'href=\"tel:') AS tel_link, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS n_h1, regexp_matches(lower(html), 'application/ld\\+json') AS has_schema, regexp_matches(lower(html), 'property=\"og:') AS has_opengraph, regexp_matches(lower(html), '(src|href)=\"http://') AS mixed_content",
)
projection(
    "hiring_signals", RICH, lambda: {"page_id": F.col("page_id"), **pages.hiring_signals(F.col("html"))},
    f"page_id, CASE WHEN contains(lower(html), 'greenhouse.io') THEN 'greenhouse.io' ELSE '' END AS boards, len(regexp_extract_all(lower(html), '<a\\s[^>]*href=\"[^\"]*{pages.CAREERS}')) AS career_links",
)
LIBS = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'jquery' WHEN 1 THEN 'bootstrap' WHEN 2 THEN 'wordpress' WHEN 3 THEN 'angularjs' WHEN 4 THEN 'vue' WHEN 5 THEN 'react' ELSE 'leftpad' END AS library, CAST(p_size % 19 AS STRING) || '.' || CAST(p_partkey % 13 AS STRING) || '.1' AS version FROM {part}"
MAJ, MIN = "CAST(split_part(version, '.', 1) AS INT)", "split_part(version, '.', 2)"
pick = lambda table: "CASE library " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
YEARS = lambda key: f"CASE {key} " + " ".join(f"WHEN '{lib} {k}' THEN {y}" for lib, ys in pages.RELEASES.items() for k, y in ys.items()) + " END"
LATEST = pick({k: v[0] for k, v in pages.LATEST.items()})
REL = f"coalesce({YEARS(f'library || chr(32) || {MAJ} || chr(46) || {MIN}')}, {YEARS(f'library || chr(32) || {MAJ} || chr(46) || 0')}, CASE WHEN {MAJ} = {LATEST} THEN {pick({k: v[1] - 1 for k, v in pages.LATEST.items()})} ELSE 2015 END)"
GAP_, AGE_ = f"greatest(0, {LATEST} - {MAJ})", f"greatest(0, 2026 - {REL})"
debt = lambda: pages.version_debt(F.col("library"), F.col("version"), 2026)
query(
    "version_debt",
    f"SELECT id, {REL} AS release_year, {GAP_} AS major_gap, {AGE_} AS years_outdated, {MAJ} < {pick(pages.END_OF_LIFE_BEFORE)} AS eol, CASE WHEN {MAJ} < {pick(pages.END_OF_LIFE_BEFORE)} OR {AGE_} >= 8 OR {GAP_} >= 2 THEN 'critical' WHEN {GAP_} >= 1 THEN 'high' WHEN {AGE_} >= 4 THEN 'medium' ELSE 'low' END AS risk FROM {V.sql(LIBS)} v WHERE library <> 'leftpad'",
)(lambda spark, d: V.frame(spark, d, LIBS).select("id", debt().alias("debt")).where("debt is not null").select("id", "debt.*"))
#: Sub-scores of the report: speed from the measured score, else from the load time, and deductions from 100, ten at least.
SPEED = "CASE WHEN lighthouse_score IS NOT NULL THEN lighthouse_score ELSE greatest(10, least(100, trunc(100 - coalesce(homepage_ms, 3000) / 45.0))) END"
SECURITY = "greatest(10, 100 - CASE WHEN https THEN 0 ELSE 40 END - CASE WHEN cert_days < 30 THEN 30 ELSE 0 END - CASE WHEN exposed_users THEN 20 ELSE 0 END)"
SEARCH = "greatest(10, 100 - CASE WHEN has_schema THEN 0 ELSE 25 END - CASE WHEN broken_social THEN 20 ELSE 0 END - CASE WHEN deliverability_risk THEN 20 ELSE 0 END - CASE WHEN broken_links > 0 THEN 20 ELSE 0 END)"
HEALTH = f"CAST(trunc(({SPEED} + {SECURITY} + {SEARCH}) / 3.0) AS INT)"
query("health_score", f"SELECT company_id, {HEALTH} AS health, CASE WHEN {HEALTH} >= 85 THEN 'good' WHEN {HEALTH} >= 50 THEN 'fair' ELSE 'poor' END AS label FROM {V.sql(V.TECH)} v")(
    lambda spark, d: pages.health_score(V.frame(spark, d, V.TECH)).select("company_id", "health", "label")
)
PASSES = {
    "homepage_load": "coalesce(homepage_ms, 9999) < 2500", "inner_page_latency": "NOT coalesce(speed_discrepancy, false)", "ttfb": "coalesce(ttfb_ms, 9999) < 800", "one_tap_calling": "NOT coalesce(missing_tel_link, false)",
    "form_friction": "coalesce(max_form_inputs, 0) < 7", "sticky_action_bar": "coalesce(sticky_cta, false)", "local_business_schema": "coalesce(has_schema, false)", "social_cards": "NOT coalesce(broken_social, false)",
    "mail_authentication": "NOT coalesce(deliverability_risk, false)", "internal_links": "coalesce(broken_links, 0) = 0", "image_formats": "coalesce(legacy_images, 0) <= 2", "certificate": "NOT coalesce(cert_days < 30, false) AND coalesce(cert_valid, false)",
}
MEASURED = {"pagespeed_performance": "coalesce(lighthouse_score, 0) >= 70", "largest_contentful_paint": "coalesce(nullif(lcp_ms, 0), 9999) < 2500"}
query(
    "audit_findings",
    " UNION ALL ".join([f"SELECT company_id, '{k}' AS \"check\", {v} AS passed FROM {V.sql(V.TECH)} v" for k, v in PASSES.items()] + [f"SELECT company_id, '{k}', {v} FROM {V.sql(V.TECH)} v WHERE lighthouse_score IS NOT NULL" for k, v in MEASURED.items()]),
)(lambda spark, d: pages.audit_findings(V.frame(spark, d, V.TECH)))

LOCAL = "lower(regexp_extract(coalesce(email, ''), '^([^@]*)', 1))"
ROLE = f"list_filter(list_concat([{LOCAL}], regexp_split_to_array({LOCAL}, '[._-]')), lambda t: t IN ({quoted(outreach.ROLES)}))[1]"
projection("role_account", V.CONTACTS, lambda: {"id": F.col("id"), "role": outreach.role_account(F.col("email"))}, f"id, {ROLE} AS role")
PROBES = """
SELECT 'u' || CAST(l_orderkey % 5000 AS STRING) || '@m.com' AS email, l_linenumber - 1 AS mx_idx,
  CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 250 WHEN 1 THEN 550 WHEN 2 THEN 450 WHEN 3 THEN 552 WHEN 4 THEN 421 WHEN 5 THEN 0 ELSE 554 END AS code,
  CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'User unknown' WHEN 1 THEN 'blocked by list' WHEN 2 THEN 'mailbox full' ELSE 'no' END AS message,
  l_orderkey % 9 = 0 AS catch_all, CASE l_orderkey % 3 WHEN 0 THEN 'zoho' WHEN 1 THEN 'google_workspace' ELSE 'custom_smtp' END AS provider
FROM {lineitem}
"""
REFUSED = sql_case([(sql_contains("lower(message)", w), f"'{n}'") for n, w in (("ip_policy_blocked", outreach.POLICY), ("mailbox_full", outreach.FULL), ("mailbox_not_found", outreach.NOT_FOUND))], "'generic_5xx_rejection'")
#: Order of the answers for one address; a host that answered twice is a tie without the columns after the first.
ANSWERS = "mx_idx, code, message, catch_all, provider"
SUB = "coalesce(d, CASE WHEN last_code IN (421, 450, 451, 452) THEN 'greylisted' ELSE 'connection_failed' END)"
query(
    "classify_probe",
    f"SELECT email, {SUB} AS sub_status, CAST(CASE WHEN {SUB} = 'smtp_accepted' THEN CASE provider WHEN 'zoho' THEN 80.0 WHEN 'google_workspace' THEN 65.0 ELSE 85.0 END WHEN {SUB} = 'catch_all' THEN 40.0 ELSE 0.0 END AS DOUBLE) AS score FROM "
    f"(SELECT email, first(decisive ORDER BY {ANSWERS}) FILTER (decisive IS NOT NULL) AS d, last(code ORDER BY {ANSWERS}) AS last_code, first(provider ORDER BY {ANSWERS}) AS provider FROM (SELECT *, CASE WHEN code IN (250, 251) THEN CASE WHEN catch_all THEN 'catch_all' ELSE 'smtp_accepted' END WHEN code BETWEEN 550 AND 554 THEN {REFUSED} END AS decisive FROM (SELECT DISTINCT * FROM {V.sql(PROBES)} u) v WHERE mx_idx < 3) w GROUP BY email) x",
)(lambda spark, d: outreach.classify_probe(V.frame(spark, d, PROBES).distinct()))
VERDICT = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'info' WHEN 1 THEN 'jane' WHEN 2 THEN 'bad..one' WHEN 3 THEN 'sales.team' ELSE 'x' || CAST(s_suppkey AS STRING) END || '@biz.com' AS email, s_suppkey % 7 = 0 AS disposable, s_suppkey % 5 <> 0 AS has_mx, CASE s_suppkey % 4 WHEN 0 THEN 'smtp_accepted' WHEN 1 THEN 'mailbox_full' END AS probe_status, CASE s_suppkey % 4 WHEN 0 THEN 45.0D WHEN 1 THEN 0.0D END AS probe_score FROM {supplier}"
VERDICT_SQL = VERDICT.replace("45.0D", "45.0").replace("0.0D", "0.0")
SUBV = f"CASE WHEN contains(email, '..') THEN 'malformed_syntax' WHEN disposable THEN 'disposable_email' WHEN NOT has_mx THEN 'no_mx_records' WHEN probe_status = 'smtp_accepted' AND {ROLE} IS NOT NULL THEN 'role_account' WHEN probe_status IS NOT NULL THEN probe_status WHEN {ROLE} IS NOT NULL THEN 'role_account' ELSE 'dns_mx_verified' END"
query(
    "email_verdict",
    f"SELECT id, sub_status, CAST(CASE WHEN sub_status IN ('malformed_syntax', 'disposable_email', 'no_mx_records') THEN 0.0 WHEN probe_status IS NOT NULL THEN CASE WHEN probe_status = 'smtp_accepted' AND r IS NOT NULL THEN greatest(40.0, probe_score - 10) ELSE probe_score END WHEN r IS NOT NULL THEN 65.0 ELSE 85.0 END AS DOUBLE) AS score FROM (SELECT *, {ROLE} AS r, {SUBV} AS sub_status FROM {V.sql(VERDICT_SQL)} v) w",
)(lambda spark, d: outreach.email_verdict(V.frame(spark, d, VERDICT)).select("id", "sub_status", "score"))
MX = "SELECT DISTINCT 'd' || CAST(s_suppkey % 20 AS STRING) || '.com' AS domain, CASE WHEN s_suppkey % 9 = 0 THEN '.' ELSE 'mx' || CAST(s_suppkey AS STRING) || '.net' END AS host, s_suppkey % 3 * 10 AS preference FROM {supplier}"
query("mx_rank", f"SELECT domain, host, preference, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_primary FROM {V.sql(MX)} v WHERE host NOT IN ('', '.') WINDOW w AS (PARTITION BY domain ORDER BY preference, host)")(lambda spark, d: outreach.mx_rank(V.frame(spark, d, MX)))
SEG = "SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'staff_augmentation' WHEN 1 THEN 'cms_to_laravel_migration' WHEN 2 THEN 'performance_optimization' WHEN 3 THEN 'new_website_creation' END AS opportunity, c_custkey % 13 <> 0 AS has_website, c_custkey % 17 = 0 AS hiring, CASE WHEN c_custkey % 8 = 0 THEN 'WordPress 6' END AS cms, CASE WHEN c_custkey % 3 = 0 THEN 'jQuery 3.1' END AS library FROM {customer}"
query(
    "segment_lead",
    f"SELECT id, CASE WHEN opportunity = 'new_website_creation' OR NOT has_website THEN 'new_website_creation' WHEN opportunity = 'staff_augmentation' OR hiring THEN 'staff_augmentation' WHEN opportunity = 'cms_to_laravel_migration' OR cms IS NOT NULL THEN 'laravel_modernization' WHEN library IS NOT NULL THEN 'frontend_modernization' WHEN opportunity = 'performance_optimization' THEN 'speed_optimization' ELSE 'general_engineering' END AS segment FROM {V.sql(SEG)} v",
)(lambda spark, d: outreach.segment_lead(V.frame(spark, d, SEG)).select("id", "segment"))
PEOPLE = "SELECT c_custkey AS id, 'Jo' || CAST(c_custkey % 90 AS STRING) AS first_name, 'Doe' || CAST(c_custkey % 70 AS STRING) AS last_name, 'biz' || CAST(c_custkey AS STRING) || '.com' AS domain FROM {customer}"
PATTERNS = ["lower(first_name) || '.' || lower(last_name)", "substr(lower(first_name), 1, 1) || lower(last_name)", "lower(first_name)", "lower(first_name) || lower(last_name)", "lower(last_name)"]
query("email_candidates", " UNION ALL ".join(f"SELECT id, {i} AS position, {p} || '@' || domain AS email FROM {V.sql(PEOPLE)} v" for i, p in enumerate(PATTERNS)))(lambda spark, d: outreach.email_candidates(V.frame(spark, d, PEOPLE)))
TIERS = "SELECT event_id AS id, user_id AS company_id, CASE WHEN user_id % 3 = 0 THEN event_id % 5 ELSE 2 + event_id % 3 END AS tier, 'C' || CAST(event_id % 60 AS STRING) || '@x.com' AS email FROM {events}"
query("enrichment_waterfall", f"SELECT id, company_id, tier, email FROM (SELECT *, min(tier) OVER (PARTITION BY company_id) AS best FROM {V.sql(TIERS)} v) w WHERE tier = best QUALIFY row_number() OVER (PARTITION BY company_id, lower(email) ORDER BY id) = 1")(
    lambda spark, d: outreach.enrichment_waterfall(V.frame(spark, d, TIERS)).select("id", "company_id", "tier", "email")
)
