"""Queries over the given tables, by operator name, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.functions import text as T
from prospectra.operators import feeds, relational, scoring, worklists
from prospectra.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def projection(name: str, view: str, columns: Callable[[], dict], oracle_columns: str) -> None:
    """A query that adds column functions to a view, held against the same columns in SQL."""
    query(name, f"SELECT {oracle_columns} FROM {V.sql(view)} v")(lambda spark, d: V.frame(spark, d, view).select(*(c.alias(n) if n else c for n, c in columns().items())))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + f" ELSE {default} END"


# ---- column functions
PAGES = "SELECT page_id, url, html FROM {pages}"
HOST = r"trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce({0}, ''))), '^https?://', ''), '^([^/?#]*)', 1), ':.*$', ''), '^www\.', ''))"
SLUG = "regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
NAME = SLUG.format(r"regexp_replace(lower(trim(coalesce(name, ''))), '\b(llc|inc|corp|corporation|co|ltd|pllc|pc|dds|dmd|group)\b', '', 'g')")
CITY = SLUG.format("city")
projection("normalize_domain", PAGES, lambda: {"page_id": F.col("page_id"), "domain": T.normalize_domain(F.col("url"))}, f"page_id, {HOST.format('url')} AS domain")
projection("normalize_company_name", V.COMPANIES, lambda: {"id": F.col("id"), "slug": T.normalize_company_name(F.col("name"))}, f"id, {NAME} AS slug")
projection(
    "name_city_key", V.COMPANIES, lambda: {"id": F.col("id"), "key": T.name_city_key(F.col("name"), F.col("city"))}, f"id, CASE WHEN {CITY} = '' THEN {NAME} ELSE {NAME} || ':' || {CITY} END AS key"
)
projection(
    "synthetic_domain",
    V.COMPANIES,
    lambda: {"id": F.col("id"), "domain": T.synthetic_domain(F.col("name"), F.col("city"))},
    f"id, {SLUG.format('name')} || CASE WHEN {CITY} = '' THEN '' ELSE '-' || {CITY} END || '.local' AS domain",
)
AGG = quoted(D.AGGREGATORS)
EXCLUDED = (
    "CASE WHEN coalesce(domain, '') = '' THEN 'empty_domain' WHEN regexp_matches(lower(domain), '\\.(local|internal|localhost)$') THEN 'internal_test_domain' "
    f"WHEN array_to_string(list_slice(string_split(lower(domain), '.'), -2, -1), '.') IN ({AGG}) THEN 'directory_aggregator_' || array_to_string(list_slice(string_split(lower(domain), '.'), -2, -1), '.') "
    f"WHEN array_to_string(list_slice(string_split(lower(domain), '.'), -3, -1), '.') IN ({AGG}) THEN 'directory_aggregator_' || array_to_string(list_slice(string_split(lower(domain), '.'), -3, -1), '.') ELSE '' END"
)
projection(
    "is_excluded_domain",
    V.COMPANIES,
    lambda: {"id": F.col("id"), "excluded": D.is_excluded_domain(F.col("domain"))["excluded"], "reason": D.is_excluded_domain(F.col("domain"))["reason"]},
    f"id, ({EXCLUDED}) <> '' AS excluded, {EXCLUDED} AS reason",
)
STATUS = r"TRY_CAST(nullif(regexp_extract(error, 'HTTP\s+([0-9]{3})', 1), '') AS INT)"
RETRYABLE = f"NOT (coalesce({STATUS} IN ({', '.join(map(str, D.PERMANENT_STATUS))}), false) OR {sql_contains('lower(error)', D.PERMANENT_ERRORS)})"
status = lambda: F.nullif(F.regexp_extract("error", r"HTTP\s+([0-9]{3})", 1), F.lit("")).cast("int")
projection("is_retryable_failure", V.FAILURES, lambda: {"id": F.col("id"), "retryable": D.is_retryable_failure(status(), F.col("error"))}, f"id, {RETRYABLE} AS retryable")
ALL_TEXT = "lower(name || ' ' || coalesce(domain, '') || ' ' || coalesce(industry, ''))"
projection("is_agency", V.COMPANIES, lambda: {"id": F.col("id"), "agency": D.is_agency(F.col("name"), F.col("domain"), F.col("industry"))}, f"id, {sql_contains(ALL_TEXT, D.AGENCY_WORDS)} AS agency")
INDUSTRY = sql_case([(sql_contains("lower(name || ' ' || coalesce(industry, ''))", words), f"'{label}'") for label, words in D.INDUSTRIES.items()], f"'{D.DEFAULT_INDUSTRY}'")
projection(
    "classify_industry", V.COMPANIES, lambda: {"id": F.col("id"), "target_industry": D.classify_industry(F.concat_ws(" ", "name", F.coalesce("industry", F.lit(""))))}, f"id, {INDUSTRY} AS target_industry"
)
S = scoring.SUPPLIERS
LOW = lambda c: f"lower(trim(coalesce({c}, '')))"
REASON = (
    "coalesce("
    + "CASE " + " ".join(f"WHEN contains({LOW('industry')}, '{k}') THEN 'industry_keyword:{k}'" for k in S["industry"]) + " END, "
    + f"CASE WHEN NOT {sql_contains(LOW('industry'), scoring.TARGET_INDUSTRIES)} THEN CASE " + " ".join(f"WHEN regexp_matches({LOW('name')}, '\\b{k}\\b') THEN 'name_keyword:{k}'" for k in S["name"]) + " END END, "
    + "CASE " + " ".join(f"WHEN regexp_matches({LOW('domain')}, '{p}') THEN 'domain_pattern:{p}'" for p in S["domain"]) + " END)"
)
query("disqualify_company", f"SELECT id, {REASON} AS disqualified_reason FROM {V.sql(V.COMPANIES)} v")(
    lambda spark, d: scoring.disqualify_company(V.frame(spark, d, V.COMPANIES)).select("id", "disqualified_reason")
)
EMP = "replace(lower(coalesce(employees, '')), ',', '')"
num = lambda p, g: f"TRY_CAST(nullif(regexp_extract({EMP}, '{p}', {g}), '') AS BIGINT)"
SPAN, PLUS, ONE = r"([0-9]+)\s*(?:-|to)\s*([0-9]+)", r"([0-9]+)\s*\+", "([0-9]+)"
LO, HI = f"coalesce({num(SPAN, 1)}, {num(PLUS, 1)}, {num(ONE, 1)})", f"CASE WHEN {num(SPAN, 1)} IS NOT NULL THEN {num(SPAN, 2)} WHEN {num(PLUS, 1)} IS NOT NULL THEN {num(PLUS, 1)} * 2 ELSE {num(ONE, 1)} END"
projection("parse_employee_bounds", V.COMPANIES, lambda: {"id": F.col("id"), "lo": T.parse_employee_bounds(F.col("employees"))["lo"], "hi": T.parse_employee_bounds(F.col("employees"))["hi"]}, f"id, {LO} AS lo, {HI} AS hi")
CONF = "CASE WHEN confidence IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, CASE WHEN confidence > 1 THEN CAST(confidence AS DOUBLE) / 100 ELSE CAST(confidence AS DOUBLE) END)) END"
projection("normalize_confidence", V.SIGNALS, lambda: {"id": F.col("id"), "confidence": T.normalize_confidence(F.col("confidence"))}, f"id, CAST({CONF} AS DOUBLE) AS confidence")
PHONES = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '(305) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '+1 212.555.' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 2 THEN '555-' || CAST(c_custkey AS STRING) ELSE NULL END AS phone FROM {customer}"
TEN = "CASE WHEN length(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) = 11 AND starts_with(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), '1') THEN substr(regexp_replace(phone, '[^0-9]', '', 'g'), 2) WHEN length(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) = 10 THEN regexp_replace(phone, '[^0-9]', '', 'g') END"
phone = lambda: T.normalize_phone(F.col("phone"))
projection(
    "normalize_phone", PHONES, lambda: {"id": F.col("id"), "e164": phone()["e164"], "national": phone()["national"]},
    f"id, '+1' || {TEN} AS e164, '(' || substr({TEN}, 1, 3) || ') ' || substr({TEN}, 4, 3) || '-' || substr({TEN}, 7, 4) AS national",
)
TITLES = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand || ': ' || p_name WHEN 1 THEN p_name || ' at ' || p_brand WHEN 2 THEN p_brand || ' is hiring ' || p_type WHEN 3 THEN p_name || ' - ' || p_brand ELSE p_name END AS title FROM {part}"
title = lambda: T.split_job_title(F.col("title"))
sp = lambda mark, i: f"trim(string_split(title, '{mark}')[{i}])"
projection(
    "split_job_title", TITLES, lambda: {"id": F.col("id"), "company": title()["company"], "role": title()["role"]},
    "id, " + sql_case([("contains(title, ': ')", sp(": ", 1)), ("contains(title, ' at ')", sp(" at ", 2)), ("contains(title, ' is hiring ')", sp(" is hiring ", 1)), ("contains(title, ' - ')", f"CASE WHEN length({sp(' - ', 1)}) <= length({sp(' - ', 2)}) THEN {sp(' - ', 1)} ELSE {sp(' - ', 2)} END")], "''") + " AS company, "
    + sql_case([("contains(title, ': ')", sp(": ", 2)), ("contains(title, ' at ')", sp(" at ", 1)), ("contains(title, ' is hiring ')", sp(" is hiring ", 2)), ("contains(title, ' - ')", f"CASE WHEN length({sp(' - ', 1)}) <= length({sp(' - ', 2)}) THEN {sp(' - ', 2)} ELSE {sp(' - ', 1)} END")], "trim(title)") + " AS role",
)
projection(
    "extract_emails", "SELECT doc_id, text FROM {documents}", lambda: {"doc_id": F.col("doc_id"), "n_emails": F.size(T.extract_emails(F.col("text"))).cast("long"), "emails": F.array_join(F.sort_array(T.extract_emails(F.col("text"))), " ")},
    r"doc_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})', 1), lambda e: regexp_replace(e, '^[.]+|[.]+$', '', 'g')), lambda e: NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|svg|webp|css|js)$')))) AS BIGINT) AS n_emails, "
    r"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})', 1), lambda e: regexp_replace(e, '^[.]+|[.]+$', '', 'g')), lambda e: NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|svg|webp|css|js)$')))), ' ') AS emails",
)
HOSTS = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'ASPMX.L.Google.com' WHEN 1 THEN 'x.mail.protection.outlook.com' WHEN 2 THEN 'mx1.pphosted.com' WHEN 3 THEN 'eu.mimecast.com' WHEN 4 THEN 'mx.zoho.eu' WHEN 5 THEN NULL ELSE 'mx' || CAST(c_custkey AS STRING) || '.host.net' END AS mx FROM {customer}"
projection("mail_provider", HOSTS, lambda: {"id": F.col("id"), "provider": D.mail_provider(F.col("mx"))}, "id, " + sql_case([(sql_contains("lower(coalesce(mx, ''))", p), f"'{n}'") for n, p in D.MAIL_PROVIDERS], "'custom_smtp'") + " AS provider")
E0, P = "trim(coalesce(email, ''))", "string_split(trim(coalesce(email, '')), '@')"
LB = f"string_split({P}[2], '.')"
projection(
    "validate_email_syntax", V.CONTACTS, lambda: {"id": F.col("id"), "problem": D.validate_email_syntax(F.col("email"))},
    "id, " + sql_case([
        (f"{E0} = ''", "'empty'"), (f"len({P}) < 2", "'no_at'"), (f"len({P}) > 2", "'several_at'"), (f"{P}[1] = ''", "'no_local'"), (f"length({P}[1]) > 64", "'local_too_long'"),
        (f"starts_with({P}[1], '.') OR ends_with({P}[1], '.')", "'local_edge_dot'"), (f"contains({P}[1], '..')", "'local_dots'"), (f"{P}[2] = ''", "'no_domain'"), (f"contains({P}[2], '..')", "'domain_dots'"),
        (f"len({LB}) < 2", "'no_tld'"), (f"len(list_filter({LB}, lambda x: starts_with(x, '-') OR ends_with(x, '-'))) > 0", "'label_edge_hyphen'"), (f"length({LB}[-1]) < 2", "'tld_too_short'"),
        (f"NOT regexp_matches({LB}[-1], '^([a-zA-Z]+|xn--.*)$')", "'tld_invalid'"),
    ], "NULL") + " AS problem",
)
TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
projection("visible_text", PAGES, lambda: {"page_id": F.col("page_id"), "n_chars": F.char_length(T.visible_text(F.col("html"))).cast("long"), "md5": F.md5(T.visible_text(F.col("html")).cast("binary"))}, f"page_id, length({TEXT}) AS n_chars, md5({TEXT}) AS md5")

# ---- scoring
AS_OF = f"TIMESTAMP '{V.AS_OF}'"
TARGET = sql_contains("lower(coalesce(industry, ''))", scoring.TARGET_INDUSTRIES)
FIT = (
    f"CASE WHEN {REASON} IS NOT NULL THEN 0.0 ELSE least(100.0, 25.0 + CASE WHEN {TARGET} THEN 35.0 WHEN coalesce(industry, '') <> '' THEN 15.0 ELSE 0.0 END + "
    f"CASE WHEN ({LO} >= 10 AND {HI} <= 300) OR ({LO} <= 10 AND {HI} BETWEEN 20 AND 250) THEN 30.0 WHEN {HI} < 10 THEN 15.0 WHEN {LO} >= 500 THEN 10.0 WHEN {LO} IS NOT NULL THEN 20.0 "
    f"WHEN contains(lower(coalesce(employees, '')), 'mid') THEN 25.0 ELSE 0.0 END + CASE WHEN {sql_contains('lower(source)', scoring.VERIFIED_SOURCES)} THEN 10.0 ELSE 0.0 END) END"
)
query("company_fit", f"SELECT id, CAST({FIT} AS DOUBLE) AS company_fit FROM {V.sql(V.COMPANIES)} v")(lambda spark, d: scoring.company_fit(V.frame(spark, d, V.COMPANIES)).select("id", "company_fit"))
DAYS = f"CAST(floor((epoch({AS_OF}) - epoch(last_crawled_at)) / 86400) AS BIGINT)"
FACTOR = f"CASE WHEN {DAYS} > 30 THEN 0.7 WHEN {DAYS} > 14 THEN round(greatest(0.7, 1.0 - ({DAYS} - 14) * 0.02), 2) ELSE 1.0 END"
as_of = lambda: F.lit(V.AS_OF).cast("timestamp")
stale = lambda: scoring.staleness(F.col("last_crawled_at"), as_of())
projection("staleness", V.COMPANIES, lambda: {"id": F.col("id"), "factor": stale()["factor"], "recrawl": stale()["recrawl"]}, f"id, CAST({FACTOR} AS DOUBLE) AS factor, coalesce({DAYS} > 30, false) AS recrawl")
WP = r"TRY_CAST(nullif(regexp_extract(coalesce(wp_version, ''), '^([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE)"
WITH_STACK = V.TECH.replace("AS angular_version", "AS angular_version, CASE WHEN c_custkey % 11 = 0 THEN 'React' WHEN c_custkey % 7 < 4 THEN 'jQuery' END AS library")
GAP = (
    f"least(100.0, CASE WHEN contains(lower(coalesce(cms, '')), 'wordpress') OR wp_version IS NOT NULL THEN CASE WHEN {WP} < 6 THEN 30.0 WHEN {WP} IS NOT NULL THEN 15.0 ELSE 20.0 END "
    "WHEN contains(lower(coalesce(cms, '')), 'joomla') THEN 25.0 ELSE 0.0 END + CASE WHEN lower(coalesce(library, '')) = 'jquery' OR jquery_version IS NOT NULL THEN CASE WHEN regexp_matches(coalesce(jquery_version, ''), '^[12]\\.') THEN 25.0 ELSE 15.0 END ELSE 0.0 END "
    "+ CASE WHEN NOT https THEN 25.0 WHEN NOT hsts THEN 10.0 ELSE 0.0 END + CASE WHEN coalesce(library, '') <> 'React' AND (coalesce(cms, '') <> '' OR library IS NOT NULL) THEN 20.0 ELSE 0.0 END)"
)


def tech(spark, d):
    return V.frame(spark, d, WITH_STACK).withColumns({"frontend": F.array_compact(F.array("library")), "backend": F.array().cast("array<string>")})


query("technology_gap", f"SELECT company_id, CAST({GAP} AS DOUBLE) AS technology_gap FROM {V.sql(WITH_STACK)} v")(lambda spark, d: tech(spark, d).select("company_id", scoring.technology_gap().alias("technology_gap")))
JQ_MAJOR = "TRY_CAST(nullif(regexp_extract(coalesce(jquery_version, ''), '^([0-9]+)', 1), '') AS INT)"
LEGACY, OLD_WP = f"(jquery_version = '' OR coalesce({JQ_MAJOR} < 3, false))", f"coalesce({WP} < 6, false)"
PAIN_RULES = [
    ("jquery_version IS NOT NULL", "'legacy_jquery'", f"CASE WHEN {LEGACY} THEN 'high' ELSE 'medium' END", f"CASE WHEN {LEGACY} THEN 0.95 ELSE 0.85 END"),
    ("angular_version IS NOT NULL", "'legacy_angularjs_eol'", "'critical'", "0.95"),
    ("lower(coalesce(cms, '')) = 'wordpress' OR wp_version IS NOT NULL", f"CASE WHEN {OLD_WP} THEN 'outdated_wordpress' ELSE 'wordpress_maintenance_debt' END", f"CASE WHEN {OLD_WP} THEN 'high' ELSE 'medium' END", f"CASE WHEN {OLD_WP} THEN 0.95 ELSE 0.85 END"),
    ("NOT https", "'insecure_transport_http'", "'critical'", "1.0"),
    ("speed_discrepancy", "'subpage_speed_discrepancy'", "'high'", "0.95"),
    ("NOT speed_discrepancy AND homepage_ms > 3000", "'slow_website_speed'", "'high'", "0.9"),
    ("ttfb_ms > 1200", "'slow_backend_ttfb'", "'medium'", "0.85"),
    ("missing_tel_link", "'missing_mobile_tel_link'", "'high'", "0.95"),
    ("max_form_inputs >= 7", "'high_form_friction'", "'medium'", "0.85"),
    ("NOT has_schema", "'missing_local_schema'", "'medium'", "0.9"),
    ("broken_social", "'broken_social_opengraph'", "'low'", "0.85"),
    ("deliverability_risk", "'dns_email_deliverability_risk'", "'high'", "0.95"),
    ("exposed_users", "'exposed_cms_security_risk'", "'critical'", "1.0"),
    ("company_id % 14 = 5", "'hiring_capacity_bottleneck'", "'high'", "0.9"),
    ("cert_days < 30", "'ssl_cert_expiring_soon'", "CASE WHEN cert_days < 14 THEN 'critical' ELSE 'high' END", "1.0"),
    ("coalesce(cert_days, 99) >= 30 AND cert_checked AND NOT cert_valid", "'ssl_cert_invalid'", "'critical'", "0.95"),
    ("broken_links > 0", "'broken_internal_links'", "CASE WHEN broken_links >= 3 THEN 'high' ELSE 'medium' END", "1.0"),
    ("image_issues", "'unoptimized_images'", "'medium'", "0.9"),
    ("lighthouse_score < 70", "'poor_lighthouse_score'", "CASE WHEN lighthouse_score < 50 THEN 'high' ELSE 'medium' END", "1.0"),
]
PAINS = "(" + " UNION ALL ".join(f"SELECT company_id, {i} AS rule, {k} AS type, {s} AS severity, CAST({c} AS DOUBLE) AS confidence FROM {V.sql(V.TECH)} v WHERE {w}" for i, (w, k, s, c) in enumerate(PAIN_RULES)) + ")"
pains = lambda spark, d: scoring.detect_pains(V.frame(spark, d, V.TECH).withColumn("skills", F.array_compact(F.array("skill"))))
query("detect_pains", f"SELECT company_id, type, severity, confidence FROM {PAINS} p")(lambda spark, d: pains(spark, d).select("company_id", "type", "severity", "confidence"))
POINTS = "sum(CASE severity WHEN 'critical' THEN 35.0 WHEN 'high' THEN 30.0 WHEN 'medium' THEN 20.0 ELSE 10.0 END * confidence)"
PAIN_SCORE = f"SELECT company_id, CAST(round(least(100.0, round({POINTS}, 6)), 2) AS DOUBLE) AS pain_signal FROM {PAINS} p GROUP BY company_id"
query("pain_signal", PAIN_SCORE)(lambda spark, d: scoring.pain_signal(pains(spark, d)))
CAT = lambda i, default: sql_case([(f"pain = '{k}'", f"'{v[i]}'" if i == 0 else str(v[i])) for k, v in scoring.CATALOG.items()], default)
M = scoring.MASTER
OPPS = (
    f"SELECT company_id, n_pains, CASE WHEN n_pains >= 2 THEN '{M[0]}' ELSE {CAT(0, f"'{M[0]}'")} END AS type, CAST(CASE WHEN n_pains >= 2 THEN {M[1]} ELSE {CAT(1, str(M[1]))} END AS INT) AS estimated_value_low, "
    f"CAST(CASE WHEN n_pains >= 2 THEN {M[2]} ELSE {CAT(2, str(M[2]))} END AS INT) AS estimated_value_high, CAST(CASE WHEN n_pains >= 2 THEN 0.95 ELSE first_confidence END AS DOUBLE) AS confidence "
    f"FROM (SELECT company_id, count(*) AS n_pains, arg_min(type, rule) AS pain, arg_min(confidence, rule) AS first_confidence FROM {PAINS} p GROUP BY company_id) x"
)
DEEP = "(SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)"
PILLAR = lambda words: "CASE WHEN many THEN array_to_string(list_sort(list_filter(types, lambda t: " + " OR ".join(f"contains(t, '{w}')" for w in words) + ")), ',') END"
SINGLE = lambda col, master, **pains: f"CASE WHEN many THEN {master} ELSE CASE pain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pains.items()) + f" ELSE {master} END END AS {col}"
query(
    "detect_opportunities",
    "SELECT company_id, n_pains, "
    + ", ".join([
        SINGLE("type", "'turnkey_modernization_overhaul'", subpage_speed_discrepancy="'performance_optimization'", missing_mobile_tel_link="'conversion_rate_optimization'", dns_email_deliverability_risk="'infrastructure_security'", legacy_jquery="'frontend_modernization'", legacy_angularjs_eol="'frontend_modernization'", outdated_wordpress="'cms_to_laravel_migration'", hiring_capacity_bottleneck="'staff_augmentation'"),
        SINGLE("estimated_value_low", "25000", subpage_speed_discrepancy=8000, missing_mobile_tel_link=5000, dns_email_deliverability_risk=3000, legacy_jquery=15000, legacy_angularjs_eol=20000, outdated_wordpress=20000, hiring_capacity_bottleneck=30000),
        SINGLE("estimated_value_high", "50000", subpage_speed_discrepancy=20000, missing_mobile_tel_link=15000, dns_email_deliverability_risk=8000, legacy_jquery=40000, legacy_angularjs_eol=45000, outdated_wordpress=60000, hiring_capacity_bottleneck=80000),
        SINGLE("quote_low", "2500", subpage_speed_discrepancy=1500, missing_mobile_tel_link=1000, dns_email_deliverability_risk=500, legacy_jquery=3500, legacy_angularjs_eol=4500, outdated_wordpress=5000, hiring_capacity_bottleneck=3500),
        SINGLE("pilot_high", "1800", subpage_speed_discrepancy=1500, missing_mobile_tel_link=1000, dns_email_deliverability_risk=600, legacy_jquery=2500, legacy_angularjs_eol=3000, outdated_wordpress=3000, hiring_capacity_bottleneck=3500),
    ])
    + f", CAST(CASE WHEN many THEN 0.95 ELSE first_confidence END AS DOUBLE) AS confidence, {PILLAR(['speed', 'ttfb', 'performance'])} AS speed_pillar, {PILLAR(['tel', 'form', 'booking'])} AS conversion_pillar, "
    f"{PILLAR(['schema', 'dns', 'social', 'security', 'http'])} AS seo_dns_pillar, {PILLAR(['jquery', 'wordpress', 'angular', 'hiring'])} AS tech_stack_pillar "
    f"FROM (SELECT company_id, count(*) AS n_pains, count(*) >= 2 OR company_id IN {DEEP} AS many, arg_min(type, rule) AS pain, arg_min(confidence, rule) AS first_confidence, list(type) AS types FROM {PAINS} p GROUP BY company_id) x",
)(lambda spark, d: offers(spark, d))


def offers(spark, d):
    audited = spark.read.parquet(f"{d}/events.parquet").where("user_id % 3 = 0").select(F.col("user_id").alias("company_id"))
    found = scoring.detect_opportunities(pains(spark, d), audited)
    names = ["company_id", "n_pains", "type", "estimated_value_low", "estimated_value_high", "quote_low", "pilot_high", "confidence"]
    return found.select(*names, *(F.array_join(f"{k}_pillar", ",").alias(f"{k}_pillar") for k in scoring.PILLARS))


TYPED = f"round(sum(CASE type WHEN 'client_past_spend_verified' THEN 45.0 * greatest(0.6, {CONF}) WHEN 'directory_client_review' THEN 40.0 * greatest(0.6, {CONF}) " + " ".join(f"WHEN '{k}' THEN {v} * {CONF}" for k, v in scoring.SIGNALS.items()) + " ELSE 0.0 END), 6)"
BUYING = f"SELECT company_id, CAST(round(least(100.0, 25.0 + {TYPED}), 2) AS DOUBLE) AS buying_signal FROM {V.sql(V.SIGNALS)} v GROUP BY company_id"
signals = lambda spark, d: V.frame(spark, d, V.SIGNALS).withColumn("skills", F.lit(None).cast("array<string>"))
query("buying_signal", BUYING)(lambda spark, d: scoring.buying_signal(signals(spark, d)))
query("priority_tier", f"SELECT id, {sql_case([('opportunity_score >= 90', "'immediate'"), ('opportunity_score >= 75', "'high'"), ('opportunity_score >= 60', "'nurture'"), ('opportunity_score >= 40', "'low'")], "'ignore'")} AS tier FROM {V.sql(V.SCORES)} v")(
    lambda spark, d: V.frame(spark, d, V.SCORES).select("id", scoring.priority_tier(F.col("opportunity_score"), F.lit(False)).alias("tier"))
)
ROWS = (
    f"SELECT c.id AS company_id, CAST({FIT} AS DOUBLE) AS company_fit, coalesce(technology_gap, 0.0) AS technology_gap, coalesce(pain_signal, 0.0) AS pain_signal, coalesce(buying_signal, 20.0) AS buying_signal, "
    "50.0 + CASE WHEN coalesce(website_url, '') <> '' THEN 25.0 ELSE 0.0 END + CASE WHEN contains(domain, '.') THEN 25.0 ELSE 0.0 END AS contact_quality, "
    f"CASE WHEN o.type IS NULL THEN 20.0 WHEN o.type IN ({quoted(scoring.HIGH_VALUE)}) THEN 65.0 ELSE 55.0 END AS service_fit, coalesce(o.estimated_value_low, 0) AS low, coalesce(o.estimated_value_high, 0) AS high, "
    f"CAST(round(0.35 + CASE WHEN has_stack THEN 0.15 ELSE 0.0 END + CASE WHEN has_audit THEN 0.35 ELSE 0.0 END + CASE WHEN b.company_id IS NOT NULL THEN 0.15 ELSE 0.0 END, 2) AS DOUBLE) AS data_completeness, "
    f"CAST({FACTOR} AS DOUBLE) AS factor, coalesce({DAYS} > 30, false) AS recrawl, coalesce(website_url, '') = '' OR ends_with(domain, '.local') AS no_website "
    f"FROM {V.sql(V.COMPANIES)} c LEFT JOIN (SELECT company_id, CAST({GAP} AS DOUBLE) AS technology_gap, library IS NOT NULL AS has_stack, ttfb_ms > 0 AS has_audit FROM {V.sql(WITH_STACK)} v) t ON t.company_id = c.id "
    f"LEFT JOIN ({PAIN_SCORE}) p ON p.company_id = c.id LEFT JOIN ({BUYING}) b ON b.company_id = c.id LEFT JOIN ({OPPS}) o ON o.company_id = c.id"
)
SCORED = (
    "SELECT *, CASE WHEN no_website THEN 100.0 ELSE round(CAST(round(least(100.0, greatest(0.0, CASE WHEN company_fit >= 70 AND pain_signal >= 35 THEN greatest(45.0, raw) ELSE raw END * factor)), 6) AS DECIMAL(18, 6)), 2) END AS score, "
    "recrawl OR (data_completeness < 0.35 AND company_fit >= 70) AS needs FROM (SELECT *, least(100.0, CAST(round(CAST(round(company_fit * 0.25 + pain_signal * 0.30 + technology_gap * 0.20 + contact_quality * 0.15 + service_fit * 0.10 "
    f"+ CASE WHEN buying_signal > 25 THEN least(20.0, round((buying_signal - 25.0) / 3.75, 2)) ELSE 0.0 END, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)) AS raw FROM ({ROWS}) r) s"
)
query(
    "score_companies",
    "SELECT company_id, company_fit, technology_gap, pain_signal, buying_signal, CAST(contact_quality AS DOUBLE) AS contact_quality, CAST(service_fit AS DOUBLE) AS service_fit, data_completeness, needs AS needs_recrawl, CAST(score AS DOUBLE) AS opportunity_score, "
    "CASE WHEN no_website THEN 'immediate' WHEN needs AND score >= 75 THEN 'recrawl_review' WHEN score >= 90 THEN 'immediate' WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'nurture' WHEN score >= 40 THEN 'low' ELSE 'ignore' END AS priority_tier, "
    f"CAST(CASE WHEN no_website AND high = 0 THEN 2500 ELSE low END AS BIGINT) AS deal_low, CAST(CASE WHEN no_website AND high = 0 THEN 5000 ELSE high END AS BIGINT) AS deal_high FROM ({SCORED}) z",
)(lambda spark, d: scored(spark, d))


def scored(spark, d):
    t, p = tech(spark, d), pains(spark, d)
    audits = t.select("company_id", "ttfb_ms", F.lit(None).cast("int").alias("performance_score"))
    return scoring.score_companies(V.frame(spark, d, V.COMPANIES), t, audits, signals(spark, d), p, scoring.detect_opportunities(p), as_of())


query("prune_low_scores", f"SELECT id, company_id, opportunity_score, CASE WHEN company_id IN (SELECT company_id FROM {V.sql(V.SCORES)} w WHERE opportunity_score < 40 AND priority_tier NOT IN ('ignore', 'disqualified')) THEN 'ignore' ELSE priority_tier END AS priority_tier FROM {V.sql(V.SCORES)} v")(
    lambda spark, d: scoring.prune_low_scores(V.frame(spark, d, V.SCORES)).select("id", "company_id", "opportunity_score", "priority_tier")
)

# ---- joins, de-duplication, worklists
query("latest_per_company", f"SELECT company_id, id, opportunity_score FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id DESC) AS n FROM {V.sql(V.SCORES)} v) w WHERE n = 1")(
    lambda spark, d: relational.latest_by(V.frame(spark, d, V.SCORES).select("company_id", "id", "opportunity_score"), "company_id", "id")
)
USABLE = "email_status IN ('valid', 'catch_all', 'unverified')"
query("primary_contact", f"SELECT company_id, id, email FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id) AS n FROM {V.sql(V.CONTACTS)} v WHERE {USABLE}) w WHERE n = 1")(
    lambda spark, d: relational.first_by(V.frame(spark, d, V.CONTACTS).where(USABLE).select("company_id", "id", "email"), "company_id", "id")
)
query("dedupe_companies", f"SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM {V.sql(V.COMPANIES)} v) w WHERE n = 1")(
    lambda spark, d: relational.keep_first(V.frame(spark, d, V.COMPANIES), [F.col("domain")], "id").select("id", "domain")
)
query("dedupe_emails", f"SELECT id, email FROM (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY id) AS n FROM {V.sql(V.CONTACTS)} v) w WHERE n = 1 OR email = ''")(
    lambda spark, d: relational.keep_first(V.frame(spark, d, V.CONTACTS), [F.lower("email")], "id", F.col("email") == "").select("id", "email")
)
NEW = V.COMPANIES.replace("FROM {customer}", "FROM {customer} WHERE c_custkey % 2 = 1")

query("scoring_worklist", f"SELECT id FROM {V.sql(V.COMPANIES)} c LEFT JOIN (SELECT company_id, max(scored_at) AS scored FROM {V.sql(V.SCORES)} s GROUP BY company_id) t ON t.company_id = c.id WHERE (last_crawled_at IS NOT NULL OR website_url IS NULL) AND NOT coalesce(scored >= coalesce(last_crawled_at, scored) AND scored >= TIMESTAMP '2001-06-01 00:00:00', false)")(
    lambda spark, d: worklists.scoring_worklist(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, V.SCORES), F.lit("2001-06-08").cast("timestamp")).select("id")
)
query("enrichment_worklist", f"SELECT c.id, max(s.opportunity_score) AS score, bool_or(website_url IS NULL OR ends_with(domain, '.local')) AS no_website FROM {V.sql(V.COMPANIES)} c JOIN {V.sql(V.SCORES)} s ON s.company_id = c.id WHERE s.opportunity_score >= 40 AND c.id NOT IN (SELECT company_id FROM {V.sql(V.CONTACTS)} k) GROUP BY c.id")(
    lambda spark, d: worklists.enrichment_worklist(V.frame(spark, d, V.COMPANIES), V.frame(spark, d, V.SCORES), V.frame(spark, d, V.CONTACTS), limit=None)
)
query("has_existing_outreach", f"SELECT id FROM {V.sql(V.CONTACTS)} c WHERE company_id IN (SELECT user_id FROM events WHERE event_id % 50 = 0) OR id IN (SELECT user_id FROM events WHERE event_id % 70 = 1)")(
    lambda spark, d: relational.semi_any(V.frame(spark, d, V.CONTACTS), "id", [(spark.read.parquet(f"{d}/events.parquet").where("event_id % 50 = 0"), "company_id", "user_id"), (spark.read.parquet(f"{d}/events.parquet").where("event_id % 70 = 1"), "id", "user_id")]).select("id")
)
query("suppress", f"SELECT id, email FROM {V.sql(V.BOUNCES)} b WHERE email NOT IN (SELECT email FROM {V.sql(V.BOUNCES)} x WHERE dsn = '5.1.1' AND id % 700 = 0)")(
    lambda spark, d: relational.anti_any(V.frame(spark, d, V.BOUNCES), [(V.frame(spark, d, V.BOUNCES).where("dsn = '5.1.1' and id % 700 = 0"), "email", "email")]).select("id", "email")
)
query("warm_seen_keys", f"SELECT DISTINCT {HOST.format('domain')} AS key, 'domain' AS kind FROM {V.sql(V.COMPANIES)} v UNION SELECT DISTINCT {NAME}, 'name' FROM {V.sql(V.COMPANIES)} v")(
    lambda spark, d: V.frame(spark, d, V.COMPANIES).select(T.normalize_domain(F.col("domain")).alias("key"), F.lit("domain").alias("kind")).unionByName(V.frame(spark, d, V.COMPANIES).select(T.normalize_company_name(F.col("name")).alias("key"), F.lit("name").alias("kind"))).distinct()
)

# ---- feeds
BTEXT = "lower(coalesce(body, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(sender, ''))"
BTYPE = sql_case([(sql_contains(BTEXT, feeds.COMPLAINTS), "'complaint'"), ("regexp_matches(coalesce(dsn, ''), '^5\\.[0-9]+\\.[0-9]+')", "'hard_bounce'"), ("regexp_matches(coalesce(dsn, ''), '^4\\.[0-9]+\\.[0-9]+')", "'soft_bounce'"), (sql_contains(BTEXT, feeds.HARD), "'hard_bounce'")], "'soft_bounce'")
NOTICE = f"({sql_contains('lower(subject)', feeds.NOTICE_SUBJECT + feeds.COMPLAINTS)} OR {sql_contains('lower(sender)', feeds.NOTICE_SENDER + feeds.COMPLAINTS)})"


def bounces(spark, d):
    rows = V.frame(spark, d, V.BOUNCES).where(feeds.is_bounce_notice(F.col("subject"), F.col("sender")))
    return rows.withColumn("bounce_type", feeds.classify_bounce(*(F.col(c) for c in ("dsn", "body", "subject", "sender"))))


query("classify_bounce", f"SELECT id, {BTYPE} AS bounce_type FROM {V.sql(V.BOUNCES)} v WHERE {NOTICE}")(lambda spark, d: bounces(spark, d).select("id", "bounce_type"))
query("soft_bounce_promotion", f"SELECT email, count(*) AS n_soft FROM {V.sql(V.BOUNCES)} v WHERE {NOTICE} AND {BTYPE} = 'soft_bounce' GROUP BY email HAVING count(*) >= 3")(lambda spark, d: feeds.soft_bounce_promotion(bounces(spark, d)))


def sql_spaced(rows: str, keys: str, ts: str, seconds: int) -> str:
    """Rows that start a new span: the first of each key, then each time the first that is ``seconds`` or more after the last kept one."""
    span = f"to_microseconds({seconds * 1_000_000 - 1})"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ts}, id) AS n, rank() OVER (PARTITION BY {keys} ORDER BY {ts}) + count(*) OVER (PARTITION BY {keys} ORDER BY {ts} RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING) AS follower FROM {rows} r"
    return f"WITH RECURSIVE numbered AS MATERIALIZED ({numbered}), spaced AS (SELECT * FROM numbered WHERE n = 1 UNION ALL SELECT x.* FROM spaced k JOIN numbered x USING ({keys}) WHERE x.n = k.follower) SELECT * EXCLUDE (n, follower) FROM spaced"


query("bounce_dedup", sql_spaced(f"(SELECT id, email, {BTYPE} AS bounce_type, ts FROM {V.sql(V.BOUNCES)} v WHERE {NOTICE})", "email, bounce_type", "ts", 86400))(lambda spark, d: feeds.bounce_dedup(bounces(spark, d).select("id", "email", "bounce_type", "ts")))
RTEXT = "lower(coalesce(subject, '') || chr(10) || coalesce(body, ''))"
INTENT = lambda i: [(f"regexp_matches({RTEXT}, '{'|'.join(p).replace(chr(39), chr(39) * 2)}')", f"'{n}'" if i == 0 else str(c)) for n, c, p in feeds.INTENTS] + [(f"regexp_matches({RTEXT}, '{feeds.SHORT_YES}')", "'positive_interest'" if i == 0 else "0.8")]
SINGLE = lambda p: p.replace("'", "''")
MATCHED = [(f"regexp_matches({RTEXT}, '{SINGLE(p)}')", f"regexp_extract({RTEXT}, '{SINGLE(p)}', 0)") for _, _, ps in feeds.INTENTS for p in ps] + [(f"regexp_matches({RTEXT}, '{feeds.SHORT_YES}')", "'short_affirmative_word'")]
query("classify_reply", f"SELECT id, {sql_case(INTENT(0), "'unknown'")} AS intent, CAST({sql_case(INTENT(1), '0.5')} AS DOUBLE) AS confidence, {sql_case(MATCHED, 'NULL')} AS matched FROM {V.sql(V.REPLIES)} v")(
    lambda spark, d: V.frame(spark, d, V.REPLIES).select("id", feeds.classify_reply(F.col("subject"), F.col("body")).alias("r")).select("id", "r.intent", F.col("r.confidence").cast("double").alias("confidence"), "r.matched")
)
RETRY = f"SELECT company_id, domain, CAST(retry_count + 1 AS INT) AS attempt, retry_count + 1 > 4 AS dead_letter, CASE WHEN retry_count + 1 <= 4 THEN ts + to_minutes(CAST(pow(2, retry_count + 1) * 30 AS BIGINT)) END AS next_retry_at FROM {V.sql(V.FAILURES)} v WHERE ({EXCLUDED}) = '' AND {RETRYABLE}"
query("retry_schedule", RETRY)(lambda spark, d: feeds.retry_schedule(V.frame(spark, d, V.FAILURES)))
query("retry_counts", f"SELECT count(*) FILTER (NOT dead_letter) AS pending, count(*) FILTER (NOT dead_letter AND next_retry_at <= TIMESTAMP '2024-01-15 00:00:00') AS due, count(*) FILTER (dead_letter) AS dead, (SELECT coalesce(array_to_string(list(company_id ORDER BY company_id), ','), '') FROM (SELECT company_id FROM ({RETRY}) r2 WHERE dead_letter ORDER BY company_id LIMIT 10) f) AS first_dead FROM ({RETRY}) r")(
    lambda spark, d: worklists.retry_counts(feeds.retry_schedule(V.frame(spark, d, V.FAILURES)), F.lit("2024-01-15").cast("timestamp")).withColumn("first_dead", F.array_join("first_dead", ","))
)
query("due_retries", f"SELECT * FROM ({RETRY}) r WHERE NOT dead_letter AND next_retry_at <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY next_retry_at, company_id LIMIT 20")(
    lambda spark, d: feeds.due_retries(feeds.retry_schedule(V.frame(spark, d, V.FAILURES)), F.lit("2024-01-15").cast("timestamp"))
)
WIN = "(PARTITION BY stage_name ORDER BY CAST(floor(epoch(started_at)) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)"
ANOMALY = f"SELECT id, stage_name, started_at, baseline, avg_duration, n_before, coalesce(n_before >= 3 AND baseline > 5 AND items_processed < baseline * 0.5 AND stage_name NOT IN ({quoted(feeds.QUIET_STAGES)}), false) AS anomaly FROM (SELECT *, round(avg(items_processed) OVER {WIN}, 4) AS baseline, round(avg(duration_seconds) OVER {WIN}, 4) AS avg_duration, count(*) OVER {WIN} AS n_before FROM {V.sql(V.RUNS)} v WHERE status IN ('success', 'partial')) w"
anomalies = lambda spark, d: feeds.stage_anomalies(V.frame(spark, d, V.RUNS)).select("id", "stage_name", "started_at", "baseline", "n_before", "anomaly")
query("stage_anomalies", f"SELECT * EXCLUDE (avg_duration) FROM ({ANOMALY}) a")(anomalies)
query("alert_cooldown", sql_spaced(f"(SELECT id, stage_name, started_at FROM ({ANOMALY}) a WHERE anomaly)", "stage_name", "started_at", 4 * 3600))(lambda spark, d: feeds.alert_cooldown(anomalies(spark, d).where("anomaly").select("id", "stage_name", "started_at")))
query("recent_runs", f"SELECT id, stage_name, status FROM {V.sql(V.RUNS)} v ORDER BY id DESC LIMIT 25")(lambda spark, d: V.frame(spark, d, V.RUNS).orderBy(F.desc("id")).limit(25).select("id", "stage_name", "status"))
query("run_summary", f"SELECT stage_name, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed FROM {V.sql(V.RUNS)} v GROUP BY stage_name")(
    lambda spark, d: V.frame(spark, d, V.RUNS).groupBy("stage_name").pivot("status", ["success", "partial", "failed"]).count().fillna(0)
)
query("daily_send_count", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_sent FROM events GROUP BY 1")(lambda spark, d: feeds.daily_send_count(spark.read.parquet(f"{d}/events.parquet").select("ts")).withColumn("day", F.col("day").cast("string")))
query("calibration_report", "SELECT source, count(*) AS total_outreaches, round(avg(opportunity_score), 4) AS avg_opp_score, CAST(count(*) FILTER (opened) AS BIGINT) AS total_opened, CAST(count(*) FILTER (replied) AS BIGINT) AS total_replied, CAST(count(*) FILTER (closed_won) AS BIGINT) AS total_closed, round(count(*) FILTER (replied) / count(*) * 100, 2) AS reply_rate_pct, round(count(*) FILTER (closed_won) / count(*) * 100, 2) AS close_rate_pct, " f"round(coalesce(sum(revenue), 0.0), 2) AS total_revenue_won FROM {V.sql(V.OUTCOMES)} v GROUP BY source")(
    lambda spark, d: feeds.calibration_report(V.frame(spark, d, V.OUTCOMES))
)
DIMENSIONS = ["opportunity_score", "company_fit", "technology_gap", "pain_signal", "buying_signal", "contact_quality", "service_fit"]
DRIFT = (
    "SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 40 = 0 THEN 'high' ELSE 'low' END AS priority_tier, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DOUBLE) / 250 END AS opportunity_score, "
    + ", ".join(f"50 + CAST(o_orderkey % {4 + i} AS DOUBLE) / {300 + 100 * i} AS {c}" for i, c in enumerate(DIMENSIONS[1:])) + " FROM {orders}"
)
MOVED = " OR ".join(["x.priority_tier <> k.priority_tier", *(f"coalesce(abs(x.{c} - k.{c}) >= 0.01, false)" for c in DIMENSIONS)])
query(
    "score_changes",
    f"WITH RECURSIVE rows AS MATERIALIZED {V.sql(DRIFT)}, changed AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id) = 1 UNION ALL "
    f"SELECT x.* FROM changed k JOIN rows x ON x.company_id = k.company_id AND x.id > k.id WHERE {MOVED} QUALIFY row_number() OVER (PARTITION BY x.company_id ORDER BY x.id) = 1) SELECT id, company_id, priority_tier FROM changed",
)(lambda spark, d: relational.changed_rows(V.frame(spark, d, DRIFT), "company_id", "id", DIMENSIONS, "priority_tier").select("id", "company_id", "priority_tier"))
query("warmup_cap", f"SELECT id, opportunity_score FROM {V.sql(V.SCORES)} v ORDER BY opportunity_score DESC, id LIMIT 38")(lambda spark, d: feeds.warmup_cap(V.frame(spark, d, V.SCORES).select("id", "opportunity_score"), 50, 12, [F.desc("opportunity_score"), F.col("id")]))
