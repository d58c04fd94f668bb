"""Queries of site audits and of fields drawn from text; importing this module adds them to the catalog.

The SQL states what each made-up fragment must give, by the number that chose it, and shares no constant with the code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import extract
from prospectra.operators import leads, site_audit
from prospectra.plans import catalog as C
from prospectra.plans import views as V
from prospectra.plans.catalog import projection, query

#: Three pages a site, with markup and headers chosen by their numbers.
SITE = """
SELECT page_id, site, 'site' || CAST(site AS STRING) || '.com' AS domain, CASE page_id % 3 WHEN 0 THEN '/' ELSE '/p' || CAST(page_id AS STRING) END AS path,
  CASE WHEN site % 4 = 0 THEN 'http://' ELSE 'https://' END || 'site' || CAST(site AS STRING) || '.com' || CASE page_id % 3 WHEN 0 THEN '/' ELSE '/p' || CAST(page_id AS STRING) END AS url,
  CASE WHEN site % 7 = 0 THEN 503 WHEN site % 11 = 0 THEN 0 ELSE 200 END AS http_status, (page_id * 37) % 6000 AS duration_ms, (page_id * 53) % 2500 AS ttfb_ms,
  CASE site % 5 WHEN 0 THEN 'PHP/8.1' WHEN 1 THEN 'ASP.NET' WHEN 2 THEN 'Express' ELSE '' END AS powered, CASE site % 3 WHEN 0 THEN 'laravel_session=abc' ELSE '' END AS cookie,
  CASE site % 2 WHEN 0 THEN 'gzip' ELSE '' END AS encoding, site % 3 = 1 AS hsts_sent,
  html || CASE page_id % 5 WHEN 0 THEN '<meta name="generator" content="WordPress 5.' || CAST(page_id % 9 AS STRING) || '">' WHEN 1 THEN '<link rel="stylesheet" href="/wp-content/x.css">'
      WHEN 2 THEN '<script src="https://cdn.shopify.com/a.js"></script>' WHEN 3 THEN '<div data-wf-page="1"></div>' ELSE '' END
    || CASE page_id % 7 WHEN 0 THEN '<script src="/js/jquery-1.12.4.min.js"></script>' WHEN 1 THEN '<script src="https://cdn.net/angular.js/1.8.2/angular.min.js"></script>' WHEN 2 THEN '<link rel=stylesheet href="/css/bootstrap-4.6.0.min.css">'
      WHEN 3 THEN '<script src="/vue@2.6.14/dist/vue.js"></script>' WHEN 4 THEN '<script src="/_next/static/main.js"></script>' WHEN 5 THEN '<div data-reactroot></div>' ELSE '' END
    || CASE page_id % 4 WHEN 0 THEN '<form><input type="hidden" name=h><input name=a autocomplete="on"><input name=b><input name=c><select name=d></select><textarea></textarea><input name=e><input name=f></form>'
      WHEN 1 THEN '<img src="a.png"><img src="b.JPG?x=1" alt="b"><img loading="lazy" src="c.webp" alt=""><img data-src="d.gif"><img src="e.jpeg"><img src="f.bmp">' WHEN 2 THEN '<p>Call 305-555-1234 now</p>'
      ELSE '<a class="x" href="tel:123">Call</a><iframe src="https://Calendly.com/x"></iframe><div class="a sticky-cta"></div>' END
    || CASE page_id % 6 WHEN 0 THEN '<script type="application/ld+json">{{"@type": "Dentist"}}</script>' WHEN 1 THEN '<meta property="og:image" content="i"><meta name="og:title" content="t"><meta name="description" content="d">'
      WHEN 2 THEN '<meta property="og:image" content="i">' WHEN 3 THEN '<p>Founded in 1999 with 500+ clients, award winning</p><img src="http://x.com/q.svg" alt="q" loading="lazy">' ELSE '' END AS html
FROM (SELECT *, CAST(floor(page_id / 3) AS BIGINT) AS site FROM {pages}) p
"""
S = V.sql(SITE) + " v"
#: A number of ten digits in the text that is left of a page.
PHONE = f"regexp_matches({C.TEXT}, '[(]?[0-9]{{3}}[)]?[-.\\s]?[0-9]{{3}}[-.\\s]?[0-9]{{4}}')"


def site(spark, d):
    """The view with its headers as a map whose names are written in several ways."""
    names = {"X-Powered-By": "powered", "set-cookie": "cookie", "Content-Encoding": "encoding"}
    sent = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.col(v))))
    hsts = F.when(F.col("hsts_sent"), F.create_map(F.lit("Strict-Transport-Security"), F.lit("max-age=1"), F.lit("X-Frame-Options"), F.lit("DENY"))).otherwise(F.create_map().cast("map<string,string>"))
    return V.frame(spark, d, SITE).withColumn("headers", F.map_concat(sent, hsts)).drop("powered", "cookie", "encoding", "hsts_sent")


BACK = "list_filter([CASE WHEN site % 5 = 1 THEN 'ASP.NET' END, CASE WHEN site % 3 = 0 THEN 'Laravel' END, CASE WHEN site % 5 = 2 THEN 'Node.js/Express' END, CASE WHEN site % 5 = 0 OR site % 3 = 0{0} THEN 'PHP' END{1}], lambda x: x IS NOT NULL)"
query("fingerprint_backend", f"SELECT page_id, array_to_string({BACK.format('', '')}, ',') AS backend FROM {S}")(
    lambda spark, d: site(spark, d).select("page_id", F.array_join(site_audit.fingerprint_backend(F.col("headers")), ",").alias("backend"))
)
LIBS = {"jquery": (0, "1.12.4", "/js/jquery-1.12.4.min.js"), "angularjs": (1, "1.8.2", "https://cdn.net/angular.js/1.8.2/angular.min.js"), "bootstrap": (2, "4.6.0", "/css/bootstrap-4.6.0.min.css"), "vue": (3, "2.6.14", "/vue@2.6.14/dist/vue.js")}
query(
    "fingerprint_libraries",
    f"SELECT page_id, {', '.join(f'''CASE WHEN page_id % 7 = {n} THEN '{v}' END AS {k}_version, CASE WHEN page_id % 7 = {n} THEN '{s}' END AS {k}_src''' for k, (n, v, s) in LIBS.items())}, CASE WHEN page_id % 7 = 5 THEN 'data-reactroot' END AS react_src FROM {S}",
)(lambda spark, d: site(spark, d).withColumns(site_audit.fingerprint_libraries(F.col("html"))).select("page_id", *(F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in LIBS for x in ("version", "src")), F.col("react.src").alias("react_src")))
WP_ = "page_id % 5 IN (0, 1)"
query(
    "site_fingerprint",
    f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'WordPress 5.' || CAST(page_id % 9 AS STRING) WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Shopify' WHEN 3 THEN 'Webflow' END AS cms, "
    "array_to_string(list_sort(list_filter([CASE page_id % 5 WHEN 2 THEN 'Shopify' WHEN 3 THEN 'Webflow' END, CASE page_id % 7 WHEN 0 THEN 'jQuery 1.12.4' WHEN 1 THEN 'AngularJS 1.8.2' WHEN 2 THEN 'Bootstrap 4.6.0' WHEN 3 THEN 'Vue 2.6.14' WHEN 4 THEN 'Next.js' WHEN 5 THEN 'React' END, CASE WHEN page_id % 7 = 4 THEN 'React' END], lambda x: x IS NOT NULL)), ',') AS frontend, "
    f"array_to_string({BACK.format(f' OR {WP_}', ', CASE WHEN page_id % 5 = 2 THEN ' + chr(39) + 'Shopify' + chr(39) + f' END, CASE WHEN {WP_} THEN ' + chr(39) + 'WordPress' + chr(39) + ' END')}, ',') AS backend, site % 4 <> 0 AS https, hsts_sent AS hsts FROM {S}",
)(lambda spark, d: site_audit.site_fingerprint(site(spark, d)).select("page_id", "cms", F.array_join("frontend", ",").alias("frontend"), F.array_join("backend", ",").alias("backend"), "https", "hsts"))
query(
    "company_signals",
    " UNION ALL ".join(f"SELECT url, 'company_signal_{k}' AS type, '{s}' AS sample, CAST(0.8 AS DOUBLE) AS confidence FROM {S} WHERE page_id % 6 = 3" for k, s in (("client_scale", "500+ clients"), ("company_age", "Founded in 1999"), ("industry_award", "award winning"))),
)(lambda spark, d: site_audit.company_signals(site(spark, d)).select("url", "type", "sample", "confidence"))
LAG = "max(duration_ms) - max(CASE WHEN path = '/' THEN duration_ms END) > 1500 AND max(duration_ms) > 3000"
query(
    "speed_metrics",
    f"SELECT domain, max(CASE WHEN path = '/' THEN duration_ms END) AS homepage_ms, max(CASE WHEN path = '/' THEN ttfb_ms END) AS ttfb_ms, arg_max(path, duration_ms) AS slowest_path, max(duration_ms) AS slowest_ms, bool_or(ttfb_ms > 1200) AS slow_backend, {LAG} AS speed_discrepancy, "
    f"CAST(sum(CASE WHEN page_id % 4 = 1 THEN 6 ELSE 0 END + CASE WHEN page_id % 6 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_images, bool_or(path = '/' AND encoding = 'gzip') AS compressed FROM {S} GROUP BY domain",
)(lambda spark, d: site_audit.speed_metrics(site(spark, d)).drop("blocking_scripts"))
query(
    "conversion_metrics",
    f"SELECT domain, bool_or({PHONE}) AS visible_phone, bool_or(page_id % 4 = 3) AS tel_link, bool_or({PHONE}) AND NOT bool_or(page_id % 4 = 3) AS missing_tel_link, CAST(max(CASE WHEN page_id % 4 = 0 THEN 7 ELSE 0 END) AS INT) AS max_form_inputs, "
    f"bool_or(page_id % 4 = 0) AS high_form_friction, bool_or(page_id % 4 = 0) AS autocomplete, CASE WHEN bool_or(page_id % 4 = 3) THEN 'calendly.com' ELSE '' END AS booking_widgets, bool_or(page_id % 4 = 3) AS sticky_cta FROM {S} GROUP BY domain",
)(lambda spark, d: site_audit.conversion_metrics(site(spark, d)).withColumn("booking_widgets", F.array_join("booking_widgets", ",")))
query(
    "seo_metrics",
    f"SELECT page_id, page_id % 6 = 0 AS has_json_ld, page_id % 6 = 0 AS has_local_business, page_id % 6 IN (1, 2) AS has_og_image, page_id % 6 <> 1 AS broken_social, page_id % 6 = 1 AS has_description, CAST(len(regexp_extract_all(html, '(?i)<h1(?:\\s[^>]*)?>')) AS INT) AS h1_count FROM {S}",
)(lambda spark, d: site_audit.seo_metrics(site(spark, d).withColumn("domain", F.col("page_id"))).withColumnRenamed("domain", "page_id"))
query("security_metrics", f"SELECT url, site % 4 <> 0 AS https, hsts_sent AS hsts, false AS csp, hsts_sent AS x_frame, site % 4 <> 0 AND page_id % 6 = 3 AS mixed_content FROM {S}")(
    lambda spark, d: site_audit.security_metrics(site(spark, d).withColumn("page", F.col("url")).withColumn("domain", F.col("url"))).withColumnRenamed("domain", "url")
)
N_IMG = "sum(CASE WHEN page_id % 4 = 1 THEN 6 ELSE 0 END + CASE WHEN page_id % 6 = 3 THEN 1 ELSE 0 END)"
NOT_LAZY = f"CASE WHEN {N_IMG} > 2 THEN greatest(0, sum(CASE WHEN page_id % 4 = 1 THEN 5 ELSE 0 END) - 2) ELSE 0 END"
NO_ALT, OLD_KIND = "sum(CASE WHEN page_id % 4 = 1 THEN 5 ELSE 0 END)", "sum(CASE WHEN page_id % 4 = 1 THEN 5 ELSE 0 END)"
query("image_metrics", f"SELECT domain, {N_IMG} AS n_images, {NOT_LAZY} AS not_lazy, {NO_ALT} AS without_alt, {OLD_KIND} AS legacy_format, {NOT_LAZY} > 2 OR {NO_ALT} > 3 OR {OLD_KIND} > 3 AS image_issues FROM {S} GROUP BY domain")(
    lambda spark, d: site_audit.image_metrics(site(spark, d))
)
UP = "site % 7 <> 0 AND site % 11 <> 0"
query(
    "assemble_audit",
    f"SELECT domain, bool_and({UP}) AS reachable, CASE WHEN bool_and({UP}) THEN max(CASE WHEN path = '/' THEN duration_ms END) END AS homepage_ms, CASE WHEN bool_and({UP}) THEN {LAG} END AS speed_discrepancy, CASE WHEN bool_and({UP}) THEN bool_or({PHONE}) AND NOT bool_or(page_id % 4 = 3) END AS missing_tel_link, "
    f"CASE WHEN bool_and({UP}) THEN bool_or(page_id % 6 = 0 AND path = '/') END AS has_json_ld, CASE WHEN bool_and({UP}) THEN bool_or(page_id % 3 = 0 AND hsts_sent) END AS hsts, CASE WHEN bool_and({UP}) THEN {NOT_LAZY} > 2 OR {NO_ALT} > 3 END AS image_issues FROM {S} GROUP BY domain HAVING bool_or(path = '/')",
)(lambda spark, d: site_audit.assemble_audit(site(spark, d)).select("domain", "reachable", "homepage_ms", "speed_discrepancy", "missing_tel_link", "has_json_ld", "hsts", "image_issues"))
BAD = "(site % 7 = 0 OR site % 11 = 0)"
query(
    "crawl_outcome",
    f"SELECT page_id AS company_id, 'signal' AS kind, 'crawl_audit_failed' AS value FROM {S} WHERE {BAD} UNION ALL SELECT page_id, 'audit', 'failed' FROM {S} WHERE {BAD} UNION ALL SELECT page_id, 'score', 'disqualified' FROM {S} WHERE {BAD} "
    f"UNION ALL SELECT page_id, 'page', url FROM {S} WHERE NOT {BAD} UNION ALL SELECT page_id, 'technology', CASE WHEN {BAD} THEN 'failed' ELSE coalesce(CASE page_id % 5 WHEN 0 THEN 'WordPress 5.' || CAST(page_id % 9 AS STRING) WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Shopify' WHEN 3 THEN 'Webflow' END, '') END FROM {S}",
)(lambda spark, d: crawled(spark, d))


def crawled(spark, d):
    out = site_audit.crawl_outcome(site(spark, d).withColumn("company_id", F.col("page_id")))
    long = lambda name, kind, value: out[name].select("company_id", F.lit(kind).alias("kind"), value.alias("value"))
    parts = [long("signals", "signal", F.col("type")), long("audits", "audit", F.col("status")), long("scores", "score", F.col("priority_tier")), long("pages", "page", F.col("url"))]
    parts.append(long("technologies", "technology", F.when(F.col("crawl_failed"), "failed").otherwise(F.coalesce("cms", F.lit("")))))
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


OUT = f"({C.REASON}) IS NOT NULL"
STATE = f"CASE WHEN {OUT} THEN 'disqualified' WHEN id % 5 = 0 THEN 'failed' WHEN id NOT IN (SELECT company_id FROM {C.PAINS} p) THEN 'clean' ELSE 'success' END"
query(
    "audit_outcome",
    f"SELECT id AS company_id, outcome, CASE WHEN outcome IN ('disqualified', 'failed') THEN 'disqualified' END AS priority_tier, CASE outcome WHEN 'failed' THEN 'crawl_audit_failed' WHEN 'clean' THEN 'clean_audit_verified' END AS signal, "
    f"CAST(CASE outcome WHEN 'failed' THEN 100.0 WHEN 'clean' THEN 95.0 END AS DOUBLE) AS confidence FROM (SELECT id, {STATE} AS outcome FROM {V.sql(V.COMPANIES)} c) z",
)(lambda spark, d: outcome(spark, d))


def outcome(spark, d):
    from prospectra.operators import scoring

    rows = scoring.disqualify_company(V.frame(spark, d, V.COMPANIES)).withColumnRenamed("id", "company_id")
    audits = rows.select("company_id", (F.col("company_id") % 5 != 0).alias("reachable"))
    return site_audit.audit_outcome(rows, audits, C.pains(spark, d), F.col("disqualified_reason").isNotNull()).drop("opportunity_score")


# ---- fields drawn from text
POSTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Acme Retail' WHEN 1 THEN 'Stealth Startup' WHEN 2 THEN 'A Very Long Name Indeed Inc' WHEN 3 THEN 'Blue & Fox' WHEN 4 THEN '' ELSE 'Zed' || CAST(o_orderkey % 50 AS STRING) END AS company,
  CASE o_orderkey % 5 WHEN 0 THEN 'See https://www.remotive.io and https://shop' || CAST(o_orderkey % 40 AS STRING) || '.com/x' WHEN 1 THEN 'Client has $' || CAST(o_orderkey % 90 AS STRING) || 'k+ spent so far' WHEN 2 THEN NULL WHEN 3 THEN 'https://linkedin.com/z' ELSE 'pays $2,500 fixed' END AS description,
  CASE o_orderkey % 3 WHEN 0 THEN 'Food & Drink+Bars (local)!' WHEN 1 THEN '  a,  b-c ' ELSE NULL END AS term, 'job ' || CAST(o_orderkey AS STRING) AS title, 'laravel' AS keyword
FROM {orders}
"""
OWN = "CASE WHEN id % 5 = 0 THEN 'shop' || CAST(id % 40 AS STRING) || '.com' END"
EMPLOYER = f"CASE id % 6 WHEN 0 THEN coalesce({OWN}, 'acmeretail.com') WHEN 3 THEN coalesce({OWN}, 'bluefox.com') WHEN 5 THEN coalesce({OWN}, CASE WHEN length(company) >= 3 THEN lower(company) || '.com' END) END"
projection("infer_employer_domain", POSTS, lambda: {"id": F.col("id"), "domain": extract.infer_employer_domain(F.col("company"), F.col("description"))}, f"id, {EMPLOYER} AS domain")
projection("sanitize_search_term", POSTS, lambda: {"id": F.col("id"), "term": extract.sanitize_search_term(F.col("term"))}, "id, CASE id % 3 WHEN 0 THEN 'Food and Drink Bars local' WHEN 1 THEN 'a, b-c' ELSE '' END AS term")
projection("extract_client_spend", POSTS, lambda: {"id": F.col("id"), "spend": extract.extract_client_spend(F.col("description"))}, "id, CASE WHEN id % 5 = 1 THEN '$' || CAST(id % 90 AS STRING) || 'k+ spent' ELSE '$0 spent / New Client' END AS spend")
STATES = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'joes-tx.localsearch.com' WHEN 1 THEN 'tx.example.com' WHEN 2 THEN 'DinerNY.local' WHEN 3 THEN 'shopqq' || CAST(c_custkey AS STRING) || '.com' END AS domain FROM {customer}"
projection("infer_state", STATES, lambda: {"id": F.col("id"), "state": extract.infer_state(F.col("domain"), leads.STATES)}, "id, CASE id % 5 WHEN 0 THEN 'TX' WHEN 2 THEN 'NY' END AS state")
STACKS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '["React","Vue"]' WHEN 1 THEN 'jQuery, React' WHEN 2 THEN NULL WHEN 3 THEN '[broken' ELSE p_brand END AS raw, CASE p_partkey % 4 WHEN 0 THEN '{{"a": "x' || CAST(p_size AS STRING) || '", "b": 2}}' WHEN 1 THEN 'junk' WHEN 2 THEN '[1]' END AS detail, p_brand AS brand, p_size AS size FROM {part}"""
projection("parse_stack", STACKS, lambda: {"id": F.col("id"), "stack": F.array_join(extract.parse_stack(F.col("raw")), "|")}, "id, CASE id % 5 WHEN 0 THEN 'React|Vue' WHEN 1 THEN 'jQuery|React' WHEN 4 THEN brand ELSE '' END AS stack")
projection("parse_json_detail", STACKS, lambda: {"id": F.col("id"), "a": F.try_element_at(extract.parse_json_detail(F.col("detail")), F.lit("a")), "n": F.size(extract.parse_json_detail(F.col("detail"))).cast("long")}, "id, CASE WHEN id % 4 = 0 THEN 'x' || CAST(size AS STRING) END AS a, CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS n")
SNIPPETS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Jane Mary Doe - Owner of shop ' || CAST(c_custkey AS STRING) WHEN 1 THEN 'x 12: John Smith | CTO and president' WHEN 2 THEN 'nothing to see' END AS snippet FROM {customer}"
exec_ = lambda: extract.extract_name_title(F.col("snippet"))
projection(
    "extract_name_title", SNIPPETS, lambda: {"id": F.col("id"), **{k: exec_()[k] for k in ("full_name", "first_name", "last_name", "title")}},
    "id, CASE id % 4 WHEN 0 THEN 'Jane Mary Doe' WHEN 1 THEN 'John Smith' END AS full_name, CASE id % 4 WHEN 0 THEN 'Jane' WHEN 1 THEN 'John' END AS first_name, CASE id % 4 WHEN 0 THEN 'Doe' WHEN 1 THEN 'Smith' END AS last_name, CASE id % 4 WHEN 0 THEN 'Owner' WHEN 1 THEN 'President' END AS title",
)
NOTICES = """
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Final-Recipient: rfc822; <User' || CAST(user_id AS STRING) || '@Mail.com>  Status: 5.1.1' WHEN 1 THEN 'Action: failed' END AS report,
  CASE event_id % 5 WHEN 0 THEN 'Delivery to me@own.com' WHEN 1 THEN 'message to <bob' || CAST(user_id AS STRING) || '@b.org>, 4.2.2' WHEN 2 THEN 'The mail for ann@c.net failed (5.7.1)' WHEN 3 THEN 'no address' END AS body,
  CASE event_id % 3 WHEN 0 THEN 'Zoe <Zoe@d.com>' WHEN 1 THEN 'me@own.com' ELSE '' END AS mail_to, user_id
FROM {events}
"""
HEAD = "CASE WHEN id % 3 = 0 THEN 'zoe@d.com' END"
projection(
    "bounce_recipient", NOTICES, lambda: {"id": F.col("id"), "recipient": extract.bounce_recipient(F.col("report"), F.col("body"), F.col("mail_to"), F.lit("me@own.com"))},
    f"id, CASE WHEN id % 4 = 0 THEN 'user' || CAST(user_id AS STRING) || '@mail.com' WHEN id % 5 = 1 THEN 'bob' || CAST(user_id AS STRING) || '@b.org' WHEN id % 5 = 2 THEN 'ann@c.net' ELSE {HEAD} END AS recipient",
)
projection("dsn_code", NOTICES, lambda: {"id": F.col("id"), "code": extract.dsn_code(F.col("report"), F.col("body"))}, "id, CASE WHEN id % 4 = 0 THEN '5.1.1' WHEN id % 5 = 1 THEN '4.2.2' WHEN id % 5 = 2 THEN '5.7.1' END AS code")
