"""Queries of links and contacts of pages; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import domains as D
from prospectra.operators import feeds, page_parts, websites
from prospectra.plans import catalog as C
from prospectra.plans import catalog_flow as FLOW
from prospectra.plans import views as V
from prospectra.plans.catalog import query

#: Pages with anchors in other quotes or none, with entities, over lines, unclosed, and of no host. chr(39) is a quote.
ANCHORED = """
SELECT page_id, url, html || CASE page_id % 6
    WHEN 0 THEN '<a class="x" href=' || chr(39) || '/one/?a=1&amp;b=2#top' || chr(39) || '>One' || chr(10) || '  <b>two</b></a>'
    WHEN 1 THEN '<A HREF=/three/>Three &lt;3</A><a href=/three>again</a>'
    WHEN 2 THEN '<a href = "/open">Open<a href="//cdn.net/x">Out</a>'
    WHEN 3 THEN '<a name="n">no</a><a href="mailto:a@b.com">m</a><a href="#s">s</a>'
    WHEN 4 THEN '<a title="a > b" href="/last">q'
    ELSE '' END AS html
FROM {pages}
"""
HOST = "regexp_extract(url, '^(https?://[^/]*)', 1)"
PLAIN = lambda c: f"replace({c}, '&amp;', '&')"
ADDED = (
    "(VALUES (0, 0, '/one/?a=1&b=2#top', 'One two', true), (1, 0, '/three/', 'Three <3', true), (1, 1, '/three', 'again', true), (2, 0, '/open', 'Open', true), (2, 1, '//cdn.net/x', 'Out', false), "
    "(3, 0, 'mailto:a@b.com', 'm', false), (3, 1, '#s', 's', false), (4, 0, '/last', 'q', true)) a(part, nth, href, text, own)"
)
ANCHORS = (
    f"(SELECT page_id, url, {PLAIN('h.href')} AS href, {PLAIN('h.text')} AS text, h.nth AS position, true AS own FROM (SELECT page_id, url, unnest(list_zip(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), regexp_extract_all(html, '<a href=\"[^\"]*\">(.*?)</a>', 1), generate_series(0, 1000)[1:len(regexp_extract_all(html, '<a href=\"'))])) AS t FROM pages) p, "
    "LATERAL (SELECT t[1] AS href, t[2] AS text, t[3] AS nth) h "
    f"UNION ALL SELECT page_id, url, a.href, a.text, len(regexp_extract_all(html, '<a href=\"')) + a.nth, own FROM pages JOIN {ADDED} ON a.part = page_id % 6)"
)
TARGET = f"CASE WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN {HOST} || href WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href ELSE href END"
query("page_links", f"SELECT page_id, CAST(position AS BIGINT) AS position, href, text, {TARGET} AS target, own AS same_host FROM {ANCHORS} l")(
    lambda spark, d: page_parts.page_links(V.frame(spark, d, ANCHORED)).withColumn("position", F.col("position").cast("long"))
)
BARE = lambda c: f"rtrim(regexp_extract({c}, '^([^?#]*)', 1), '/')"
CHECKED = (
    f"(SELECT page_id, target, min(position) AS position FROM (SELECT page_id, url, position, {BARE(TARGET)} AS target FROM {ANCHORS} l WHERE own) x WHERE target <> {BARE('url')} "
    "GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(position)) <= 10)"
)
BROKEN = "length(target) % 3 = 0"
query(
    "link_health",
    f"SELECT page_id, count(*) AS n_checked, count(*) FILTER ({BROKEN}) AS n_broken, coalesce(array_to_string(list(target ORDER BY position) FILTER ({BROKEN})[1:5], ' '), '') AS broken_links, bool_or(length(target) % 7 = 0) AS redirect_chain FROM {CHECKED} c GROUP BY page_id",
)(lambda spark, d: health(spark, d))


def health(spark, d):
    pages = V.frame(spark, d, ANCHORED)
    links = page_parts.page_links(pages)
    length = F.length("target")
    status = links.where("same_host").select(page_parts.bare_link(F.col("target")).alias("target")).distinct()
    status = status.select("target", F.when(length % 3 == 0, F.when(length % 2 == 0, 404).otherwise(0)).otherwise(200).alias("status"), F.when(length % 7 == 0, 2).otherwise(1).alias("redirects"))
    return page_parts.link_health(links, status, pages).withColumn("broken_links", F.array_join("broken_links", " "))


#: Sites of three pages with addresses of every kind; the masked one is jo@site3.com.
PEOPLED = """
SELECT 'site' || CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) || '.com' AS domain, page_id % 3 AS position, page_id, html || CASE page_id % 7
    WHEN 0 THEN '<a href="mailto:Ann@Other.net?subject=x">write to Ann</a><p>mail info@site' || CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) || '.com, or logo@2x.png</p>'
    WHEN 1 THEN '<script type="application/ld+json">{{"@graph": [{{"@type": "Organization", "contactPoint": [{{"x": {{"EMAIL": "desk@graph.org"}}}}]}}, {{"email": ["no"]}}]}}</script><p>ann@other.net</p>'
    WHEN 2 THEN '<p>bob [at] site' || CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) || ' [dot] com</p>'
    WHEN 3 THEN '<span data-cfemail="02686d42716b7667312c616d6f">[protected]</span><script>var a = "hid@den.com";</script>'
    WHEN 4 THEN '<script type="application/ld+json">not json</script><p>user@real.com, sales@real.com and x@example.com</p>'
    ELSE '' END AS html
FROM {pages}
"""
OWN = "'site' || CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) || '.com'"
GIVEN = (
    f"(SELECT page_id, 0 AS nth, 'mailto' AS kind, 'ann@other.net' AS email, 'write to Ann' AS label FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 1, 'text', 'info@' || {OWN}, '' FROM pages WHERE page_id % 7 = 0 "
    f"UNION ALL SELECT page_id, 0, 'data', 'desk@graph.org', '' FROM pages WHERE page_id % 7 = 1 UNION ALL SELECT page_id, 1, 'text', 'ann@other.net', '' FROM pages WHERE page_id % 7 = 1 UNION ALL SELECT page_id, 0, 'written_out', 'bob@' || {OWN}, '' FROM pages WHERE page_id % 7 = 2 "
    "UNION ALL SELECT page_id, 0, 'masked', 'jo@site3.com', '' FROM pages WHERE page_id % 7 = 3 UNION ALL SELECT page_id, 0, 'text', 'sales@real.com', '' FROM pages WHERE page_id % 7 = 4 "
    f"UNION ALL SELECT page_id, -100 + unnest(range(len({{0}}))), 'text', lower(trim(unnest({{0}}), '.')), '' FROM pages)"
).replace("{0}", f"regexp_extract_all({C.TEXT}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9.-]+')")
POINTS = f"CASE WHEN contains(email, {OWN}) THEN 10 ELSE 0 END + CASE WHEN split_part(email, '@', 1) IN ('contact', 'hello', 'hi', 'info', 'team', 'inquiries', 'partnerships', 'sales') THEN 5 ELSE 0 END"
query(
    "site_contacts",
    f"SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY page, points DESC, nth, email) AS INT) AS rank, email, kind, label FROM (SELECT * FROM (SELECT {OWN} AS domain, page_id % 3 AS page, {POINTS} AS points, nth, email, kind, label FROM {GIVEN} g WHERE NOT regexp_matches(email, '@([^@]*[.])?(example|email|company|domain)[.]com$') AND split_part(email, '@', 1) NOT IN ('user', 'name', 'email', 'example', 'username', 'yourname') AND NOT ends_with(email, '.png')) x "
    "QUALIFY row_number() OVER (PARTITION BY domain, email ORDER BY page, points DESC, nth) = 1) y",
)(lambda spark, d: page_parts.site_contacts(V.frame(spark, d, PEOPLED), None))

# ---- hiring signals
HIRES = """
SELECT page_id, url, html || CASE page_id % 6 WHEN 0 THEN '<p>We seek a Laravel or PHP Developer, laravel first; DevOps on AWS</p>' WHEN 1 THEN '<p>Full-stack software engineer (React)</p><script>var angular = 1;</script>' WHEN 2 THEN '<p>wordpressed</p>' ELSE '' END
  || CASE page_id % 5 WHEN 0 THEN '<iframe src="https://boards.Greenhouse.io/x"></iframe><a href="https://jobs.lever.co/x">Open roles</a>' WHEN 1 THEN '<a href="/Careers">A</a><a href="/b">See our JOBS</a><a href="/join-us">C</a><a href="/openings">D</a>'
    WHEN 2 THEN '<script src="https://apply.workable.com/e.js"></script>' ELSE '' END AS html
FROM {pages}
"""
MATCHES = {
    "laravel": "(laravel|php developer|backend engineer|php engineer)", "angular": "(angular|angularjs|frontend engineer|frontend developer)", "react": "(react|reactjs|next\\.js|frontend engineer)",
    "wordpress": "(wordpress|wp developer|theme developer|plugin developer)", "devops": "(devops|aws|cloud engineer|site reliability|kubernetes|docker)", "fullstack": "(full[\\s-]?stack|software engineer|lead developer)",
}
HIT = lambda p: f"regexp_extract_all({C.TEXT}, '(?i)\\b{p}\\b', 1)"
SKILL_TEXT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({HIT(p)}) > 0 THEN '{n}:' || len({HIT(p)}) || ':' || {HIT(p)}[1] END" for n, p in MATCHES.items()) + "], lambda x: x IS NOT NULL), ' ')"
query(
    "hiring_signal_rows",
    "SELECT page_id, 'hiring_ats_detected' AS type, CAST(0.95 AS DOUBLE) AS confidence, CASE page_id % 5 WHEN 0 THEN 'greenhouse lever' ELSE 'workable' END AS detail FROM pages WHERE page_id % 5 IN (0, 2) "
    "UNION ALL SELECT page_id, 'career_page_detected', 0.9, CASE page_id % 5 WHEN 0 THEN 'Open roles>https://jobs.lever.co/x' ELSE 'A>/Careers See our JOBS>/b C>/join-us' END FROM pages WHERE page_id % 5 IN (0, 1) "
    f"UNION ALL SELECT page_id, 'hiring_skill_match', 0.85, s FROM (SELECT page_id, {SKILL_TEXT} AS s FROM {V.sql(HIRES)} h) x WHERE s <> ''",
)(lambda spark, d: signal_rows(spark, d))


def signal_rows(spark, d):
    from prospectra.operators import hiring

    links = F.transform("detail.career_links", lambda x: F.concat_ws(">", x["text"], x["href"]))
    skills = F.transform("detail.matched_skills", lambda m: F.concat_ws(":", m["skill"], m["count"], m["sample"]))
    return hiring.hiring_signals(V.frame(spark, d, HIRES)).select("page_id", "type", "confidence", F.array_join(F.coalesce("detail.ats_platforms", links, skills), " ").alias("detail"))


# ---- lookup tables
AREAS = "SELECT CAST(200 + s_suppkey % 700 AS STRING) AS area_code, 'S' || CAST(s_suppkey % 50 AS STRING) AS state, 'City ' || CAST(s_suppkey % 90 AS STRING) AS city FROM {supplier}"
CALLED = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '12' WHEN 1 THEN NULL WHEN 2 THEN '+1 ' ELSE '' END || CASE WHEN c_custkey % 5 > 1 THEN '(' || CAST(200 + c_custkey % 800 AS STRING) || ') 555-0' || CAST(100 + c_custkey % 900 AS STRING) ELSE '' END AS phone FROM {customer}"
DIGITS = "right(regexp_replace(phone, '[^0-9]', '', 'g'), 10)"
query(
    "locate_phones",
    f"SELECT id, substr(digits, 1, 3) || '.' || substr(digits, 4, 3) || '.' || substr(digits, 7) AS dotted, substr(digits, 1, 3) || ' ' || substr(digits, 4, 3) || ' ' || substr(digits, 7) AS compact, CASE WHEN digits IS NOT NULL THEN coalesce(state, '') END AS state, CASE WHEN digits IS NOT NULL THEN coalesce(city, '') END AS city "
    f"FROM (SELECT id, CASE WHEN length({DIGITS}) = 10 THEN {DIGITS} END AS digits FROM {V.sql(CALLED)} c) p LEFT JOIN (SELECT area_code, min(struct_pack(state, city)).state AS state, min(struct_pack(state, city)).city AS city FROM {V.sql(AREAS)} a GROUP BY area_code) a ON a.area_code = substr(digits, 1, 3)",
)(lambda spark, d: located(spark, d))


def located(spark, d):
    """The area codes go through a versioned lookup table."""
    from prospectra.operators.lineage import shared_folder
    from prospectra.sources import lookups

    folder = f"{shared_folder(spark)}/lookups"
    areas = V.frame(spark, d, AREAS)
    lookups.write_lookup(areas.withColumn("state", F.lit("old")), folder, "area_codes", 1)
    lookups.write_lookup(areas, folder, "area_codes", 2)
    table = lookups.read_lookup_table(spark, folder, "area_codes", "area_code")
    return lookups.locate_phones(V.frame(spark, d, CALLED), table).select("id", "phone_forms.dotted", "phone_forms.compact", "state", "city")

# ---- websites and worklists
OFFERED = """
SELECT l_orderkey AS company_id, CASE l_orderkey % 4 WHEN 0 THEN 'Harbor Oak Plumbing LLC' WHEN 1 THEN 'The Roofing Co' WHEN 2 THEN 'A1' ELSE 'Zenith Dental' END AS name, l_linenumber AS position,
  CASE l_suppkey % 9 WHEN 0 THEN 'https://www.harboroak.com/x' WHEN 1 THEN 'http://harbor.net' WHEN 2 THEN 'https://m.facebook.com/harboroak' WHEN 3 THEN 'ftp://zenithdental.org/a?b' WHEN 4 THEN 'https://apple.de' WHEN 5 THEN 'mailto:a@harbor.com' WHEN 6 THEN 'https://roofing.io'
    WHEN 7 THEN '//oak.harbor' ELSE 'https://yelp.com/biz' END AS link
FROM {lineitem}
"""
GOOD = "(VALUES (0, 'harbor oak', 'https://harboroak.com', 2), (0, 'harbor oak', 'http://harbor.net', 1), (0, 'harbor oak', 'https://oak.harbor', 1), (1, 'roofing', 'https://roofing.io', 1), (3, 'zenith dental', 'https://zenithdental.org', 2)) g(part, words, site, n)"
SITES = "(VALUES (0, 'https://harboroak.com'), (1, 'http://harbor.net'), (3, 'https://zenithdental.org'), (6, 'https://roofing.io'), (7, 'https://oak.harbor')) s(kind, site)"
query(
    "best_website",
    f"SELECT company_id, arg_min(site, rank) AS website FROM (SELECT l_orderkey AS company_id, s.site, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 4 = 2 THEN 1 ELSE g.n END DESC, l_linenumber, s.site) AS rank FROM lineitem JOIN {SITES} ON s.kind = l_suppkey % 9 "
    f"LEFT JOIN {GOOD} ON g.part = l_orderkey % 4 AND g.site = s.site WHERE g.n IS NOT NULL OR l_orderkey % 4 = 2) x GROUP BY company_id",
)(lambda spark, d: websites.best_website(V.frame(spark, d, OFFERED)))
query(
    "retries_first",
    f"SELECT 0 AS place, company_id, domain, 'https://' || domain AS website_url, attempt AS retry_count FROM (SELECT * FROM ({C.RETRY}) r WHERE NOT dead_letter AND next_retry_at <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY next_retry_at, company_id LIMIT 10) d "
    f"UNION ALL SELECT 1, id, domain, website_url, 0 FROM {V.sql(V.COMPANIES)} c WHERE website_url IS NOT NULL",
)(lambda spark, d: websites.retries_first(feeds.due_retries(feeds.retry_schedule(V.frame(spark, d, V.FAILURES)), F.lit("2024-01-15").cast("timestamp"), 10), V.frame(spark, d, V.COMPANIES).where("website_url is not null")))
LANDED = "SELECT CASE WHEN page_id % 3 = 0 THEN 'site' || CAST(page_id AS STRING) || '.com' END AS domain, url AS source_url, CASE page_id % 5 WHEN 0 THEN NULL ELSE 200 + page_id % 300 END AS http_status, html AS raw_html, page_id % 900 AS ttfb_ms, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error, 'nginx' AS server FROM {pages}"
FAILED = "(http_status IS NULL OR error IS NOT NULL)"
query(
    "read_pages",
    f"SELECT coalesce(domain, {C.HOST.format('source_url')}) AS domain, source_url, CASE WHEN {FAILED} THEN 0 ELSE http_status END AS http_status, CASE WHEN {FAILED} THEN NULL ELSE server END AS server, CASE WHEN {FAILED} THEN 0 ELSE length(raw_html) END AS n_chars, CASE WHEN NOT {FAILED} THEN ttfb_ms END AS ttfb_ms FROM {V.sql(LANDED)} l",
)(lambda spark, d: landed_pages(spark, d))


def landed_pages(spark, d):
    """The pages go through files of JSON records."""
    import uuid

    from prospectra.operators.lineage import shared_folder
    from prospectra.sources import tables

    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    V.frame(spark, d, LANDED).withColumn("headers", F.create_map(F.lit("server"), F.col("server"))).drop("server").write.json(path)
    return tables.read_pages(spark, path).select("domain", "source_url", "http_status", F.col("headers")["server"].alias("server"), F.char_length("raw_html").alias("n_chars"), "ttfb_ms")

# ---- job postings and the parts of the buying score
JOBS = """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Acme Web Agency' WHEN 1 THEN 'Firm ' || CAST(p_partkey % 300 AS STRING) || ' LLC' WHEN 2 THEN 'Plain Works ' || CAST(p_partkey % 40 AS STRING) ELSE 'Dental ' || CAST(p_partkey % 500 AS STRING) END AS company_name,
  CASE p_partkey % 7 WHEN 0 THEN 'nodot' WHEN 1 THEN 'biz' || CAST(p_partkey % 60 AS STRING) || '.com' ELSE 'hire' || CAST(p_partkey % 700 AS STRING) || '.com' END AS domain, 'Engineer ' || CAST(p_partkey % 9 AS STRING) AS job_title,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'freight and shipping tools' ELSE 'a plain text of the post' END AS summary, 'rss' AS source, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'https://jobs/' || CAST(p_partkey AS STRING) END AS job_url,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(70 AS DOUBLE) END AS confidence, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'Custom Apps' END AS default_industry
FROM {part}
"""
KIND_OF = lambda text: C.sql_case([(C.sql_contains(f"lower({text})", words), f"'{label}'") for label, words in D.INDUSTRIES.items()], "NULL")
SEEN = f"SELECT *, coalesce({KIND_OF("company_name || ' ' || job_title || ' ' || coalesce(summary, '')")}, default_industry, 'Commercial Web & Software Applications') AS industry, company_name AS name, 'Hiring: ' || job_title || ' - ' || substr(coalesce(summary, ''), 1, 150) AS project FROM {V.sql(JOBS)} j"
ASKED = f"(SELECT id, name, industry, project, job_title, summary, job_url, confidence, {C.HOST.format('domain')} AS domain, coalesce(nullif({C.NAME}, ''), 'id:' || CAST(id AS VARCHAR)) AS slug FROM ({SEEN}) s)"
OPEN_JOBS = f"(SELECT * FROM {ASKED} p WHERE contains(domain, '.') AND NOT {C.sql_contains(C.ALL_TEXT, D.AGENCY_WORDS)} AND domain NOT IN (SELECT {C.HOST.format('domain')} FROM {V.sql(V.COMPANIES)} k) AND slug NOT IN (SELECT {C.NAME} FROM {V.sql(V.COMPANIES)} k))"
query(
    "ingest_postings",
    f"SELECT domain, coalesce({KIND_OF("name || ' ' || industry || ' ' || project")}, industry) AS industry, job_title, coalesce(summary, '') AS snippet, coalesce(nullif(job_url, ''), 'https://' || domain) AS job_url, coalesce(confidence, 60.0) AS confidence FROM ({FLOW.sql_greedy(OPEN_JOBS)}) g",
)(lambda spark, d: posted(spark, d))


def posted(spark, d):
    from prospectra.operators import intake

    taken, signals = intake.ingest_postings(V.frame(spark, d, JOBS), V.frame(spark, d, V.COMPANIES))
    return taken.select("domain", "industry").join(signals, "domain").select("domain", "industry", "job_title", "snippet", "job_url", "confidence")


SKILLED = V.SIGNALS.replace("event_id AS id,", "event_id AS id, CASE event_id % 3 WHEN 0 THEN 'Laravel' WHEN 1 THEN 'devops' ELSE 'cobol' END AS skill,").replace("WHEN 7 THEN 'missing_phone'", "WHEN 7 THEN 'hiring_skill_match'")
POINTS_OF = f"CASE type WHEN 'client_past_spend_verified' THEN 45.0 * greatest(0.6, {C.CONF}) WHEN 'directory_client_review' THEN 40.0 * greatest(0.6, {C.CONF}) WHEN 'active_hiring_intent' THEN 25.0 * {C.CONF} WHEN 'hiring_ats_detected' THEN 15.0 * {C.CONF} WHEN 'career_page_detected' THEN 10.0 * {C.CONF} WHEN 'funding_round' THEN 20.0 * {C.CONF} END"
NAMED_AS = "CASE type WHEN 'client_past_spend_verified' THEN 'past_spend_client_past_spend_verified' WHEN 'directory_client_review' THEN 'past_spend_directory_client_review' WHEN 'hiring_ats_detected' THEN 'ats_detected' WHEN 'career_page_detected' THEN 'career_page' WHEN 'funding_round' THEN 'growth_funding_round' ELSE type END"
SKILL_POINTS = f"CASE skill WHEN 'Laravel' THEN 30.0 ELSE 15.0 END * {C.CONF}"
query(
    "buying_attribution",
    f"SELECT DISTINCT company_id, 'baseline_signals_present' AS reason, CAST(25.0 AS DOUBLE) AS points, CAST(1.0 AS DOUBLE) AS confidence, 0 AS n_skills FROM {V.sql(SKILLED)} a UNION ALL SELECT company_id, {NAMED_AS}, CAST(round({POINTS_OF}, 2) AS DOUBLE), CAST({C.CONF} AS DOUBLE), 0 FROM {V.sql(SKILLED)} b WHERE {POINTS_OF} IS NOT NULL "
    f"UNION ALL SELECT company_id, 'hiring_skills_capped', CAST(round(least(40.0, round(sum({SKILL_POINTS}), 6)), 2) AS DOUBLE) AS p, NULL, count(*) FROM {V.sql(SKILLED)} c WHERE type = 'hiring_skill_match' GROUP BY company_id HAVING sum({SKILL_POINTS}) > 0",
)(lambda spark, d: attributed(spark, d))


def attributed(spark, d):
    from prospectra.operators import scoring

    signals = V.frame(spark, d, SKILLED).withColumn("skills", F.array("skill"))
    return scoring.buying_attribution(signals).withColumn("n_skills", F.size("skills")).drop("skills")
