"""Page analytics: links, fingerprints and audit metrics of html as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions.text import contains_any, normalize_domain

# fixed values: paths of pages that sell, hiring boards, link words
KEY_PATHS = r"/(about|contact|services|products|pricing|book|quote|team|portfolio|faq)"
BOARDS = ["greenhouse.io", "lever.co", "workable.com", "breezy.hr", "ashbyhq.com"]
CAREERS = r"(careers|jobs|join-us|we-are-hiring|work-with-us|openings)"
# fixed values: release years of library versions, latest major version, first major version that is not at its end of life
RELEASES = {
    "jquery": {
        "1.0": 2006, "1.1": 2007, "1.2": 2007, "1.3": 2009, "1.4": 2010, "1.5": 2011, "1.6": 2011, "1.7": 2011, "1.8": 2012, "1.9": 2013, "1.10": 2013, "1.11": 2014, "1.12": 2016,
        "2.0": 2013, "2.1": 2014, "2.2": 2016, "3.0": 2016, "3.1": 2016, "3.2": 2017, "3.3": 2018, "3.4": 2019, "3.5": 2020, "3.6": 2021, "3.7": 2023,
    },
    "angularjs": {"1.0": 2012, "1.1": 2013, "1.2": 2013, "1.3": 2014, "1.4": 2015, "1.5": 2016, "1.6": 2016, "1.7": 2018, "1.8": 2020},
    "bootstrap": {"2.0": 2012, "2.3": 2013, "3.0": 2013, "3.3": 2014, "3.4": 2019, "4.0": 2018, "4.3": 2019, "4.5": 2020, "4.6": 2021, "5.0": 2021, "5.1": 2021, "5.2": 2022, "5.3": 2023},
    "vue": {"1.0": 2015, "2.0": 2016, "2.5": 2017, "2.6": 2019, "2.7": 2022, "3.0": 2020, "3.2": 2021, "3.3": 2023, "3.4": 2024},
    "react": {"0.14": 2015, "15.0": 2016, "15.6": 2017, "16.0": 2017, "16.8": 2019, "17.0": 2020, "18.0": 2022},
    "wordpress": {
        "3.0": 2010, "4.0": 2014, "4.9": 2017, "5.0": 2018, "5.5": 2020, "5.8": 2021, "5.9": 2022,
        "6.0": 2022, "6.1": 2022, "6.2": 2023, "6.3": 2023, "6.4": 2023, "6.5": 2024, "6.6": 2024, "6.7": 2024,
    },
}
#: Latest major version and its year; every angularjs is at its end of life.
LATEST = {"jquery": (3, 2023), "angularjs": (1, 2022), "bootstrap": (5, 2024), "vue": (3, 2024), "react": (18, 2024), "wordpress": (6, 2024)}
END_OF_LIFE_BEFORE = {"jquery": 3, "angularjs": 99, "bootstrap": 5, "vue": 3, "react": 16, "wordpress": 6}


def _has(html: Column, pattern: str) -> Column:
    return F.lower(html).rlike(pattern)


def key_subpages(links: DataFrame, n: int = 4) -> DataFrame:
    """First ``n`` distinct same-host links of a page on the paths of pages that sell."""
    from .relational import top_per_key

    found = links.where(F.col("same_host") & F.lower("target").rlike(KEY_PATHS)).groupBy("page_id", "target").agg(F.min("position").alias("position"))
    return top_per_key(found, "page_id", [F.col("position")], n)


def fingerprint(html: Column) -> dict[str, Column]:
    """Columns cms, wp_version, frameworks and jquery_version of a page."""
    version = F.regexp_extract(html, r'(?i)<meta[^>]*name="generator"[^>]*content="WordPress\s*([0-9.]*)', 1)
    low = F.lower(html)
    wordpress = (version != "") | contains_any(low, ["wp-content", "wp-includes"])
    cms = F.when(wordpress, F.when(version != "", F.concat(F.lit("WordPress "), version)).otherwise("WordPress")).when(F.contains(low, F.lit("webflow")), "Webflow").when(F.contains(low, F.lit("static.wixstatic.com")), "Wix")
    flags = {"Next.js": ["/_next/", "__next_data__"], "Nuxt.js": ["/_nuxt/", "window.__nuxt__"], "Svelte": ["__sveltekit"]}
    frameworks = F.array_join(F.array_compact(F.array(*(F.when(contains_any(low, marks), F.lit(name)) for name, marks in flags.items()))), ",")
    jquery = F.nullif(F.regexp_extract(low, r"jquery[-.]([0-9]+\.[0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    return {"cms": cms, "wp_version": F.nullif(version, F.lit("")), "frameworks": frameworks, "jquery_version": jquery}


def version_debt(library: Column, version: Column, year: int) -> Column:
    """Struct (release_year, major_gap, years_outdated, eol, risk) of a library version, null for an unknown library."""
    clean = F.regexp_replace(F.coalesce(version, F.lit("")), "[^0-9.]", "")
    major = F.regexp_extract(clean, r"^([0-9]+)", 1).try_cast("int")
    minor = F.coalesce(F.regexp_extract(clean, r"^[0-9]+\.([0-9]+)", 1).try_cast("int"), F.lit(0))
    table = F.create_map(*(F.lit(x) for lib, years in RELEASES.items() for k, y in years.items() for x in (f"{lib} {k}", y)))
    of = lambda name: F.coalesce(*(F.when(library == k, F.lit(v)) for k, v in name.items()))
    latest = of({k: v[0] for k, v in LATEST.items()})
    key = lambda m: F.concat_ws(" ", library, F.concat_ws(".", major.cast("string"), m.cast("string")))
    released = F.coalesce(F.try_element_at(table, key(minor)), F.try_element_at(table, key(F.lit(0))), F.when(major == latest, of({k: v[1] - 1 for k, v in LATEST.items()})).otherwise(2015))
    gap, age = F.greatest(F.lit(0), latest - major), F.greatest(F.lit(0), F.lit(year) - released)
    eol = major < of(END_OF_LIFE_BEFORE)
    risk = F.when(eol | (age >= 8) | (gap >= 2), "critical").when(gap >= 1, "high").when(age >= 4, "medium").otherwise("low")
    return F.when(latest.isNotNull() & major.isNotNull(), F.struct(released.alias("release_year"), gap.alias("major_gap"), age.alias("years_outdated"), eol.alias("eol"), risk.alias("risk")))


def page_metrics(html: Column) -> dict[str, Column]:
    """Profile, conversion, search and image metrics of a page."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    forms = F.regexp_extract_all(html, F.lit(r"(?is)<form[^>]*>(.*?)</form>"), F.lit(1))
    inputs = F.transform(forms, lambda f: F.regexp_count(f, F.lit(r"(?i)<(input|select|textarea)[\s>]")))
    images = F.regexp_extract_all(html, F.lit(r"(?i)(<img[^>]*>)"), F.lit(1))
    without = lambda mark: F.size(F.filter(images, lambda i: ~F.contains(F.lower(i), F.lit(mark)))).cast("long")
    return {
        "size_bytes": F.octet_length(html).cast("long"),
        "n_images": F.size(images).cast("long"),
        "images_not_lazy": without("loading="),
        "images_without_alt": without("alt="),
        "max_form_inputs": F.coalesce(F.array_max(inputs), F.lit(0)).cast("long"),
        "tel_link": _has(html, 'href="tel:'),
        "n_h1": count(r"(?i)<h1[\s>]"),
        "has_schema": _has(html, "application/ld\\+json"),
        "has_opengraph": _has(html, 'property="og:'),
        "mixed_content": _has(html, '(src|href)="http://'),
    }


def hiring_signals(html: Column) -> dict[str, Column]:
    low = F.lower(html)
    return {"boards": F.array_join(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(b)), F.lit(b)) for b in BOARDS))), ","), "career_links": F.regexp_count(low, F.lit(rf'<a\s[^>]*href="[^"]*{CAREERS}')).cast("long")}


#: Days before its end at which a certificate counts as ending soon.
CERTIFICATE_DAYS = 30


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _ends_soon() -> Column:
    return F.coalesce(F.col("cert_days") < CERTIFICATE_DAYS, F.lit(False))


def health_score(m: DataFrame) -> DataFrame:
    """Mean of speed, security and search, a whole number, and its label at 85 and 50.

    Speed is the lighthouse score, else what the load time leaves of 100 (3 s if it is unknown). Security and search lose
    points from 100; each part is ten at least. What is unknown counts as absent.
    """
    lose = lambda *marks: F.greatest(F.lit(10), 100 - sum((F.when(cond, points).otherwise(0) for cond, points in marks), F.lit(0)))
    loaded = F.least(F.lit(100), F.greatest(F.lit(10), F.floor(100 - F.coalesce("homepage_ms", F.lit(3000)) / 45)))
    speed = F.coalesce(F.col("lighthouse_score"), loaded)
    security = lose((~_true("https"), 40), (_ends_soon(), 30), (_true("exposed_users"), 20))
    search = lose((~_true("has_schema"), 25), (_true("broken_social"), 20), (_true("deliverability_risk"), 20), (F.coalesce("broken_links", F.lit(0)) > 0, 20))
    score = F.floor((speed + security + search) / 3).cast("int")
    return m.withColumn("health", score).withColumn("label", F.when(score >= 85, "good").when(score >= 50, "fair").otherwise("poor"))


def audit_findings(m: DataFrame) -> DataFrame:
    """Long table of checks, each passed or not: twelve of every company, two more where there is a lighthouse score."""
    measured = F.col("lighthouse_score").isNotNull()
    checks = {
        "homepage_load": F.coalesce("homepage_ms", F.lit(9999)) < 2500,
        "inner_page_latency": ~_true("speed_discrepancy"),
        "ttfb": F.coalesce("ttfb_ms", F.lit(9999)) < 800,
        "pagespeed_performance": F.when(measured, F.col("lighthouse_score") >= 70),
        "largest_contentful_paint": F.when(measured, F.coalesce(F.nullif("lcp_ms", F.lit(0)), F.lit(9999)) < 2500),
        "one_tap_calling": ~_true("missing_tel_link"),
        "form_friction": F.coalesce("max_form_inputs", F.lit(0)) < 7,
        "sticky_action_bar": _true("sticky_cta"),
        "local_business_schema": _true("has_schema"),
        "social_cards": ~_true("broken_social"),
        "mail_authentication": ~_true("deliverability_risk"),
        "internal_links": F.coalesce("broken_links", F.lit(0)) == 0,
        "image_formats": F.coalesce("legacy_images", F.lit(0)) <= 2,
        "certificate": ~_ends_soon() & _true("cert_valid"),
    }
    rows = m.select("company_id", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()))).alias("c"))
    return rows.select("company_id", "c.check", "c.passed").where("passed is not null")


def pillar_summary(m: DataFrame) -> DataFrame:
    """Number of issues of each company by pillar; speed is one issue or none."""
    fast = (F.col("lighthouse_score") >= 75) | ((F.coalesce("homepage_ms", F.lit(9999)) < 2200) & ~_true("speed_discrepancy"))
    issues = {
        "speed": [~F.coalesce(fast, F.lit(False))],
        "conversion": [_true("missing_tel_link"), F.coalesce("max_form_inputs", F.lit(0)) >= 7, ~_true("sticky_cta")],
        "search": [~_true("has_schema"), _true("broken_social"), _true("deliverability_risk")],
        "security": [~_true("https"), _ends_soon(), _true("exposed_users")],
    }
    return m.select("company_id", *(sum((c.cast("int") for c in conds), F.lit(0)).alias(k) for k, conds in issues.items()))
