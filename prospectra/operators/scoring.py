"""Detection and scoring rules: fit, gap, pain, buying, contact, service, composite score and tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions.domains import disqualifier
from prospectra.functions.text import contains_any, normalize_confidence, parse_employee_bounds

# fixed values: industries of buyers
TARGET_INDUSTRIES = [
    "e-commerce", "ecommerce", "retail", "dtc", "direct to consumer", "real estate", "property management", "proptech", "real estate technology", "restaurant",
    "food delivery", "food & beverage", "hospitality", "catering", "hotel", "travel", "tourism", "health", "healthcare", "medtech", "fitness", "wellness",
    "logistics", "supply chain", "transportation", "automotive", "auto dealership", "financial services", "fintech", "insurance", "legal", "law firm",
    "education", "edtech", "commercial services", "construction", "manufacturing", "wholesale", "distribution", "media", "publishing", "sports", "entertainment",
]
# fixed values: marks of suppliers, in order of precedence
SUPPLIERS = {
    "industry": [
        "agency", "agencies", "software development", "software house", "software company", "software consulting", "software solutions", "software services",
        "software studio", "software firm", "web development", "web design", "web agency", "web studio", "web solutions", "app development", "application development",
        "mobile development", "mobile app development", "mobile app agency", "custom development", "product development", "product studio", "it services", "it consulting",
        "it solutions", "it company", "it firm", "it agency", "information technology", "managed services", "msp", "system integrator", "systems integration",
        "technology consulting", "tech consulting", "technology company", "tech company", "technology services", "tech services", "technology solutions", "tech solutions",
        "technology firm", "dev shop", "dev agency", "dev studio", "dev firm", "development studio", "development agency", "development company", "development firm",
        "development shop", "digital agency", "digital studio", "digital transformation", "digital solutions", "digital services", "digital marketing agency",
        "digital marketing company", "ux agency", "ui agency", "ux/ui", "design agency", "design studio", "design company", "creative agency", "creative studio",
        "saas company", "saas provider", "saas platform", "saas startup", "software startup", "tech startup", "technology startup", "outsourcing", "nearshore",
        "offshore development", "staff augmentation provider", "augmentation company", "devops agency", "devops company", "cloud consulting", "cloud services company",
        "infrastructure services", "qa company", "testing company", "testing services", "software & web development", "software and web development", "web & software development",
    ],
    "name": [
        "infotech", "infosoft", "softtech", "softech", "techsolutions", "webdev", "devops", "coders", "codex", "devx", "appdev", "byte", "pixels", "pixelsoft",
        "codebase", "codehouse", "itworks", "techworks", "netsoft", "netsolutions", "outsource", "nearshore",
    ],
    "domain": [r"(devs?|coder|codebase|codehouse|softdev|webdev|appdev)\.", r"\.(dev|code|tech|labs?|studio)$", r"^\w*(agency|agenc)(y|ies)?\.", r"^\w*(outsourc|offsh|nearsh)\w*\."],
}
# fixed values: sources that verify, modern stacks, and the points of severities, signals, skills and opportunities
VERIFIED_SOURCES = ["clutch", "goodfirms", "designrush", "yelp", "google_maps", "gmaps"]
MODERN = ["react", "next.js", "vue", "nuxt", "svelte", "laravel", "angular"]
SEVERITY = {"critical": 35.0, "high": 30.0, "medium": 20.0, "low": 10.0}
PAST_SPEND = {"client_past_spend_verified": 45.0, "directory_client_review": 40.0, "past_spend_verified": 45.0, "verified_agency_client": 45.0}
SIGNALS = {"active_hiring_intent": 25.0, "hiring_ats_detected": 15.0, "career_page_detected": 10.0, "funding_round": 20.0, "company_growth_award": 20.0, "client_scale_expansion": 20.0}
SKILLS = {"laravel": 30.0, "next.js": 30.0, "react": 25.0, "shopify": 25.0, "woocommerce": 20.0, "wordpress": 15.0, "fullstack": 20.0, "devops": 15.0}
HIGH_VALUE = ["cms_to_laravel_migration", "frontend_modernization", "staff_augmentation", "new_website_creation"]
# fixed values: what a single pain sells: opportunity, low and high value, service, low and high quote, low and high pilot, confidence, positioning, billing
CATALOG = {
    "subpage_speed_discrepancy": ("performance_optimization", 8000, 20000, "Multi-Page Speed & Asset Optimization", 1500, 3500, 800, 1500, 0.90, "pilot_sprint_intro", "fixed_project"),
    "missing_mobile_tel_link": ("conversion_rate_optimization", 5000, 15000, "Mobile CRO & 1-Tap Booking Integration", 1000, 2500, 500, 1000, 0.95, "pilot_sprint_intro", "fixed_project"),
    "dns_email_deliverability_risk": ("infrastructure_security", 3000, 8000, "DNS & Email Deliverability Authentication (SPF / DMARC)", 500, 1200, 350, 600, 0.95, "pilot_sprint_intro", "fixed_project"),
    "legacy_jquery": ("frontend_modernization", 15000, 40000, "Frontend Modernization (React / Next.js / TypeScript)", 3500, 10000, 1200, 2500, 0.85, "new_vendor_anchor_low", "fixed_project"),
    "legacy_angularjs_eol": ("frontend_modernization", 20000, 45000, "Legacy AngularJS to React / Next.js Migration", 4500, 12000, 1500, 3000, 0.95, "new_vendor_anchor_low", "fixed_project"),
    "outdated_wordpress": ("cms_to_laravel_migration", 20000, 60000, "WordPress to Custom Next.js / Modern Stack Migration", 5000, 15000, 1500, 3000, 0.90, "new_vendor_anchor_low", "fixed_project"),
    "hiring_capacity_bottleneck": ("staff_augmentation", 30000, 80000, "Dedicated Full-Stack Engineering Team Augmentation", 3500, 8000, 1500, 3500, 0.85, "new_vendor_anchor_low", "monthly_recurring"),
}
MASTER = ("turnkey_modernization_overhaul", 25000, 50000, "Turnkey Web Modernization, Mobile Conversion & Performance Overhaul", 2500, 5000, 900, 1800, 0.95, "master_audit_solution", "fixed_project")
OFFER = ["type", "estimated_value_low", "estimated_value_high", "recommended_service", "quote_low", "quote_high", "pilot_low", "pilot_high", "confidence", "quote_positioning", "billing_model"]
PRICING_VERSION, CURRENCY = "1.4.0", "USD"
# fixed values: parts of pain types that count as evidence of each pillar
PILLARS = {
    "speed": ["speed", "ttfb", "performance"],
    "conversion": ["tel", "form", "booking"],
    "seo_dns": ["schema", "dns", "social", "security", "http"],
    "tech_stack": ["jquery", "wordpress", "angular", "hiring"],
}


def clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table as an ordered conditional."""
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()), F.lit(default))


def disqualify_company(df: DataFrame) -> DataFrame:
    """Add ``disqualified_reason``, null for buyers."""
    return df.withColumn("disqualified_reason", disqualifier(F.col("industry"), F.col("name"), F.col("domain"), SUPPLIERS, TARGET_INDUSTRIES))


def company_fit(df: DataFrame) -> DataFrame:
    """Add ``company_fit`` from industry, employees and source; suppliers get 0."""
    industry, staff = F.lower(F.coalesce("industry", F.lit(""))), F.coalesce("employees", F.lit(""))
    b = parse_employee_bounds(staff)
    lo, hi = b["lo"], b["hi"]
    by_industry = F.when(contains_any(industry, TARGET_INDUSTRIES), 35.0).when(industry != "", 15.0).otherwise(0.0)
    by_staff = (
        F.when(((lo >= 10) & (hi <= 300)) | ((lo <= 10) & hi.between(20, 250)), 30.0)
        .when(hi < 10, 15.0)
        .when(lo >= 500, 10.0)
        .when(b.isNotNull(), 20.0)
        .when(F.contains(F.lower(staff), F.lit("mid")), 25.0)
        .otherwise(0.0)
    )
    by_source = F.when(contains_any(F.lower(F.coalesce("source", F.lit(""))), VERIFIED_SOURCES), 10.0).otherwise(0.0)
    fit = F.when(F.col("disqualified_reason").isNotNull(), 0.0).otherwise(clamp(25.0 + by_industry + by_staff + by_source))
    return disqualify_company(df).withColumn("company_fit", fit)


def technology_gap() -> Column:
    """Gap of a row with cms, wp_version, jquery_version, frontend, backend (arrays), https, hsts."""
    cms = F.lower(F.coalesce("cms", F.lit("")))
    version = F.regexp_extract(F.coalesce("wp_version", F.lit("")), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    by_cms = (
        F.when(F.contains(cms, F.lit("wordpress")) | F.col("wp_version").isNotNull(), F.when(version < 6, 30.0).when(version.isNotNull(), 15.0).otherwise(20.0))
        .when(F.contains(cms, F.lit("joomla")) | F.contains(cms, F.lit("drupal")), 25.0)
        .otherwise(0.0)
    )
    front, back = F.coalesce("frontend", F.array().cast("array<string>")), F.coalesce("backend", F.array().cast("array<string>"))
    jq = F.coalesce("jquery_version", F.lit(""))
    by_jquery = F.when(F.exists(front, lambda x: F.contains(F.lower(x), F.lit("jquery"))) | F.col("jquery_version").isNotNull(), F.when(jq.rlike(r"^[12]\."), 25.0).otherwise(15.0)).otherwise(0.0)
    by_transport = F.when(~F.coalesce("https", F.lit(True)), 25.0).when(~F.coalesce("hsts", F.lit(True)), 10.0).otherwise(0.0)
    modern = F.exists(F.concat(front, back), lambda x: contains_any(F.lower(x), MODERN))
    by_age = F.when(~modern & ((cms != "") | (F.size(front) > 0)), 20.0).otherwise(0.0)
    return clamp(by_cms + by_jquery + by_transport + by_age)


def pain_signal(pains: DataFrame) -> DataFrame:
    """``pain_signal`` per company: severity weight times confidence, the first pain of each type only."""
    typed = pains.where("coalesce(type, '') <> ''").groupBy("company_id", "type").agg(F.min_by(F.struct("severity", "confidence"), "position").alias("p")).select("company_id", "p.*")
    rest = pains.where("coalesce(type, '') = ''").select("company_id", "severity", "confidence")
    points = lookup(F.lower(F.coalesce("severity", F.lit("medium"))), SEVERITY, 20.0) * F.coalesce("confidence", F.lit(1.0))
    return typed.unionByName(rest).groupBy("company_id").agg(F.round(F.sum(points), 6).alias("s")).select("company_id", F.round(clamp(F.col("s")), 2).alias("pain_signal"))


def buying_signal(signals: DataFrame) -> DataFrame:
    """``buying_signal`` per company with signals: 25, typed weights times confidence, skills up to 40 points."""
    conf = normalize_confidence(F.col("confidence"))
    kind = F.col("type")
    typed = F.coalesce(lookup(kind, PAST_SPEND) * F.greatest(F.lit(0.6), conf), lookup(kind, SIGNALS) * conf, F.lit(0.0))
    skill_points = F.aggregate(
        F.coalesce("skills", F.array().cast("array<string>")), F.lit(0.0), lambda acc, s: acc + F.coalesce(*(F.when(F.lower(s) == k, F.lit(v)) for k, v in SKILLS.items()), F.lit(15.0))
    )
    skills = F.when(kind == "hiring_skill_match", skill_points * conf).otherwise(0.0)
    sums = signals.groupBy("company_id").agg(F.round(F.sum(typed), 6).alias("t"), F.round(F.sum(skills), 6).alias("k"))
    return sums.select("company_id", F.round(clamp(25.0 + F.col("t") + F.least(F.lit(40.0), "k")), 2).alias("buying_signal"))


def buying_attribution(signals: DataFrame) -> DataFrame:
    """What ``buying_signal`` is made of: rows ``company_id, reason, points, confidence, skills``.

    Every company with signals has a row for its baseline, one for each signal that counts, and one for its skills, which
    are named with their points and together count 40 at most. Points are rounded to two places.
    """
    conf, kind = normalize_confidence(F.col("confidence")), F.col("type")
    spent = lookup(kind, PAST_SPEND) * F.greatest(F.lit(0.6), conf)
    reason = (
        F.when(spent.isNotNull(), F.concat(F.lit("past_spend_"), kind))
        .when(kind == "hiring_ats_detected", "ats_detected")
        .when(kind == "career_page_detected", "career_page")
        .when(kind.isin("funding_round", "company_growth_award", "client_scale_expansion"), F.concat(F.lit("growth_"), kind))
        .otherwise(kind)
    )
    points = F.coalesce(spent, lookup(kind, SIGNALS) * conf)
    none = F.array().cast("array<string>")
    counted = signals.select("company_id", reason.alias("reason"), F.round(points, 2).alias("points"), conf.alias("confidence"), none.alias("skills")).where("points is not null")
    base = signals.select("company_id").distinct().select("company_id", F.lit("baseline_signals_present").alias("reason"), F.lit(25.0).alias("points"), F.lit(1.0).alias("confidence"), none.alias("skills"))
    weight = F.coalesce(*(F.when(F.lower("skill") == k, F.lit(v)) for k, v in SKILLS.items()), F.lit(15.0))
    named = signals.where(kind == "hiring_skill_match").select("company_id", "id", F.posexplode("skills").alias("at", "skill"), conf.alias("conf")).withColumn("p", weight * F.col("conf"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("id", "at", F.format_string("%s (+%.1f)", F.lower("skill"), F.col("p")).alias("text")))), lambda x: x["text"])
    skills = named.groupBy("company_id").agg(F.lit("hiring_skills_capped").alias("reason"), F.round(F.least(F.lit(40.0), F.round(F.sum("p"), 6)), 2).alias("points"), F.lit(None).cast("double").alias("confidence"), told.alias("skills"))
    return base.unionByName(counted).unionByName(skills.where("points > 0"))


def contact_quality() -> Column:
    base = 50.0 + F.when(F.coalesce("website_url", F.lit("")) != "", 25.0).otherwise(0.0) + F.when(F.contains(F.coalesce("domain", F.lit("")), F.lit(".")), 25.0).otherwise(0.0)
    return F.least(F.lit(100.0), base + F.coalesce("n_contacts", F.lit(0)) * 10.0)


def service_fit(opportunities: DataFrame) -> DataFrame:
    """``service_fit`` and deal range per company with opportunities."""
    points = F.when(F.col("type").isin(HIGH_VALUE), 25.0).otherwise(15.0)
    return opportunities.groupBy("company_id").agg(
        F.least(F.lit(100.0), 40.0 + F.sum(points)).alias("service_fit"),
        F.sum("estimated_value_low").alias("deal_low"),
        F.sum("estimated_value_high").alias("deal_high"),
        F.count("*").alias("n_opportunities"),
        F.max((F.col("type") == "new_website_creation").cast("int")).alias("wants_website"),
    )


def data_completeness(has_tech: Column, has_stack: Column, has_audit: Column, has_signals: Column) -> Column:
    part = lambda cond, points: F.when(cond, points).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(part(has_tech, 0.35) + part(has_tech & has_stack, 0.15) + part(has_audit, 0.35) + part(has_signals, 0.15), 2))


def staleness(last: Column, as_of: Column) -> Column:
    """Struct (factor, recrawl) by whole days since the last crawl; null counts as fresh."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400)
    factor = F.when(days > 30, 0.7).when(days > 14, F.round(F.greatest(F.lit(0.7), 1.0 - (days - 14) * 0.02), 2)).otherwise(1.0)
    return F.struct(factor.alias("factor"), F.coalesce(days > 30, F.lit(False)).alias("recrawl"))


def priority_tier(score: Column, recrawl: Column) -> Column:
    return (
        F.when(recrawl & (score >= 75), "recrawl_review").when(score >= 90, "immediate").when(score >= 75, "high").when(score >= 60, "nurture").when(score >= 40, "low").otherwise("ignore")
    )


def detect_opportunities(pains: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """One opportunity per company with pains: the master offer for two or more or after a deep audit, else what the single pain sells.

    ``audited`` holds the ``company_id`` of deep audits. Pains that count for several pillars of evidence stand in each.
    """
    one = pains.groupBy("company_id").agg(
        F.count("*").alias("n_pains"),
        F.min_by("type", "position").alias("pain"),
        F.min_by("confidence", "position").alias("first_confidence"),
        F.min_by("severity", "position").alias("first_severity"),
        *(F.sort_array(F.collect_list(F.when(contains_any(F.col("type"), marks), F.col("type")))).alias(f"{name}_pillar") for name, marks in PILLARS.items()),
    )
    deep = F.lit(False)
    if audited is not None:
        one = one.join(audited.select("company_id", F.lit(True).alias("deep")).distinct(), "company_id", "left")
        deep = F.coalesce("deep", F.lit(False))
    many = (F.col("n_pains") >= 2) | deep
    pick = lambda i: F.when(many, F.lit(MASTER[i])).otherwise(lookup(F.col("pain"), {k: v[i] for k, v in CATALOG.items()}, MASTER[i])).alias(OFFER[i])
    confidence = F.when(many, 0.95).otherwise(F.col("first_confidence")).alias("confidence")
    offer = [confidence if name == "confidence" else pick(i) for i, name in enumerate(OFFER)]
    pillars = (F.when(many, F.col(f"{name}_pillar")).alias(f"{name}_pillar") for name in PILLARS)
    return one.select(
        "company_id", "n_pains", *offer, F.when(~many, F.col("first_severity")).alias("pain_severity"), *pillars, F.lit(PRICING_VERSION).alias("pricing_version"), F.lit(CURRENCY).alias("currency"), F.lit("detected").alias("status")
    )


def detect_pains(rows: DataFrame) -> DataFrame:
    """Long table of pains from one row per company of fingerprint and audit metrics; metrics that ``rows`` lacks count as not taken."""
    optional = {
        "missing_tel_link": "boolean", "broken_social": "boolean", "deliverability_risk": "boolean", "exposed_users": "boolean", "skills": "array<string>",
        "cert_checked": "boolean", "cert_valid": "boolean", "image_issues": "boolean",
    }
    rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in optional.items() if k not in rows.columns})
    c = F.col
    pain = lambda kind, severity, confidence: F.struct(*(x.alias(n) for n, x in zip(("type", "severity", "confidence"), (kind, severity, confidence), strict=True)))
    lit = lambda kind, severity, confidence: pain(F.lit(kind), F.lit(severity), F.lit(confidence))
    major = F.regexp_extract(F.coalesce("jquery_version", F.lit("")), "^([0-9]+)", 1).try_cast("int")
    legacy = F.when(c("jquery_version") == "", True).otherwise(F.coalesce(major < 3, F.lit(False)))
    wp = F.regexp_extract(F.coalesce("wp_version", F.lit("")), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    old = F.coalesce(wp < 6, F.lit(False))
    slow_subpage = F.coalesce("speed_discrepancy", F.lit(False))
    rules = [
        (c("jquery_version").isNotNull(), pain(F.lit("legacy_jquery"), F.when(legacy, "high").otherwise("medium"), F.when(legacy, 0.95).otherwise(0.85))),
        (c("angular_version").isNotNull(), lit("legacy_angularjs_eol", "critical", 0.95)),
        (
            F.contains(F.lower(F.coalesce("cms", F.lit(""))), F.lit("wordpress")) | c("wp_version").isNotNull(),
            pain(F.when(old, "outdated_wordpress").otherwise("wordpress_maintenance_debt"), F.when(old, "high").otherwise("medium"), F.when(old, 0.95).otherwise(0.85)),
        ),
        (~F.coalesce("https", F.lit(True)), lit("insecure_transport_http", "critical", 1.0)),
        (slow_subpage, lit("subpage_speed_discrepancy", "high", 0.95)),
        (~slow_subpage & (c("homepage_ms") > 3000), lit("slow_website_speed", "high", 0.90)),
        (c("ttfb_ms") > 1200, lit("slow_backend_ttfb", "medium", 0.85)),
        (c("missing_tel_link"), lit("missing_mobile_tel_link", "high", 0.95)),
        (c("max_form_inputs") >= 7, lit("high_form_friction", "medium", 0.85)),
        (~c("has_schema"), lit("missing_local_schema", "medium", 0.90)),
        (c("broken_social"), lit("broken_social_opengraph", "low", 0.85)),
        (c("deliverability_risk"), lit("dns_email_deliverability_risk", "high", 0.95)),
        (c("exposed_users"), lit("exposed_cms_security_risk", "critical", 1.0)),
        (F.size(F.coalesce("skills", F.array().cast("array<string>"))) > 0, lit("hiring_capacity_bottleneck", "high", 0.90)),
        (c("cert_days") < 30, pain(F.lit("ssl_cert_expiring_soon"), F.when(c("cert_days") < 14, "critical").otherwise("high"), F.lit(1.0))),
        (~F.coalesce(c("cert_days") < 30, F.lit(False)) & c("cert_checked") & ~F.coalesce("cert_valid", F.lit(False)), lit("ssl_cert_invalid", "critical", 0.95)),
        (c("broken_links") > 0, pain(F.lit("broken_internal_links"), F.when(c("broken_links") >= 3, "high").otherwise("medium"), F.lit(1.0))),
        (c("image_issues"), lit("unoptimized_images", "medium", 0.90)),
        (c("lighthouse_score") < 70, pain(F.lit("poor_lighthouse_score"), F.when(c("lighthouse_score") < 50, "high").otherwise("medium"), F.lit(1.0))),
    ]
    found = F.array_compact(F.array(*(F.when(cond, p) for cond, p in rules)))
    return rows.select("company_id", F.posexplode(found).alias("position", "p")).select("company_id", "position", "p.*")


def score_companies(companies: DataFrame, tech: DataFrame, audits: DataFrame, signals: DataFrame, pains: DataFrame, opportunities: DataFrame, as_of: Column, contacts: DataFrame | None = None) -> DataFrame:
    """One scored row per company: every child table is reduced to a row per company before its join. Contacts count where they are given."""
    gap = tech.select("company_id", technology_gap().alias("technology_gap"), ((F.size(F.coalesce("frontend", F.array().cast("array<string>"))) > 0)).alias("has_stack"), F.lit(True).alias("has_tech"))
    audit = audits.groupBy("company_id").agg(F.max(((F.coalesce("ttfb_ms", F.lit(0)) > 0) | (F.coalesce("performance_score", F.lit(0)) > 0)).cast("int")).alias("has_audit"))
    failed = signals.groupBy("company_id").agg(
        F.max(F.col("type").isin("crawl_audit_failed", "site_unreachable").cast("int")).alias("failed"), F.max((F.col("type") == "missing_website").cast("int")).alias("missing_site"), F.lit(True).alias("has_signals")
    )
    rows = company_fit(companies).withColumnRenamed("id", "company_id")
    children = [] if contacts is None else [contacts.groupBy("company_id").agg(F.count("*").alias("n_contacts"))]
    for child in (*children, gap, audit, failed, pain_signal(pains), buying_signal(signals), service_fit(opportunities)):
        rows = rows.join(child, "company_id", "left")
    rows = rows if children else rows.withColumn("n_contacts", F.lit(0))
    c, yes = F.col, lambda name: F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    rows = rows.fillna({"technology_gap": 0.0, "pain_signal": 0.0, "buying_signal": 20.0, "service_fit": 20.0, "deal_low": 0, "deal_high": 0, "n_opportunities": 0})
    rows = rows.withColumn("contact_quality", contact_quality()).withColumn("stale", staleness(c("last_crawled_at"), as_of))
    rows = rows.withColumn("data_completeness", data_completeness(yes("has_tech"), yes("has_stack"), yes("has_audit"), yes("has_signals")))
    rows = rows.withColumn("needs_recrawl", c("stale.recrawl") | ((c("data_completeness") < 0.35) & (c("company_fit") >= 70)))
    rows = rows.withColumn(
        "no_website", (F.coalesce("website_url", F.lit("")) == "") | F.coalesce(c("domain").endswith(".local"), F.lit(False)) | yes("missing_site") | yes("wants_website")
    )
    base = c("company_fit") * 0.25 + c("pain_signal") * 0.30 + c("technology_gap") * 0.20 + c("contact_quality") * 0.15 + c("service_fit") * 0.10
    bonus = F.when(c("buying_signal") > 25, F.least(F.lit(20.0), F.round((c("buying_signal") - 25.0) / 3.75, 2))).otherwise(0.0)
    raw = F.least(F.lit(100.0), F.round(F.round(base + bonus, 6), 2))
    raw = F.when((c("company_fit") >= 70) & (c("pain_signal") >= 35), F.greatest(F.lit(45.0), raw)).otherwise(raw)
    uncrawled = ~c("no_website") & c("last_crawled_at").isNull() & ~yes("has_tech") & c("has_audit").isNull()
    score = F.when(yes("failed") | c("uncrawled"), 0.0).when(c("no_website"), 100.0).otherwise(F.round(F.round(clamp(c("raw") * c("stale.factor")), 6), 2))
    tier = F.when(yes("failed"), "disqualified").when(c("uncrawled"), "pending_audit").when(c("no_website"), "immediate").otherwise(priority_tier(c("opportunity_score"), c("needs_recrawl")))
    empty = c("no_website") & (c("deal_high") == 0)
    rows = rows.withColumns({"raw": raw, "uncrawled": uncrawled}).withColumn("opportunity_score", score).withColumn("priority_tier", tier)
    names = ["company_id", "company_fit", "technology_gap", "pain_signal", "buying_signal", "contact_quality", "service_fit", "data_completeness", "needs_recrawl", "opportunity_score", "priority_tier"]
    return rows.select(*names, F.when(empty, 2500).otherwise(c("deal_low")).cast("long").alias("deal_low"), F.when(empty, 5000).otherwise(c("deal_high")).cast("long").alias("deal_high"))


def prune_low_scores(scores: DataFrame, minimum: float = 40.0) -> DataFrame:
    """All scores of a company that has a score under the minimum in an active tier get the tier ``ignore``."""
    low = scores.where((F.col("opportunity_score") < minimum) & ~F.col("priority_tier").isin("ignore", "disqualified")).select("company_id", F.lit(True).alias("low")).distinct()
    return scores.join(low, "company_id", "left").withColumn("priority_tier", F.when(F.col("low"), "ignore").otherwise(F.col("priority_tier"))).drop("low")
