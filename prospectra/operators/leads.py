"""Lead flow: gates, worklists, context joins, updates and resolution as joins and conditionals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions.text import contains_any

from .relational import first_by, latest_by, top_per_key

# fixed values: blocked and public parts of lead addresses
BLOCKED_PREFIXES = ["xxx", "test", "sample", "dummy", "exam", "noreply", "no-reply", "donotreply", "mailer-daemon", "postmaster", "root", "security", "abuse", "privacy", "terms", "admin", "webmaster"]
BLOCKED_PARTS = [
    ".local", ".localhost", ".internal", ".lan", ".corp", ".home", ".test", ".example", ".invalid", ".gov", ".mil", ".edu", ".ac.uk", ".gov.sg", ".edu.sg", ".org.sg", ".sg",
    ".fi", ".co.nz", ".com.hk", ".com.au", ".ru", ".cn", ".gov.", ".gob.", ".in", ".co.in", ".org.in", ".gov.in",
]
PUBLIC_PROVIDERS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "icloud.com", "msn.com", "live.com", "comcast.net", "sbcglobal.net", "att.net", "verizon.net", "bellsouth.net",
    "cox.net", "charter.net", "zoho.com", "protonmail.com", "me.com", "mac.com", "ymail.com", "rocketmail.com", "earthlink.net", "roadrunner.com", "windstream.net", "frontier.com",
]
BLOCKED_DOMAINS = [
    "example.com", "domain.com", "email.com", "yourcompany.com", "company.com", "sentry.io", "wix.com", "wixpress.com", "wordpress.org", "schema.org", "cloudflare.com", "github.com",
    "webcontainer-api.io", "realtor.com", "move.com", "cpadirectory.com", "yellowpages.com", "whitepages.com", "yelp.com", "angi.com", "angieslist.com", "thumbtack.com", "houzz.com",
    "homeadvisor.com", "bbb.org", "tripadvisor.com", "manta.com", "dnb.com", "zoominfo.com", "allbiz.com", "leadiq.com", "bumvar.com", "6bestrated.com", "citysquares.com", "breken.com",
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "google.com", "bing.com", "duckduckgo.com", "qq.com", "163.com",
    "126.com", "sina.com", "angelone.in", "remax.com", "wxxi.org", "rs-event.sg", "digitalrealty.com",
]
BRAND_STOP_WORDS = [
    "the", "and", "inc", "llc", "corp", "co", "ltd", "company", "group", "services", "specialists", "associates", "pc", "pa", "management", "auto", "care", "repair", "clinic", "center",
    "contractors", "law", "firm", "office", "dentistry", "plumbing", "roofing",
]
# fixed values: titles of roles, in order of precedence
ROLE_TITLES = [("founder", r"(founder|owner|ceo|chief executive)"), ("technology", r"(cto|vp engineering|head of engineering|technical)"), ("marketing", r"(cmo|marketing|growth)"), ("operations", r"(coo|operations)")]
# fixed values: words of role classes by where the title or local part comes from, in order of precedence
ROLE_WORDS = {
    "people_search": [("technical_executive", ["cto", "engineering", "technical", "developer"]), ("founder", ["founder", "ceo", "president"]), ("product_lead", ["product", "design"])],
    "domain_search": [
        ("technical_executive", ["cto", "technology", "engineering", "technical", "developer", "architect", "software"]), ("founder", ["founder", "ceo", "president", "owner"]), ("product_lead", ["product", "design"]),
    ],
    "page": [("founder", ["founder", "ceo", "director", "partner"]), ("technical_executive", ["tech", "dev", "engineering", "cto"])],
}
# fixed values: states by their codes
STATES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm",
    "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy",
]
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def brand_tokens(name: Column, stop_words: list[str] = BRAND_STOP_WORDS) -> Column:
    """Words of three letters or more of a business name that tell it from others."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9_\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop_words))


def brand_token_match(tokens: Column, domain: Column) -> Column:
    """How many of the tokens stand in the first label of a domain."""
    stem = F.regexp_extract(F.lower(domain), r"^([^.]*)", 1)
    return F.size(F.filter(tokens, lambda t: F.contains(stem, t)))


def lead_email_gate(email: Column, company_domain: Column, company_name: Column | None = None, no_website: Column | None = None, disposable: Column | None = None) -> Column:
    """Why an address may not be used for a lead, or as what it may: ordered tests, first match wins.

    ``disposable`` says whether its domain is a throw-away one (a join with a table of them). Without a website of its
    own, a company's custom domain must share a brand token with its name: hold or begin one, or be held by one.
    """
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    prefix, domain = F.regexp_extract(e, "^([^@]*)@", 1), F.regexp_extract(e, "@(.*)$", 1)
    own = F.lower(F.coalesce(company_domain, F.lit("")))
    without = (F.lit(False) if no_website is None else F.coalesce(no_website, F.lit(False))) | (own == "") | own.endswith(".local")
    stem, tokens = F.regexp_extract(domain, r"^([^.]*)", 1), brand_tokens(F.lit("") if company_name is None else company_name)
    fits = lambda t: F.contains(stem, t) | ((F.length(stem) >= 4) & F.contains(t, stem)) | ((F.length(stem) >= 3) & t.startswith(F.substring(stem, 1, 3)))
    return (
        F.when(~F.contains(e, F.lit("@")), "missing_or_malformed")
        .when(~e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), "invalid_email_regex")
        .when((F.length(prefix) < 2) | prefix.isin(BLOCKED_PREFIXES) | prefix.startswith("helpdesk"), "blocked_prefix")
        .when(domain.isin(BLOCKED_DOMAINS), "blocked_domain")
        .when(F.lit(False) if disposable is None else F.coalesce(disposable, F.lit(False)), "disposable_domain")
        .when(contains_any(domain, BLOCKED_PARTS), "blocked_tld_or_government")
        .when(domain.isin(PUBLIC_PROVIDERS), "valid_common_provider")
        .when(~own.endswith(".local") & (domain == F.regexp_extract(F.regexp_replace(own, r"https?://|www\.", ""), "^([^/]*)", 1)), "valid_company_domain")
        .when(without & (F.size(tokens) > 0) & ~F.exists(tokens, fits), "custom_domain_mismatch")
        .otherwise("valid_custom_domain")
    )


def role_category(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(p), F.lit(n)) for n, p in ROLE_TITLES), F.lit("other"))


def role_class(text: Column, origin: str) -> Column:
    """Class of a role by the words of a title, or of the local part of an address for ``page``; ``general`` for any other."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(contains_any(t, words), F.lit(name)) for name, words in ROLE_WORDS[origin]), F.lit("general"))


def display_company_name(name: Column) -> Column:
    """A raw domain as a name: without its ending, hyphens as spaces, capitalised."""
    ending = r"(?i)\.(com|org|net|io|ai|co|agency|digital|tech|us|uk|de|ca|dev)$"
    return F.when(name.rlike(ending), F.initcap(F.replace(F.regexp_replace(name, ending, ""), F.lit("-"), F.lit(" ")))).otherwise(name)


def greeting_name(first: Column, company: Column) -> Column:
    bot = F.lower(F.trim(first))
    bad = first.isNull() | (bot == "") | F.contains(bot, F.lit("@")) | bot.rlike(r"\.(com|net|org|io|ai|co|agency)") | bot.isin("team", "info", "contact", "support", "admin", "sales", "hello", "hi", "careers", "office")
    return F.when(~bad, first).when(F.coalesce(company, F.lit("")) != "", F.concat(company, F.lit(" team"))).otherwise("there")


def copy_segment(rows: DataFrame) -> DataFrame:
    """Segment by verified evidence alone; null means no message."""
    cms = F.lower(F.coalesce("cms", F.lit("")))
    return rows.withColumn(
        "segment",
        F.when(F.contains(cms, F.lit("wordpress")) | F.contains(cms, F.lit("php")), "laravel_modernization")
        .when(F.col("library").isNotNull(), "frontend_modernization")
        .when(F.col("lcp_ms") > 2500, "speed_optimization")
        .when(cms != "", "laravel_modernization"),
    )


def audit_worklist(companies: DataFrame, audits: DataFrame, excluded: Column, as_of: Column, days: int = 7) -> DataFrame:
    """Companies with a site that were never crawled, have no audit, or were crawled too long ago."""
    audited = audits.select(F.col("company_id").alias("id")).distinct().withColumn("audited", F.lit(True))
    due = F.col("last_crawled_at").isNull() | F.col("audited").isNull() | (F.col("last_crawled_at") < as_of - F.make_interval(days=F.lit(days)))
    return companies.where(F.col("website_url").isNotNull() & ~excluded).join(audited, "id", "left").where(due).drop("audited")


def attach_bounce_context(bounces: DataFrame, contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """Contact and company by address; message by thread, the first one of a repeated id, else the latest one to the address."""
    by_mail = first_by(contacts.select(F.lower("email").alias("email"), F.col("id").alias("contact_id"), "company_id"), "email", "contact_id")
    latest = latest_by(messages.select(F.lower("email").alias("email"), F.col("id").alias("latest_id")), "email", "latest_id")
    thread = messages.groupBy(F.col("message_id").alias("in_reply_to")).agg(F.min("id").alias("thread_id"))
    rows = bounces.withColumn("email", F.lower("email")).join(by_mail, "email", "left").join(latest, "email", "left").join(thread, "in_reply_to", "left")
    return rows.withColumn("message", F.coalesce("thread_id", "latest_id")).drop("thread_id", "latest_id")


def apply_suppression(contacts: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Contacts of suppressed addresses become ``bounced``."""
    flag = suppressed.select(F.lower("email").alias("key")).distinct().withColumn("hit", F.lit(True))
    rows = contacts.join(flag, F.lower("email") == F.col("key"), "left")
    return rows.withColumn("email_status", F.when(F.col("hit"), "bounced").otherwise(F.col("email_status"))).drop("key", "hit")


def apply_reply_intent(opportunities: DataFrame, replies: DataFrame) -> DataFrame:
    """Status of opportunities after the latest reply of their company; converted ones keep theirs."""
    latest = latest_by(replies.select("company_id", "id", "intent"), "company_id", "id").select("company_id", "intent")
    status = F.when(F.col("status") == "converted", F.col("status")).when(F.col("intent") == "positive_interest", "in_discussion").when(F.col("intent") == "not_interested", "closed_lost").otherwise(F.col("status"))
    return opportunities.join(latest, "company_id", "left").withColumn("status", status).drop("intent")


def repoint_domain(companies: DataFrame, changes: DataFrame) -> DataFrame:
    """New domain of a company unless another row owns it; the URL changes in any case."""
    taken = companies.select(F.col("domain").alias("new_domain"), F.col("id").alias("owner"))
    taken = taken.groupBy("new_domain").agg(F.min("owner").alias("owner"))
    rows = companies.join(changes, "id", "left").join(taken, "new_domain", "left")
    free = F.col("new_domain").isNotNull() & (F.col("owner").isNull() | (F.col("owner") == F.col("id")))
    return rows.withColumn("domain", F.when(free, F.col("new_domain")).otherwise(F.col("domain"))).withColumn("website_url", F.coalesce("new_url", "website_url")).drop("new_domain", "new_url", "owner")


def patch_columns(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns set by key where the patch has a value."""
    p = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return rows.join(p, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def discovery_yield(rows: DataFrame, target: int) -> DataFrame:
    """Accepted rows per source until the target is reached in page order, by running counts."""
    per = rows.groupBy("source", "page").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < target).groupBy("source").agg(F.sum("n").alias("accepted"), F.count("*").alias("pages"))


def top_findings(pains: DataFrame, n: int = 6) -> DataFrame:
    rank = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY_RANK.items()), F.lit(9))
    return top_per_key(pains, "company_id", [rank, F.col("position")], n)


def query_matrix(categories: DataFrame, cities: DataFrame, pointer: int, batch: int) -> DataFrame:
    """The batch of category and city combinations that follows a pointer, around the end.

    Both inputs are short lists of settings; their product is the feature.
    """
    grid = categories.crossJoin(cities).withColumn("at", F.row_number().over(Window.orderBy("category", "city")) - 1)
    total = F.count("*").over(Window.partitionBy())
    return grid.withColumn("total", total).where(F.pmod(F.col("at") - pointer, F.col("total")) < batch).drop("total")


def stage_run_status(processed: Column, failed: Column) -> Column:
    return F.when((failed > 0) & (processed == 0), "failed").when(failed > 0, "partial").otherwise("success")


def mail_dns_metrics(records: DataFrame) -> DataFrame:
    """Mail records of each domain and whether its mail may be taken for spam."""
    has = lambda cond: F.max(cond.cast("int")) == 1
    kind, value = F.col("kind"), F.lower("value")
    out = records.groupBy("domain").agg(has(kind == "MX").alias("has_mx"), has((kind == "TXT") & value.startswith("v=spf1")).alias("has_spf"), has((kind == "TXT") & value.startswith("v=dmarc1")).alias("has_dmarc"))
    return out.withColumn("risk", F.col("has_mx") & ~(F.col("has_spf") & F.col("has_dmarc")))


def page_contacts(pages: DataFrame, domain: Column, emails: Column, n: int | None = 3) -> DataFrame:
    """First ``n`` addresses of each page, or all for None: own domain first, then inboxes, then as they stand."""
    rows = pages.select("page_id", domain.alias("domain"), F.posexplode(emails).alias("position", "email"))
    points = F.when(F.col("email").endswith(F.concat(F.lit("@"), "domain")), 10).otherwise(0) + F.when(F.col("email").rlike("^(info|contact|hello|office|sales)@"), 5).otherwise(0)
    return top_per_key(rows.withColumn("points", points), "page_id", [F.desc("points"), F.col("position")], n).drop("position")


def lead_resolution(rows: DataFrame) -> DataFrame:
    """Domain by priority of sources; companies without any get a stand-in and full score."""
    found = F.coalesce("bureau_domain", "registry_domain", "social_domain", "footprint_domain")
    return rows.withColumn("resolved_domain", F.coalesce(found, F.concat("slug", F.lit(".local")))).withColumn("outcome", F.when(found.isNotNull(), "resolved_real_domain").otherwise("no_website_verified")).withColumn(
        "score", F.when(found.isNull(), 100.0)
    )
