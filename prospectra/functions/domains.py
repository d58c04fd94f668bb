"""Column functions that judge domains, industries and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_any, first_keyword

# fixed values: directory, social, job, search and media sites
AGGREGATORS = [
    "localsearch.com", "localsearch.com.au", "yellowpages.com", "yellowpages.com.au", "whitepages.com", "whitepages.com.au", "yelp.com", "yelp.com.au", "truelocal.com.au", "hotfrog.com.au",
    "hotfrog.com", "womo.com.au", "dnb.com", "zoominfo.com", "bloomberg.com", "crunchbase.com", "bbb.org", "tripadvisor.com", "tripadvisor.com.au", "clutch.co", "bark.com", "checkatrade.com",
    "angi.com", "thumbtack.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "upwork.com", "fiverr.com",
    "freelancer.com", "indeed.com", "seek.com.au", "google.com", "google.com.au", "bing.com", "yahoo.com", "wikipedia.org", "dailymail.com", "dailymail.co.uk", "mailonsunday.co.uk",
    "outfit7.com", "talkingtomandfriends.com", "privo.com", "nytimes.com", "bbc.com", "cnn.com", "forbes.com", "reuters.com", "theguardian.com", "foxnews.com", "usatoday.com", "wsj.com",
    "washingtonpost.com",
]
# fixed values: failures that a later attempt cannot mend
PERMANENT_STATUS = [400, 401, 403, 404, 405, 410, 451]
PERMANENT_ERRORS = ["nodename nor servname", "name or service not known", "nxdomain", "could not resolve host", "dns_probe_finished_nxdomain", "err_name_not_resolved"]
# fixed values: words of software vendors
AGENCY_WORDS = [
    "agency", "agencies", "software company", "software development", "web development", "web design company", "dev shop", "dev studio", "digital agency",
    "creative agency", "it services", "it solutions", "staff augmentation", "software consultancy", "app developers", "software house", "tech studio", "custom software agency",
]
# fixed values: words of each industry, in order of precedence
INDUSTRIES = {
    "E-Commerce & Online Stores": ["e-commerce", "ecommerce", "online store", "shopify", "woocommerce", "marketplace", "d2c", "retail", "fashion", "apparel", "products", "cart"],
    "Real Estate & PropTech": ["real estate", "property management", "realtor", "mls", "idx", "listing platform", "proptech", "brokerage", "apartments", "leasing"],
    "Food & Hospitality": ["restaurant", "food delivery", "menu", "pos", "food ordering", "catering", "hospitality", "dining", "bar", "cafe"],
    "Healthcare & Life Sciences": ["healthcare", "medical", "clinic", "dental", "doctor", "health", "patient", "biotech", "pharma", "therapy", "wellness", "hospital"],
    "FinTech & Financial Services": ["fintech", "finance", "banking", "lending", "credit", "investment", "wealth", "insurance", "payments", "accounting", "tax"],
    "Logistics & Supply Chain": ["logistics", "freight", "transport", "warehouse", "shipping", "supply chain", "fleet", "trucking", "delivery"],
    "B2B SaaS & Tech Services": ["saas", "software platform", "b2b platform", "cloud platform", "crm", "erp"],
}
DEFAULT_INDUSTRY = "Custom Business Application"
# fixed values: mail providers by parts of their mail hosts, in order of precedence
MAIL_PROVIDERS = [
    ("google_workspace", ["google", "googlemail", "l.google.com"]),
    ("microsoft_365", ["outlook.com", "protection.outlook", "microsoft"]),
    ("proofpoint", ["pphosted.com", "proofpoint"]),
    ("mimecast", ["mimecast"]),
    ("zoho", ["zoho"]),
    ("protonmail", ["proton"]),
    ("yahoo", ["yahoodns", "yahoo.com"]),
    ("barracuda", ["barracudanetworks"]),
]


def is_excluded_domain(domain: Column) -> Column:
    """Struct (excluded, reason): empty, internal, or an aggregator or one of its subdomains."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), ":.*$", ""), "^/+|/+$", "")
    labels = F.split(d, r"\.")
    # the aggregator roots have two or three labels
    tail = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), "."))
    root = F.coalesce(*(F.when(tail(n).isin(AGGREGATORS), tail(n)) for n in (2, 3)))
    reason = (
        F.when(F.coalesce(domain, F.lit("")) == "", "empty_domain")
        .when(d.rlike(r"\.(local|internal|localhost)$"), "internal_test_domain")
        .when(root.isNotNull(), F.concat(F.lit("directory_aggregator_"), root))
        .otherwise("")
    )
    return F.struct((reason != "").alias("excluded"), reason.alias("reason"))


def is_retryable_failure(status: Column, error: Column) -> Column:
    """Whether a failed fetch may succeed later, by status code and error text."""
    permanent = F.coalesce(status.isin(PERMANENT_STATUS), F.lit(False)) | contains_any(F.lower(F.coalesce(error, F.lit(""))), PERMANENT_ERRORS)
    return ~permanent


def is_agency(name: Column, domain: Column, industry: Column) -> Column:
    """Whether name, domain or industry has a word of a software vendor."""
    return contains_any(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (name, domain, industry)))), AGENCY_WORDS)


def classify_industry(text: Column, default: str | None = DEFAULT_INDUSTRY) -> Column:
    """First industry with a keyword in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(contains_any(t, words), F.lit(label)) for label, words in INDUSTRIES.items()), F.lit(default))


def is_disposable_email(rows: DataFrame, domains: DataFrame, email: str = "email") -> DataFrame:
    """Add ``disposable``: whether the address is of a throw-away domain, by a table of them."""
    table = domains.select(F.lower("domain").alias("__domain"), F.lit(True).alias("__hit")).distinct()
    found = rows.withColumn("__domain", F.regexp_extract(F.lower(F.coalesce(email, F.lit(""))), "@(.*)$", 1)).join(table, "__domain", "left")
    return found.withColumn("disposable", F.coalesce("__hit", F.lit(False))).drop("__domain", "__hit")


def mail_provider(mx_host: Column) -> Column:
    """Provider that runs a mail host."""
    host = F.lower(F.coalesce(mx_host, F.lit("")))
    return F.coalesce(*(F.when(contains_any(host, parts), F.lit(name)) for name, parts in MAIL_PROVIDERS), F.lit("custom_smtp"))


def validate_email_syntax(email: Column) -> Column:
    """Name of the first syntax rule that an address breaks, null if it breaks none."""
    e = F.trim(F.coalesce(email, F.lit("")))
    parts = F.split(e, "@")
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    labels = F.split(domain, r"\.")
    tld = F.get(labels, F.size(labels) - 1)
    rules = [
        (e == "", "empty"),
        (F.length(e) > 254, "too_long"),
        (F.size(parts) < 2, "no_at"),
        (F.size(parts) > 2, "several_at"),
        (local == "", "no_local"),
        (F.length(local) > 64, "local_too_long"),
        (local.startswith(".") | local.endswith("."), "local_edge_dot"),
        (F.contains(local, F.lit("..")), "local_dots"),
        (domain == "", "no_domain"),
        (F.length(domain) > 253, "domain_too_long"),
        (domain.startswith(".") | domain.endswith("."), "domain_edge_dot"),
        (F.contains(domain, F.lit("..")), "domain_dots"),
        (F.size(labels) < 2, "no_tld"),
        (F.exists(labels, lambda x: F.length(x) > 63), "label_too_long"),
        (F.exists(labels, lambda x: x.startswith("-") | x.endswith("-")), "label_edge_hyphen"),
        (F.length(tld) < 2, "tld_too_short"),
        (~(tld.rlike("^[a-zA-Z]+$") | tld.startswith("xn--")), "tld_invalid"),
        (~e.rlike(r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(\.[a-zA-Z0-9-]+)+$"), "syntax"),
    ]
    return F.coalesce(*(F.when(cond, F.lit(name)) for cond, name in rules))


def disqualifier(industry: Column, name: Column, domain: Column, rules: dict[str, list[str]], targets: list[str]) -> Column:
    """Reason why a company is a supplier and no buyer: industry keyword, then a name word unless it is a target, then domain pattern."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    industry, name, domain = clean(industry), clean(name), clean(domain)
    words = F.regexp_extract_all(name, F.lit(rf"\b({'|'.join(rules['name'])})\b"), F.lit(1))
    by_name = F.get(F.filter(F.array(*map(F.lit, rules["name"])), lambda k: F.array_contains(words, k)), F.lit(0))
    by_domain = F.coalesce(*(F.when(domain.rlike(f"(?i){p}"), F.lit(p)) for p in rules["domain"]))
    return F.coalesce(
        F.concat(F.lit("industry_keyword:"), first_keyword(industry, rules["industry"])),
        F.when(~contains_any(industry, targets), F.concat(F.lit("name_keyword:"), by_name)),
        F.concat(F.lit("domain_pattern:"), by_domain),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
