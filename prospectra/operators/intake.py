"""Intake: feeds of candidates, listings and posts become companies, signals, offers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions.domains import classify_industry, is_agency
from prospectra.functions.extract import extract_client_spend, infer_employer_domain
from prospectra.functions.text import extract_budget, normalize_company_name, normalize_domain, slugify

from .relational import first_by, greedy_two_keys, latest_by, merge_snapshot
from .textjoin import contained

# fixed values: default industry of each directory, and names that hide a registrant
DIRECTORY_INDUSTRY = {"clutch": "Software & Web Development", "goodfirms": "Software & Web Development", "yelp": "Commercial Business & Services"}
LOCAL_INDUSTRY = "Local Business & Services"
PRIVACY_WORDS = ["privacy", "proxy", "whoisguard", "redacted", "withheld", "domainsbyproxy", "superprivacy", "contactprivacy", "identityprotect", "anonymouse", "cloudflareregistrar", "abuse@"]
# fixed values: industry and confidence of a posting whose feed gives none
POSTING_INDUSTRY, POSTING_CONFIDENCE = "Commercial Web & Software Applications", 60.0
NEW_WEBSITE = ("new_website_creation", "Turnkey High-Converting Web & Online Booking Portal", 2500, 5000, 1.0)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def normalize_directory_entries(entries: DataFrame, source: str) -> DataFrame:
    """Entries of a directory (``name``, ``domain``, ``website_url``, ``industry``, ``employees``) as candidates."""
    url = F.coalesce(F.nullif("website_url", F.lit("")), F.nullif("domain", F.lit("")), F.lit(""))
    domain = normalize_domain(url)
    return entries.select(
        "id", F.coalesce(F.nullif("name", F.lit("")), domain).alias("name"), domain.alias("domain"), url.alias("website_url"), F.lit(source).alias("source"),
        F.coalesce("industry", F.lit(DIRECTORY_INDUSTRY[source])).alias("industry"), "employees",
    )


def normalize_local_listings(listings: DataFrame) -> DataFrame:
    """Local listings (``categories`` an array) as candidates; one without a website gets a stand-in domain of name and city."""
    name, city, url = _blank("name"), _blank("city"), _blank("website_url")
    has = (url != "") & (url != "None")
    slug = lambda c, other: F.coalesce(F.nullif(slugify(c), F.lit("")), F.lit(other))
    domain = F.when(has, normalize_domain(url)).otherwise(F.concat(slug(name, "business"), F.lit("-"), slug(city, "us"), F.lit(".local")))
    category = F.initcap(F.replace(F.get("categories", F.lit(0)), F.lit("_"), F.lit(" ")))
    return listings.select(
        "id", F.coalesce(F.nullif(name, F.lit("")), domain).alias("name"), domain.alias("domain"), F.when(has, F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))).alias("website_url"),
        has.alias("has_website"), F.lit("google_maps").alias("source"), F.coalesce(category, F.lit(LOCAL_INDUSTRY)).alias("industry"), city.alias("city"), _blank("phone").alias("phone"), "rating", "review_count",
    )


def flatten_registry_contacts(payloads: DataFrame) -> DataFrame:
    """Contacts of registry answers (``domain``, ``payload`` JSON text); rows that hide the registrant are left out."""
    entity = "struct<roles:array<string>,vcardArray:array<string>>"
    rows = payloads.select("domain", F.explode(F.from_json("payload", f"entities array<{entity}>")["entities"]).alias("e"))
    fields = F.from_json(F.get("e.vcardArray", F.lit(1)), "array<array<string>>")
    value = lambda kind: F.get(F.get(F.filter(fields, lambda f: F.get(f, F.lit(0)) == kind), F.lit(0)), F.lit(3))
    hidden = lambda c: F.exists(F.array(*map(F.lit, PRIVACY_WORDS)), lambda w: F.contains(F.lower(c), w))
    rows = rows.select("domain", F.col("e.roles").alias("roles"), F.trim(value("fn")).alias("fn"), F.lower(F.trim(value("email"))).alias("email")).where(F.coalesce(F.col("email"), F.lit("")) != "").where(~hidden(F.col("email")))
    admin = F.concat(F.initcap(F.regexp_extract("domain", r"^([^.]*)", 1)), F.lit(" Admin"))
    name = F.when((F.coalesce("fn", F.lit("")) != "") & ~hidden(F.col("fn")), F.col("fn")).otherwise(admin)
    title = F.when(F.size("roles") > 0, F.initcap(F.array_join("roles", " / "))).otherwise("Domain Administrator")
    return rows.select("domain", name.alias("full_name"), "email", title.alias("title"), F.lit(80.0).alias("email_score"))


def seen_keys(companies: DataFrame) -> DataFrame:
    """Keys of companies that are known: ``kind`` (domain or name) and ``key``."""
    domains = companies.select(F.lit("domain").alias("kind"), normalize_domain(F.col("domain")).alias("key"))
    return domains.unionByName(companies.select(F.lit("name").alias("kind"), normalize_company_name(F.col("name")).alias("key"))).where("key <> ''").distinct()


def ingest_candidates(candidates: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New companies and their review signals.

    A candidate (``id``, ``name``, ``domain``, ``website_url``, ``industry``, ``source``, ``summary``) falls out without a
    domain, as an agency, and if its domain or name is known or was accepted before it; names without letters don't count.
    """
    domain = normalize_domain(F.coalesce(F.nullif("domain", F.lit("")), "website_url"))
    slug = normalize_company_name(F.col("name"))
    rows = candidates.withColumn("domain", domain).withColumn("slug", F.when(slug == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(slug))
    rows = rows.where(F.contains(F.coalesce("domain", F.lit("")), F.lit("."))).where(~is_agency(F.col("name"), F.col("domain"), F.col("industry")))
    known = seen_keys(companies)
    for column, kind in (("domain", "domain"), ("slug", "name")):
        rows = rows.join(known.where(F.col("kind") == kind).select(F.col("key").alias(column)), column, "left_anti")
    taken = greedy_two_keys(rows, "domain", "slug", "id").drop("slug")
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("name", "industry", "summary")))
    kind = classify_industry(text, default=None)
    taken = taken.withColumn("industry", F.coalesce(kind, F.nullif("industry", F.lit("")), F.lit("Commercial Business & Services")))
    reviewed = F.contains("source", F.lit("client")) | F.contains("source", F.lit("review"))
    signals = taken.where(reviewed).select("domain", F.lit("directory_client_review").alias("type"), F.lit(90.0).alias("confidence"), F.coalesce("summary", F.lit("Verified client review case study")).alias("detail"))
    return taken, signals


def ingest_listings(listings: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """Normalised listings as new ``companies`` by domain and by name within a city; those without a website get a ``signals``, an ``opportunities`` and a full ``scores`` row, the others wait for their audit."""
    place = lambda name, city: F.concat_ws(":", normalize_company_name(name), slugify(city))
    known = companies.select(normalize_domain(F.col("domain")).alias("domain"), place(F.col("name"), F.col("city")).alias("slug"))
    rows = listings.withColumn("slug", place(F.col("name"), F.col("city")))
    for key in ("domain", "slug"):
        rows = rows.join(known.select(key).distinct(), key, "left_anti")
    taken = greedy_two_keys(rows, "domain", "slug", "id").drop("slug")
    bare = taken.where(~F.col("has_website"))
    kind, service, low, high, confidence = NEW_WEBSITE
    full = F.when(F.col("has_website"), 0.0).otherwise(100.0)
    return {
        "companies": taken,
        "signals": bare.select("domain", F.lit("missing_website").alias("type"), "rating", "review_count", "phone"),
        "opportunities": bare.select("domain", *(F.lit(v).alias(k) for k, v in (("type", kind), ("recommended_service", service), ("estimated_value_low", low), ("estimated_value_high", high), ("confidence", confidence)))),
        "scores": taken.select("domain", full.alias("opportunity_score"), F.when(F.col("has_website"), "pending_audit").otherwise("immediate").alias("priority_tier")),
    }


def ingest_postings(postings: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New companies from job postings, and one hiring signal for each.

    A posting (``id``, ``company_name``, ``domain``, ``job_title``, ``summary``, ``source``, ``job_url``, ``confidence``,
    ``default_industry``) is classified by its company, title and text and goes through ``ingest_candidates``; later postings of a
    company that was just taken, and those of known companies and agencies, give nothing.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws(" ", filled("company_name"), filled("job_title"), filled("summary"))
    industry = F.coalesce(classify_industry(text, default=None), F.coalesce("default_industry", F.lit(POSTING_INDUSTRY)))
    project = F.concat(F.lit("Hiring: "), filled("job_title"), F.lit(" - "), F.substring(filled("summary"), 1, 150))
    candidates = postings.select(
        "id", F.col("company_name").alias("name"), "domain", F.concat(F.lit("https://"), "domain").alias("website_url"), industry.alias("industry"), "source", project.alias("summary"), "job_title", F.col("summary").alias("snippet"),
        F.coalesce(F.nullif("job_url", F.lit("")), F.concat(F.lit("https://"), "domain")).alias("job_url"), F.coalesce("confidence", F.lit(POSTING_CONFIDENCE)).alias("confidence"),
    )
    taken, _ = ingest_candidates(candidates, companies)
    signal = taken.select("domain", F.lit("active_hiring_intent").alias("type"), "confidence", "job_title", F.substring(F.coalesce("snippet", F.lit("")), 1, 250).alias("snippet"), "job_url", F.lit("engineering_capacity_shortage").alias("intent_type"))
    return taken.drop("job_title", "snippet", "job_url", "confidence"), signal


def ingest_freelance_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts (``id``, ``title``, ``company``, ``description``, ``keyword``) as companies, one a domain with the latest project, and a signal for each post."""
    budget, spend = extract_budget(F.col("description")), extract_client_spend(F.col("description"))
    rows = posts.withColumn("domain", infer_employer_domain(F.col("company"), F.col("description"))).where("domain is not null").withColumns({"budget": budget, "client_spend": spend})
    latest = latest_by(rows.select("domain", "id", "company", "title", "budget"), "domain", "id")
    summary = F.format_string("Upwork Job: %s (%s)", "title", "budget")
    companies = latest.select("domain", F.col("company").alias("name"), F.concat(F.lit("https://"), "domain").alias("website_url"), F.lit("upwork").alias("source"), summary.alias("project_summary"))
    signals = rows.select("domain", "id", F.lit("upwork_high_intent_job").alias("type"), F.lit(90.0).alias("confidence"), "budget", "client_spend", "keyword", F.substring("description", 1, 300).alias("snippet"))
    return companies, signals


def upsert_companies(old: DataFrame, new: DataFrame, order: str = "id") -> DataFrame:
    """Merge on the domain: the name stays if there is one, other columns take new values. Each side is first one row a domain: the first old one, the latest new one."""
    names = ["domain", "name", "industry", "employees"]
    return merge_snapshot(first_by(old.select(order, *names), "domain", order), latest_by(new.select(order, *names), "domain", order), "domain", ["name"], ["industry", "employees"])


def upsert_opportunities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge on company and type: values of the latest new row win, an existing status stays."""
    key, values = ["company_id", "type"], ["estimated_value_low", "estimated_value_high", "confidence"]
    late = new.groupBy(*key).agg(F.max_by(F.struct(*values, "status"), "id").alias("n"))
    held = old.groupBy(*key).agg(F.min_by(F.struct(*values, "status"), "id").alias("o"))
    return held.join(late, key, "full").select(*key, *(F.coalesce(f"n.{v}", f"o.{v}").alias(v) for v in values), F.coalesce("o.status", "n.status").alias("status"))


def append_history(history: DataFrame, new: DataFrame, companies: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """The longer history, and the companies with ``last_crawled_at`` moved up to their latest new row."""
    seen = new.groupBy("company_id").agg(F.max(time).alias("seen")).withColumnRenamed("company_id", "id")
    touched = companies.join(seen, "id", "left").withColumn("last_crawled_at", F.greatest("last_crawled_at", "seen")).drop("seen")
    return history.unionByName(new, allowMissingColumns=True), touched


def upgrade_no_website(companies: DataFrame, opportunities: DataFrame, scores: DataFrame, contacts: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Companies without a website: crawl time set, the missing ``opportunities`` and ``scores`` rows, and their real addresses ``valid``."""
    bare = F.col("website_url").isNull() | F.coalesce(F.col("domain").endswith(".local"), F.lit(False))
    ids = companies.where(bare).select(F.col("id").alias("company_id"))
    have = opportunities.where(F.col("type") == NEW_WEBSITE[0]).select("company_id").distinct()
    full = scores.where("opportunity_score = 100.0 and priority_tier = 'immediate'").select("company_id").distinct()
    real = ~F.coalesce(F.col("email").endswith(".local"), F.lit(True)) & (F.col("email_status") != "valid")
    marked = contacts.join(ids.withColumn("bare", F.lit(True)).distinct(), "company_id", "left")
    return {
        "companies": companies.withColumn("last_crawled_at", F.when(bare, F.coalesce("last_crawled_at", as_of)).otherwise(F.col("last_crawled_at"))),
        "opportunities": ids.join(have, "company_id", "left_anti").select("company_id", F.lit(NEW_WEBSITE[0]).alias("type"), F.lit("discovered").alias("status")),
        "scores": ids.join(full, "company_id", "left_anti").select("company_id", F.lit(100.0).alias("opportunity_score"), F.lit("immediate").alias("priority_tier")),
        "contacts": marked.withColumn("email_status", F.when(F.col("bare") & real, "valid").otherwise(F.col("email_status"))).drop("bare"),
    }


def firmographic_match(companies: DataFrame, index: DataFrame) -> DataFrame:
    """First row of an index (``position``, ``name``) whose name holds the company's or is held by it.

    Names are compared in lower case without space at the ends; both ways go by the rarest gram of the name that is held.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ours = companies.select("id", clean(F.col("name")).alias("ours")).where("ours <> ''")
    theirs = index.groupBy(clean(F.col("name")).alias("theirs")).agg(F.min("position").alias("position")).where("theirs <> ''")
    mine, entries = ours.select("ours").distinct(), theirs.select("theirs")
    inside = contained(entries.select(F.col("theirs").alias("needle")), mine.select(F.col("ours").alias("hay"))).select(F.col("hay").alias("ours"), F.col("needle").alias("theirs"))
    around = contained(mine.select(F.col("ours").alias("needle")), entries.select(F.col("theirs").alias("hay"))).select(F.col("needle").alias("ours"), F.col("hay").alias("theirs"))
    first = inside.unionByName(around).join(theirs, "theirs").groupBy("ours").agg(F.min_by("theirs", F.struct("position", "theirs")).alias("entry"))
    return ours.join(first, "ours").select("id", "entry")


def verified_candidates(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """First address of each person, in the order of the candidates, that a probe accepted on a domain that doesn't accept all."""
    good = probes.where("accepted and not catch_all").select("email").distinct()
    return candidates.join(good, "email", "left_semi").groupBy("company_id", "person").agg(F.min_by("email", F.struct("position", "email")).alias("email"))


def merge_lookup_sources(found: DataFrame, gate: Column) -> DataFrame:
    """Lookup results of a company (``source_rank``, ``website_url``, ``phone``, ``email``) as one row: website of the best source, first phone, gated addresses in the order of sources."""
    ranked = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("source_rank", c)))
    contacts = F.sort_array(F.collect_set(F.when(gate, F.struct("source_rank", F.lower("email").alias("email")))))
    merged = found.groupBy("company_id").agg(ranked("website_url").alias("website_url"), ranked("phone").alias("phone"), contacts.alias("c"))
    return merged.select("company_id", "website_url", "phone", F.array_distinct(F.transform("c", lambda x: x["email"])).alias("emails"))


def skill_list(signals: DataFrame) -> DataFrame:
    """All skills matched in a company's postings, sorted, with how often each was."""
    hits = signals.where(F.col("type") == "hiring_skill_match").select("company_id", F.explode("skills").alias("skill")).groupBy("company_id", "skill").agg(F.count("*").alias("n"))
    return hits.groupBy("company_id").agg(F.sort_array(F.collect_list("skill")).alias("skills"), F.sum("n").alias("n_matches"))


def dedupe_contacts(contacts: DataFrame) -> DataFrame:
    """First contact of each address within a company, by tier and position; contacts without an address are left out."""
    rows = contacts.withColumn("email", F.lower(F.trim(F.col("email")))).where("email <> ''")
    return rows.groupBy("company_id", "email").agg(F.min_by("id", F.struct("tier", "position", "id")).alias("id"))
