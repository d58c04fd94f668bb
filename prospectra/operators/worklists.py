"""Worklists, lookups and small reports over the lead tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions.domains import is_agency
from prospectra.functions.text import slugify

from .relational import anti_any
from .scoring import disqualify_company
from .textjoin import first_with_prefix

#: Offer for a company without a website that has none yet.
DEFAULT_DEAL = (2500, 5000)


def scoring_worklist(companies: DataFrame, scores: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Crawled or website-less companies whose latest score is older than their crawl, or too old, or missing."""
    latest = scores.groupBy(F.col("company_id").alias("id")).agg(F.max("scored_at").alias("scored"))
    rows = companies.where(F.col("last_crawled_at").isNotNull() | F.col("website_url").isNull()).join(latest, "id", "left")
    fresh = (F.col("scored") >= F.coalesce("last_crawled_at", "scored")) & (F.col("scored") >= as_of - F.make_interval(days=F.lit(days)))
    return rows.where(~F.coalesce(fresh, F.lit(False))).drop("scored")


def enrichment_worklist(companies: DataFrame, scores: DataFrame, contacts: DataFrame, minimum: float = 40.0, limit: int | None = 50) -> DataFrame:
    """Companies with a score and no contact, those without a website first, then by score."""
    best = scores.where(F.col("opportunity_score") >= minimum).groupBy(F.col("company_id").alias("id")).agg(F.max("opportunity_score").alias("score"))
    rows = anti_any(companies, [(contacts, "id", "company_id")]).join(best, "id")
    bare = F.col("website_url").isNull() | F.coalesce(F.col("domain").endswith(".local"), F.lit(False))
    rows = rows.select("id", "score", bare.alias("no_website"))
    return rows if limit is None else rows.orderBy(F.desc("no_website"), F.desc("score"), "id").limit(limit)


def resolution_worklist(companies: DataFrame, host: str, source: str, limit: int = 50) -> DataFrame:
    """Newest companies that only a directory knows: on its host and never crawled, or from its local source."""
    known = F.col("domain").endswith(f".{host}") & F.col("last_crawled_at").isNull()
    return companies.where(known | (F.col("source") == source)).orderBy(F.desc("id")).limit(limit)


def crawl_backlog(companies: DataFrame, limit: int = 100) -> DataFrame:
    """The next batch of companies to crawl: buyers by id."""
    return disqualify_company(companies).where("disqualified_reason is null").orderBy("id").limit(limit)


def purge_invalid_recipients(rows: DataFrame, pattern: str, invalidate: bool = False, email: str = "email", status: str = "email_status") -> DataFrame:
    """Rows without addresses that match, or with ``invalidate`` all rows, those marked ``invalid``."""
    bad = F.coalesce(F.col(email).rlike(pattern), F.lit(False))
    return rows.withColumn(status, F.when(bad, "invalid").otherwise(F.col(status))) if invalidate else rows.where(~bad)


def lookup_by_key(rows: DataFrame, keys: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Rows of the keys, in order."""
    return rows.join(keys.select(key).distinct(), key, "left_semi").orderBy(order)


def find_company_by_name(companies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Company of each ``wanted`` name (``wanted_id``, ``wanted``, ``city``): the lowest id of the same name, else of a domain that begins with the name's and the city's slug.

    Names are compared in lower case without space at the ends; without a name nothing is found, and without a city only
    the same name.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    names = companies.groupBy(clean(F.col("name")).alias("clean")).agg(F.min("id").alias("id")).where("clean <> ''")
    name, city = slugify(F.col("wanted")), slugify(F.col("city"))
    asked = wanted.select("wanted_id", clean(F.col("wanted")).alias("clean"), F.when((name != "") & (city != ""), F.concat_ws("-", name, city)).alias("key"))
    exact = asked.join(names, "clean", "left")
    begun = first_with_prefix(exact.where("id is null").select("key"), companies.select(F.lower("domain").alias("name"), "id"))
    return exact.join(begun.withColumnRenamed("id", "begun"), "key", "left").select("wanted_id", F.coalesce("id", "begun").alias("id"))


def canonical_domain(rows: DataFrame, redirects: DataFrame) -> DataFrame:
    """Domains through a table of redirects (``domain``, ``target``); the smallest target of a domain counts."""
    target = redirects.groupBy("domain").agg(F.min("target").alias("target"))
    return rows.join(target, "domain", "left").withColumn("domain", F.coalesce("target", "domain")).drop("target")


def validate_messages(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Messages with their contact id only where the contact exists, and its address where they have none."""
    known = contacts.groupBy(F.col("id").alias("contact_id")).agg(F.first("email", ignorenulls=True).alias("theirs"), F.lit(True).alias("found"))
    rows = messages.join(known, "contact_id", "left")
    return rows.withColumn("contact_id", F.when(F.col("found"), F.col("contact_id"))).withColumn("email", F.coalesce("email", "theirs")).drop("theirs", "found")


def catchall_ttl(verdicts: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Latest verdict of each key that is not too old."""
    latest = verdicts.groupBy("key").agg(F.max_by("verdict", "ts").alias("verdict"), F.max("ts").alias("ts"))
    return latest.where(F.col("ts") >= as_of - F.make_interval(hours=F.lit(hours)))


def certificate_metrics(certificates: DataFrame, as_of: Column, soon: int = 30) -> DataFrame:
    """Days until a certificate (``expires``) ends and whether that is soon."""
    days = F.datediff("expires", as_of).cast("long")
    return certificates.withColumn("days", days).withColumn("expiring", days < soon)


def ingest_job_postings(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """Hiring signal of each company that is no agency and has a posting by its domain."""
    buyers = companies.where(~is_agency(F.col("name"), F.col("domain"), F.col("industry")))
    return buyers.join(postings.select("domain").distinct(), "domain", "left_semi").select("id", F.lit("active_hiring_intent").alias("type"))


def outreach_ready_count(usable: DataFrame, contacted: DataFrame) -> DataFrame:
    """Companies and contacts that may be written to and were not."""
    return anti_any(usable, [(contacted, "company_id", "company_id")]).agg(F.countDistinct("company_id").alias("ready"), F.count("*").alias("contacts"))


def deal_range(companies: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Sum of low and high values per company; one without a website and offers gets the default."""
    sums = opportunities.groupBy("company_id").agg(F.sum("estimated_value_low").alias("low"), F.sum("estimated_value_high").alias("high"))
    rows = companies.select(F.col("id").alias("company_id"), "website_url").join(sums, "company_id", "left")
    value = lambda c, default: F.when(F.col("website_url").isNull() & F.col("high").isNull(), default).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.select("company_id", value("low", DEFAULT_DEAL[0]), value("high", DEFAULT_DEAL[1]))


def retry_counts(schedule: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """Pending, due and dead attempts, and the companies of the first ``n`` dead letters."""
    live = ~F.col("dead_letter")
    counts = schedule.agg(F.count_if(live).alias("pending"), F.count_if(live & (F.col("next_retry_at") <= as_of)).alias("due"), F.count_if("dead_letter").alias("dead"))
    first = schedule.where("dead_letter").orderBy("company_id").limit(n).agg(F.sort_array(F.collect_list("company_id")).alias("first_dead"))
    return counts.join(first)  # a row each
