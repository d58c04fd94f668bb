"""The website of a business among links, and the order in which sites are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that tell no business from another, hosts of directories, and names of brands that are no local business
COMMON_WORDS = [
    "inc", "llc", "corp", "corporation", "co", "the", "and", "service", "services", "company", "group", "solutions", "contractor", "contractors", "plumbing", "heating", "cooling", "electric", "electrical", "hvac",
    "roofing", "cleaning", "restoration",
]
DIRECTORIES = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "yelp.com", "yellowpages.com", "manta.com", "bbb.org", "mapquest.com", "linkedin.com", "tripadvisor.com", "angieslist.com", "angi.com", "thumbtack.com",
    "houzz.com", "homeadvisor.com", "dnb.com", "zoominfo.com", "google.com", "apple.com", "youtube.com", "tiktok.com", "pinterest.com", "nextdoor.com", "chamberofcommerce.com", "wikipedia.org", "indeed.com",
    "glassdoor.com", "ziprecruiter.com", "allbiz.com", "yahoo.com", "bing.com", "duckduckgo.com", "leadiq.com", "bumvar.com", "6bestrated.com", "schema.org", "citysquares.com", "breken.com",
    "contractorfinder.bradfordwhite.com", "cambridge.org", "dictionary.cambridge.org", "webcontainer-api.io", "opencorporates.com", "bizapedia.com",
]
BRANDS = ["genesis", "tom", "apple", "amazon", "microsoft", "google", "circle", "elevate"]


def name_tokens(name: Column) -> Column:
    """Words of three letters or digits and more that tell a name from others, or all such words where none does."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    own = F.filter(words, lambda w: ~w.isin(COMMON_WORDS))
    return F.when(F.size(own) > 0, own).otherwise(words)


def best_website(links: DataFrame) -> DataFrame:
    """``company_id, website`` from links (``company_id``, ``name``, ``position``, ``link``): the host whose first label holds most words of the name, the first of equals.

    Hosts of directories and brands don't count, nor do hosts without a word of the name, unless the name has no word at
    all. A company without such a link has no row; a link without a host is no link.
    """
    address = F.trim(F.coalesce("link", F.lit("")))
    scheme, host = F.lower(F.regexp_extract(address, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.replace(F.lower(F.regexp_extract(address, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    rows = links.select("company_id", "position", name_tokens(F.col("name")).alias("tokens"), scheme.alias("scheme"), host.alias("host")).where(F.contains("host", F.lit(".")))
    listed = F.exists(F.array(*map(F.lit, DIRECTORIES)), lambda d: (F.col("host") == d) | F.col("host").endswith(F.concat(F.lit("."), d)))
    stem = F.regexp_extract("host", "^([^.]*)", 1)
    count = F.when(F.size("tokens") == 0, 1).otherwise(F.size(F.filter("tokens", lambda t: F.contains(stem, t))))
    site = F.concat(F.when(F.col("scheme").isin("http", "https"), F.col("scheme")).otherwise("https"), F.lit("://"), F.col("host"))
    rows = rows.where(~listed & ~stem.isin(BRANDS)).select("company_id", "position", count.alias("n"), site.alias("site")).where("n > 0")
    return rows.groupBy("company_id").agg(F.min_by("site", F.struct(-F.col("n"), F.col("position"), F.col("site"))).alias("website"))


def retries_first(due: DataFrame, fresh: DataFrame) -> DataFrame:
    """Due retries and then new work as one worklist: ``place`` 0 and 1, ``company_id, domain, website_url, retry_count``.

    ``due`` has ``company_id``, ``domain`` and ``attempt``; a retry goes to the root of its domain. A company may stand in both
    parts, as it may be due and new; each part keeps its rows.
    """
    again = due.select(F.lit(0).alias("place"), "company_id", "domain", F.concat(F.lit("https://"), "domain").alias("website_url"), F.col("attempt").alias("retry_count"))
    return again.unionByName(fresh.select(F.lit(1).alias("place"), F.col("id").alias("company_id"), "domain", "website_url", F.lit(0).alias("retry_count")))
