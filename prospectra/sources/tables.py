"""Readers and writers: tables, landed job feeds, people and registry payloads, lead export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions.extract import infer_employer_domain
from prospectra.functions.text import normalize_domain, split_job_title, visible_text
from prospectra.operators.leads import role_class
from prospectra.operators.relational import first_by, latest_by

# fixed values: job APIs with the array of their items ("" is the whole payload), title, company, text and address fields, and confidence
JOB_APIS = {
    "remotive_api": ("jobs", "title", "company_name", "description", "url", 65.0),
    "arbeitnow_api": ("data", "title", "company_name", "description", "url", 60.0),
    "jobicy_api": ("jobs", "jobTitle", "companyName", "jobDescription", "url", 60.0),
    "remoteok_api": ("", "position", "company", "description", "url", 60.0),
}
# fixed values: hiring boards of one company each, with the array of their items, title, text and address fields
HIRING_BOARDS = {
    "ats_greenhouse": ("jobs", "title", "content", "absolute_url"),
    "ats_lever": ("", "text", "descriptionPlain", "hostedUrl"),
    "ats_ashby": ("jobs", "title", "descriptionPlain", "jobUrl"),
}
# fixed values: default industry and confidence of each RSS feed
JOB_FEEDS = {
    "larajobs": ("Custom Laravel & Web Applications", 75.0),
    "himalayas": ("Commercial Web & Cloud Platforms", 70.0),
    "working_nomads": ("Custom Business Software", 60.0),
    "arc_dev": ("Commercial Web Development", 65.0),
    "js_remotely": ("Modern Frontend & React Stores", 65.0),
    "jobspresso": ("Custom Business Applications", 60.0),
    "dribbble": ("E-Commerce & Digital Design", 65.0),
    "wwr_fullstack": ("Custom Business Applications", 70.0),
    "wwr_frontend": ("Modern Frontend & Web Applications", 70.0),
    "wwr_backend": ("Custom Backend & Software Architecture", 70.0),
    "vuejobs": ("Modern Frontend & Web Apps", 65.0),
    "ruby_on_remote": ("E-Commerce & SaaS Platforms", 65.0),
}
# fixed values: what a contact without a title is called, and the score of one without a confidence
UNTITLED = {"people_search": "Technical Decision Maker", "domain_search": "Unknown"}
PEOPLE_SCORE = {"people_search": 85.0, "domain_search": 80.0}
SUMMARY_CHARS = 350


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


PAGE = "domain string, source_url string, http_status int, headers map<string,string>, raw_html string, ttfb_ms int, error string"


def read_pages(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Landed pages of a crawl: ``domain, source_url, http_status, headers, raw_html, ttfb_ms``.

    A fetch that failed, one with an ``error`` or without a status, is a row with status 0, no headers, no time and an empty
    text. A missing domain is that of the address; a line that is no record is left out.
    """
    rows = spark.read.schema(PAGE).format(kind).load(path).where("source_url is not null or domain is not null")
    failed = F.coalesce(F.col("error") != "", F.lit(False)) | F.col("http_status").isNull()
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(
        F.coalesce(F.nullif("domain", F.lit("")), normalize_domain(F.col("source_url"))).alias("domain"),
        "source_url",
        F.when(failed, 0).otherwise(F.col("http_status")).alias("http_status"),
        F.when(failed, none).otherwise(F.coalesce("headers", none)).alias("headers"),
        F.when(failed, "").otherwise(F.coalesce("raw_html", F.lit(""))).alias("raw_html"),
        F.when(~failed, F.col("ttfb_ms")).alias("ttfb_ms"),
    )


def _items(payload: Column, items: str, fields: list[str]) -> Column:
    """The array of a JSON payload, or the payload itself for "", as structs of text fields; null where it is no such JSON."""
    row = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    return F.from_json(payload, f"struct<`{items}`:{row}>")[items] if items else F.from_json(payload, row)


def flatten_job_postings(payloads: DataFrame, source: str) -> DataFrame:
    """Postings of landed answers (``payload`` JSON text, and ``slug`` for the board of one company).

    Items of a job API without a company or a domain are left out, notices among them; a board's company and domain come
    from its slug. Broken or empty payloads give no row.
    """
    if source in JOB_APIS:
        items, title, company, text, url, confidence = JOB_APIS[source]
        rows = payloads.select(F.explode(_items(F.col("payload"), items, [title, company, text, url])).alias("i"))
        rows = rows.select(F.trim(f"i.{company}").alias("company_name"), F.trim(F.coalesce(f"i.{title}", F.lit(""))).alias("job_title"), visible_text(F.col(f"i.{text}")).alias("text"), F.col(f"i.{text}").alias("raw"), F.col(f"i.{url}").alias("job_url"))
        rows = rows.withColumn("domain", infer_employer_domain(F.col("company_name"), F.col("raw"))).where("company_name <> '' and domain is not null").drop("raw")
    else:
        (items, title, text, url), confidence = HIRING_BOARDS[source], None
        rows = payloads.select("slug", F.explode(_items(F.col("payload"), items, [title, text, url])).alias("i"))
        name = F.concat(F.upper(F.substring("slug", 1, 1)), F.lower(F.substr("slug", F.lit(2))))
        domain = F.concat(F.translate(F.lower("slug"), "-_", ""), F.lit(".com"))
        rows = rows.select(name.alias("company_name"), domain.alias("domain"), F.coalesce(f"i.{title}", F.lit("")).alias("job_title"), visible_text(F.col(f"i.{text}")).alias("text"), F.col(f"i.{url}").alias("job_url"))
    return _postings(rows, source, F.lit(confidence).cast("double"))


def _postings(rows: DataFrame, source: str, confidence: Column) -> DataFrame:
    return rows.select(
        "company_name", "domain", F.concat(F.lit("https://"), "domain").alias("website_url"), "job_title", F.substring("text", 1, SUMMARY_CHARS).alias("summary"), "job_url",
        F.lit(source).alias("source"), confidence.alias("confidence"),
    )


def read_job_postings_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed JSON answers as postings, a file each; the file of a board is named after the company's slug."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.json)?$", 1).alias("slug"))
    return flatten_job_postings(files, source)


def flatten_feed_items(items: DataFrame, feed: str) -> DataFrame:
    """Items of an RSS feed (``title``, ``link``, ``description``) as postings with ``default_industry``; those without a company or a domain are left out."""
    industry, confidence = JOB_FEEDS[feed]
    parts = split_job_title(F.col("title"))
    rows = items.select(parts["company"].alias("company_name"), parts["role"].alias("job_title"), visible_text(F.col("description")).alias("text"), "description", F.coalesce("link", F.lit("")).alias("job_url"))
    rows = rows.withColumn("domain", infer_employer_domain(F.col("company_name"), F.col("description"))).where("char_length(company_name) >= 2 and domain is not null")
    return _postings(rows, f"rss_{feed}", F.lit(confidence)).withColumn("default_industry", F.lit(industry))


def read_job_feed_xml(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Items of landed RSS files as postings."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string").load(path)
    return flatten_feed_items(items, feed)


def flatten_people(payloads: DataFrame, provider: str) -> DataFrame:
    """People of landed answers (``company_id``, ``payload`` JSON text) as contacts.

    Providers are ``people_search`` (array ``people``) and ``domain_search`` (array ``data.emails``, of which only items
    with an address count, and whose confidence is the score).
    """
    if provider == "people_search":
        people = F.from_json("payload", "people array<struct<first_name:string,last_name:string,name:string,title:string,email:string,linkedin_url:string>>")["people"]
        email, title, link, given = "email", "title", "linkedin_url", F.lit(None).cast("double")
    else:
        people = F.from_json("payload", "data struct<emails:array<struct<first_name:string,last_name:string,value:string,position:string,confidence:double,linkedin:string>>>")["data"]["emails"]
        email, title, link, given = "value", "position", "linkedin", F.col("p.confidence")
    rows = payloads.select("company_id", F.explode(people).alias("p"))
    both = F.trim(F.concat(F.coalesce("p.first_name", F.lit("")), F.lit(" "), F.coalesce("p.last_name", F.lit(""))))
    if provider == "people_search":
        name = F.coalesce(F.nullif("p.name", F.lit("")), both)
    else:
        rows = rows.where(F.contains("p.value", F.lit("@")))
        name = F.coalesce(F.nullif(both, F.lit("")), F.regexp_extract("p.value", "^([^@]*)", 1))
    shown = F.coalesce(F.nullif(f"p.{title}", F.lit("")), F.lit(UNTITLED[provider]))
    return rows.select(
        "company_id", name.alias("full_name"), "p.first_name", "p.last_name", shown.alias("title"), role_class(shown, provider).alias("role_category"), F.col(f"p.{email}").alias("email"),
        F.coalesce(given, F.lit(PEOPLE_SCORE[provider])).alias("email_score"), F.col(f"p.{link}").alias("linkedin_url"), F.lit(provider).alias("source"),
    )


def flatten_lighthouse(payloads: DataFrame) -> DataFrame:
    """Scores (times 100, cut to whole numbers) and vitals of performance payloads; null where a part is absent, 0 where only its number is."""
    part = lambda p: F.get_json_object("payload", f"$.{p}")
    number = lambda p, field: F.when(part(p).isNotNull(), F.coalesce(part(f"{p}.{field}").try_cast("double"), F.lit(0.0)))
    score = lambda name: (number(f"categories.{name}", "score") * 100).cast("int").alias(f"{name}_score")
    vital = lambda name: number(f"audits.{name}", "numericValue")
    return payloads.select(
        "url", score("performance"), score("accessibility"), score("seo"), vital("largest-contentful-paint").cast("int").alias("lcp_ms"), vital("first-contentful-paint").cast("int").alias("fcp_ms"),
        vital("cumulative-layout-shift").alias("cls"), vital("interaction-to-next-paint").cast("int").alias("inp_ms"), vital("server-response-time").cast("int").alias("ttfb_ms"),
    )


def lead_report(companies: DataFrame, technologies: DataFrame, scores: DataFrame, contacts: DataFrame, minimum: float = 0.0) -> DataFrame:
    """A line of 23 columns for each company with its latest stack and score and its first usable contact, unordered."""
    tech = latest_by(technologies.select("company_id", "id", "cms", "frontend_stack", "backend_stack", "https", "hsts", "ttfb_ms"), "company_id", "id").drop("id")
    score = latest_by(scores.select("company_id", "id", "opportunity_score", "priority_tier", "company_fit", "technology_gap", "pain_signal", "buying_signal"), "company_id", "id").drop("id")
    usable = contacts.where(F.col("email_status").isin("valid", "catch_all", "unverified"))
    contact = first_by(usable.select("company_id", "id", "full_name", "title", "email", "email_status"), "company_id", "id").drop("id")
    rows = companies.withColumnRenamed("id", "company_id").join(tech, "company_id", "left").join(score, "company_id", "left").join(contact, "company_id", "left")
    blank = lambda c, other="": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c).cast("double"))).otherwise("N/A")
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    return rows.where(F.coalesce("opportunity_score", F.lit(0.0)) >= minimum).select(
        F.col("company_id").alias("Company ID"), F.col("domain").alias("Domain"), F.col("name").alias("Name"), F.upper(blank("priority_tier", "Unscored")).alias("Priority Tier"), number("opportunity_score").alias("Opportunity Score"),
        blank("full_name").alias("Decision Maker Name"), blank("title").alias("Decision Maker Title"), blank("email").alias("Verified Email"), F.upper(blank("email_status")).alias("Email Status"),
        number("company_fit").alias("Company Fit"), number("technology_gap").alias("Tech Gap"), number("pain_signal").alias("Pain Signal"), number("buying_signal").alias("Buying Signal"), F.col("source").alias("Source"),
        blank("industry").alias("Industry"), blank("employees").alias("Employees"), blank("cms").alias("CMS"), blank("frontend_stack", "[]").alias("Frontend Stack"), blank("backend_stack", "[]").alias("Backend Stack"),
        yes("https").alias("HTTPS"), yes("hsts").alias("HSTS"), F.when(F.col("ttfb_ms") != 0, F.col("ttfb_ms").cast("string")).otherwise("").alias("TTFB (ms)"), F.col("created_at").alias("Discovered At"),
    )


def export_leads(report: DataFrame, path: str) -> None:
    """A lead report as CSV with a header, one folder of part files in order: best score first, then the newest company."""
    score = F.coalesce(F.col("Opportunity Score").try_cast("double"), F.lit(0.0))
    report.orderBy(score.desc(), F.desc("Company ID")).write.option("header", True).csv(path)
