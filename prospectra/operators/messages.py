"""Messages: who may be written to, on what evidence, and the text; context and effect of replies. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .leads import BLOCKED_PARTS
from .relational import first_by, latest_by

# fixed values: sources whose addresses are guesses until a probe accepts them, and endings of addresses that get nothing
GUESSED_SOURCES = ["canonical_synthesizer", "email_permutator"]
BARRED_ENDINGS = [".local", ".gov", ".mil", ".edu", ".sg", ".fi", ".co.nz", ".com.hk", ".com.au"]
#: Follow-up texts by segment; the last is for all others.
SEGMENTS = ["laravel_modernization", "frontend_modernization", "staff_augmentation", "speed_optimization", "turnkey_modernization_overhaul", "new_website_creation"]


def copy_candidates(companies: DataFrame, contacts: DataFrame, scores: DataFrame, evidence: DataFrame, failed: DataFrame, messages: DataFrame, minimum: float = 40.0, limit: int | None = 250) -> DataFrame:
    """Contacts to write to: their company has a score, evidence or no website, no failed crawl, and neither was written to.

    Tables of one company are first one row: the latest score and evidence. No-website companies come first, then those
    with evidence, by score.
    """
    latest = latest_by(scores.select("company_id", "id", "opportunity_score", "priority_tier"), "company_id", "id").drop("id")
    facts = latest_by(evidence.select("company_id", "id", "cms", "lcp_ms", "crawl_failed"), "company_id", "id").drop("id")
    email = F.lower("email")
    guessed = F.col("source").isin(GUESSED_SOURCES)
    usable = F.when(guessed, (F.col("verification_source") == "smtp_handshake") & (F.col("email_status") == "valid")).otherwise(F.col("email_status").isin("valid", "catch_all"))
    barred = F.exists(F.array(*map(F.lit, BARRED_ENDINGS)), lambda e: email.endswith(e))
    people = contacts.where(usable & ~barred).select(F.col("id").alias("contact_id"), "company_id", "email")
    rows = companies.select(F.col("id").alias("company_id"), "domain", "website_url", "last_crawled_at").join(latest, "company_id").join(people, "company_id").join(facts, "company_id", "left")
    bare = F.col("website_url").isNull() | F.coalesce(F.col("domain").endswith(".local"), F.lit(False))
    proven = F.coalesce(F.col("cms").isNotNull() | (F.col("lcp_ms") > 2500), F.lit(False))
    rows = rows.where((F.col("opportunity_score") >= minimum) & ~F.col("priority_tier").isin("ignore", "disqualified", "pending_audit") & ~F.coalesce("crawl_failed", F.lit(False)))
    rows = rows.where(bare | (F.col("last_crawled_at").isNotNull() & proven)).join(failed.select("company_id").distinct(), "company_id", "left_anti")
    rows = rows.join(messages.select("company_id").distinct(), "company_id", "left_anti").join(messages.select(F.col("recipient").alias("email")).distinct(), "email", "left_anti")
    out = rows.select("company_id", "contact_id", "email", "opportunity_score", bare.alias("no_website"), proven.alias("proven"))
    return out if limit is None else out.orderBy(F.desc("no_website"), F.desc("proven"), F.desc("opportunity_score"), F.desc("company_id"), "contact_id").limit(limit)


def evidence_gate(rows: DataFrame) -> DataFrame:
    """Add ``evidence``, what is known for a row's ``segment``, or ``reject_reason`` where nothing is: no text without facts."""
    stack = F.array_join("frontend", ", ")
    has_stack = F.coalesce(F.size("frontend") > 0, F.lit(False))
    seconds = lambda ms: F.format_string("%.1f", F.col(ms) / 1000)
    # fixed values: phrases of evidence
    libraries = F.when(has_stack, F.concat(F.lit("legacy frontend libraries ("), stack, F.lit(")")))
    speed = F.coalesce(
        F.when(F.col("lcp_ms") > 0, F.concat(F.lit("Core Web Vitals Largest Contentful Paint of "), seconds("lcp_ms"), F.lit("s"))),
        F.when(F.col("homepage_ms") > 0, F.concat(F.lit("initial mobile load time of "), seconds("homepage_ms"), F.lit("s"))),
        F.when(F.col("ttfb_ms") > 0, F.concat(F.lit("server response latency (TTFB) of "), F.col("ttfb_ms").cast("string"), F.lit("ms"))),
        F.when(F.col("performance_score") > 0, F.concat(F.lit("Lighthouse mobile score of "), F.col("performance_score").cast("string"), F.lit("/100"))),
    )
    reviews = F.when(F.col("reviews_count") > 0, F.concat(F.col("reviews_count").cast("string"), F.lit(" verified Google reviews"))).otherwise("strong local customer reputation and rating")
    measured = F.coalesce(F.when(F.col("homepage_ms") > 0, F.concat(seconds("homepage_ms"), F.lit("s"))), F.when(F.col("performance_score") > 0, F.lit("elevated load time")))
    by_segment = {
        "laravel_modernization": F.coalesce(F.when(F.col("cms") != "", F.concat("cms", F.lit(" infrastructure"))), libraries),
        "frontend_modernization": libraries,
        "staff_augmentation": F.concat(F.lit("roles like "), F.get("roles", F.lit(0))),
        "speed_optimization": speed,
        "turnkey_modernization_overhaul": measured,
        "new_website_creation": reviews,
    }
    evidence = F.coalesce(*(F.when(F.col("segment") == k, v) for k, v in by_segment.items()))
    reason = F.when(~F.coalesce(F.col("segment").isin(list(by_segment)), F.lit(False)), "unsupported_segment").when(F.col("evidence").isNull(), F.concat(F.lit("no_evidence_for_"), "segment"))
    return rows.withColumn("evidence", evidence).withColumn("reject_reason", reason)


def render_message(rows: DataFrame, templates: DataFrame, sender: dict[str, str]) -> DataFrame:
    """Subject and body of each row from the template of its segment, step and variant (A, B, C by contact), tokens replaced, with the postal address and a way out at the end.

    ``templates``: ``segment``, ``step``, ``variant``, ``subject``, ``body``; a small table of settings. ``sender``:
    ``name``, ``company``, ``address``, ``unsubscribe``. Rows without a template are left out.
    """
    variant = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(F.coalesce("contact_id", F.lit(0)), F.lit(3)) + 1).cast("int"))
    rows = rows.withColumn("variant", variant).join(templates, ["segment", "step", "variant"])
    footer = F.concat(F.lit(f"\n\nBest,\n{sender['name']}\n\n---\n{sender['company']} | {sender['address']}\nUnsubscribe: {sender['unsubscribe']}"), F.col("email"))

    def fill(text: Column) -> Column:
        for token in ("first_name", "company_name", "domain", "evidence"):
            text = F.replace(text, F.lit("{{" + token + "}}"), F.coalesce(F.col(token), F.lit("")))
        return text

    return rows.withColumn("subject", fill(F.col("subject"))).withColumn("body", F.concat(F.trim(fill(F.col("body"))), footer))


def attach_reply_context(replies: DataFrame, contacts: DataFrame, companies: DataFrame, messages: DataFrame) -> DataFrame:
    """Contact, company and offer of each reply: by the sender's address, else a company whose domain holds the sender's, else the thread.

    A domain that holds another one starts with it at some place: the equi-join is on the parts of company domains from
    each place on that a sender's domain can match.
    """
    rows = replies.withColumn("sender", F.lower("sender"))
    by_mail = first_by(contacts.select(F.lower("email").alias("sender"), F.col("id").alias("contact_id"), F.col("company_id").alias("mail_company")), "sender", "contact_id")
    host = F.regexp_extract("sender", "@(.*)$", 1)
    lengths = rows.join(by_mail, "sender", "left_anti").select(host.alias("host")).where("host <> ''").distinct()
    names = companies.select("id", F.lower("domain").alias("domain"))
    sizes = lengths.select(F.char_length("host").alias("size")).distinct()
    grams = names.join(F.broadcast(sizes), F.char_length("domain") >= F.col("size"))  # a domain has at most 253 characters, so sizes are few
    pieces = grams.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("domain") - F.col("size") + 1), lambda i: F.substring(F.col("domain"), i, F.col("size")))).alias("host"))
    by_host = pieces.join(lengths, "host", "left_semi").groupBy("host").agg(F.min("id").alias("host_company"))
    thread = first_by(messages.select(F.col("message_id").alias("in_reply_to"), "id", F.col("company_id").alias("thread_company"), F.col("contact_id").alias("thread_contact"), "opportunity_id"), "in_reply_to", "id").drop("id")
    rows = rows.withColumn("host", host).join(by_mail, "sender", "left").join(by_host, "host", "left").join(thread, "in_reply_to", "left")
    return rows.withColumn("contact_id", F.coalesce("contact_id", "thread_contact")).withColumn("company_id", F.coalesce("mail_company", "host_company", "thread_company")).drop("mail_company", "host_company", "thread_company", "thread_contact", "host")


def apply_reply(opportunities: DataFrame, suppressed: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers after the latest reply of their company, and the suppression list with the senders who declined."""
    from .leads import apply_reply_intent

    declined = replies.where(F.col("intent") == "not_interested").select(F.lower("sender").alias("email"))
    return apply_reply_intent(opportunities, replies), suppressed.select(F.lower("email").alias("email")).unionByName(declined).distinct()


def stage_reject_reason(company_domain: Column, email: Column, status: Column, source: Column, verification: Column, suppressed: Column, contacted: Column) -> Column:
    """Why a message may not be staged, by the first rule that forbids it; suppression comes first, null means that it may."""
    mail = F.lower(F.coalesce(email, F.lit("")))
    guessed = F.coalesce(source.isin(GUESSED_SOURCES), F.lit(False))
    return (
        F.when(F.coalesce(suppressed, F.lit(False)), "suppressed")
        .when(mail == "", "no_email")
        .when(F.exists(F.array(*map(F.lit, BLOCKED_PARTS)), lambda p: F.contains(F.regexp_extract(mail, "@(.*)$", 1), p)), "blocked_domain")
        .when(~F.coalesce(status.isin("valid", "catch_all"), F.lit(False)), "unusable_status")
        .when(guessed & ((F.coalesce(verification, F.lit("")) != "smtp_handshake") | (status != "valid")), "unverified_guess")
        .when(F.coalesce(contacted, F.lit(False)), "already_contacted")
        .when(F.coalesce(company_domain, F.lit("")) == "", "no_domain")
    )
