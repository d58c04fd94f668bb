"""Who may get a first message, and which messages may be queued today. Nothing is sent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .leads import lead_email_gate
from .messages import GUESSED_SOURCES, stage_reject_reason
from .relational import latest_by

# fixed values: parts and endings of addresses that get no message, score tiers that allow none, days and messages of the warm-up
BARRED_PARTS = [".gov", ".mil", ".edu"]
BARRED_ENDINGS = [
    ".local", ".sg", ".fi", ".co.nz", ".com.hk", ".com.au", "@qq.com", "@163.com", "@126.com", "@realtor.com", "@cpadirectory.com", "@yellowpages.com", "@yelp.com", "@angi.com", "@thumbtack.com",
    "@angelone.in", "@remax.com", "@wxxi.org", "@digitalrealty.com",
]
CLOSED_TIERS = ["ignore", "disqualified", "pending_audit"]
WARM_UP = [(3, 5), (7, 15), (14, 30), (999_999, 50)]
AFTER_WARM_UP = 250


def barred_recipient(email: Column) -> Column:
    """Addresses that no first message goes to; a null address is barred."""
    mail = F.lower(F.trim(email))
    any_of = lambda tests: reduce(Column.__or__, tests)
    return F.coalesce(any_of([F.contains(mail, F.lit(p)) for p in BARRED_PARTS]) | any_of([mail.endswith(e) for e in BARRED_ENDINGS]), F.lit(True))


def proven_contact(source: Column, status: Column, verification: Column) -> Column:
    """Found addresses that are valid or catch-all, and guessed ones that a probe has accepted; an unknown source proves nothing."""
    guessed = source.isin(GUESSED_SOURCES)
    found = ~guessed & status.isin("valid", "catch_all")
    return F.coalesce(found | (guessed & (verification == "smtp_handshake") & (status == "valid")), F.lit(False))


def no_website(website_url: Column, domain: Column) -> Column:
    return website_url.isNull() | F.coalesce(domain.endswith(".local"), F.lit(False))


def outreach_eligible(companies: DataFrame, scores: DataFrame, contacts: DataFrame, signals: DataFrame, sent: DataFrame, minimum: float = 50.0, limit: int | None = 50) -> DataFrame:
    """Companies for a first message: ``company_id, opportunity_score, priority_tier, no_website``, those without a website first, then by score.

    The latest score is high enough and its tier open; the site was crawled or there is none, and no crawl failed; a
    contact has an address that is proven, not barred and was never written to; nobody at the company was written to.
    ``sent`` has the outbound messages (``company_id``, ``recipient``). Addresses are compared in lower case.
    """
    latest = latest_by(scores.select("company_id", "id", "opportunity_score", "priority_tier"), "company_id", "id").drop("id")
    allowed = latest.where((F.col("opportunity_score") >= minimum) & ~F.col("priority_tier").isin(CLOSED_TIERS))
    bare = no_website(F.col("website_url"), F.col("domain"))
    firms = companies.where(F.col("last_crawled_at").isNotNull() | bare).select(F.col("id").alias("company_id"), bare.alias("no_website"))
    usable = contacts.where(proven_contact(F.col("source"), F.col("email_status"), F.col("verification_source")) & ~barred_recipient(F.col("email")))
    written = sent.select(F.lower(F.trim("recipient")).alias("mail")).distinct()
    reachable = usable.select("company_id", F.lower(F.trim("email")).alias("mail")).join(written, "mail", "left_anti").select("company_id").distinct()
    failed = signals.where(F.col("type") == "crawl_audit_failed").select("company_id").distinct()
    found = firms.join(allowed, "company_id").join(reachable, "company_id", "left_semi")
    found = found.join(failed, "company_id", "left_anti").join(sent.select("company_id").where("company_id is not null").distinct(), "company_id", "left_anti")
    found = found.select("company_id", "opportunity_score", "priority_tier", "no_website")
    return found if limit is None else found.orderBy(F.desc("no_website"), F.desc("opportunity_score"), "company_id").limit(limit)


def warmup_limit(first_day: Column, today: Column, override: Column | None = None) -> Column:
    """Messages allowed on a day: 5 on the first three days of sending, 15 to the seventh, 30 to the fourteenth, then 50, unless a number is set."""
    active = F.datediff(today, first_day) + 1
    steps = reduce(lambda chain, step: chain.when(active <= step[0], step[1]), WARM_UP[1:], F.when(active <= WARM_UP[0][0], WARM_UP[0][1]))
    limit = steps.otherwise(AFTER_WARM_UP)
    return limit if override is None else F.coalesce(override, limit)


def stage_messages(candidates: DataFrame, suppressed: DataFrame, sent: DataFrame, verdicts: DataFrame, cap: int) -> DataFrame:
    """Candidates with ``reject_reason``; null means queued, with ``evidence_snapshot``.

    A candidate is a contact (``contact_id``, ``email``, ``email_status``, ``source``, ``verification_source``) with facts of its
    company (``company_id``, ``domain``, ``name``, ``website_url``, ``last_crawled_at``, ``opportunity_score``, ``cms``,
    ``frontend_stack``, ``performance_score``, ``lcp_ms``, ``n_opportunities``, ``hiring``) and its message (``segment``, ``body``).
    Tests, the first that fails counts: anything known of the company at all; ``stage_reject_reason``; the lead's address
    gate; the verdict on the address (``verdicts``: ``email``, ``deliverable``, ``status``), if there is one; a text with evidence; one message
    a company and an address; today's ``cap``, which goes to companies without a website first, then by score.
    """
    mail = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    rows = candidates.withColumn("__mail", mail)
    flag = lambda df, key, name: df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    low = lambda df, c: df.select(F.lower(F.trim(c)).alias("__mail"))
    rows = rows.join(flag(low(suppressed, "email"), "__mail", "__suppressed"), "__mail", "left")
    rows = rows.join(flag(sent, "company_id", "__at_company"), "company_id", "left").join(flag(low(sent, "recipient"), "__mail", "__at_mail"), "__mail", "left")
    rows = rows.join(flag(sent.select("contact_id"), "contact_id", "__at_contact"), "contact_id", "left")
    judged = verdicts.groupBy(F.lower(F.trim("email")).alias("__mail")).agg(F.bool_and(F.col("deliverable") & F.col("status").isin("valid", "catch_all")).alias("__good"))
    rows = rows.join(judged, "__mail", "left")
    bare = no_website(F.col("website_url"), F.col("domain"))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    known = F.col("last_crawled_at").isNotNull() | filled("cms") | (F.size(F.coalesce("frontend_stack", F.array().cast("array<string>"))) > 0) | some("performance_score") | some("lcp_ms") | some("n_opportunities") | F.coalesce("hiring", F.lit(False)) | bare
    contacted = F.coalesce("__at_company", "__at_mail", "__at_contact", F.lit(False))
    gate = lead_email_gate(F.col("email"), F.col("domain"), F.col("name"), bare)
    reason = F.coalesce(
        F.when(~known, "nothing_known"),
        # a company without a website may have no domain
        stage_reject_reason(F.when(bare, F.coalesce("domain", F.lit("-"))).otherwise(F.col("domain")), F.col("email"), F.col("email_status"), F.col("source"), F.col("verification_source"), F.col("__suppressed"), contacted),
        F.when(~gate.startswith("valid"), gate),
        F.when(~F.coalesce("__good", F.lit(True)), "undeliverable"),
        F.when(~filled("segment") | ~filled("body"), "no_evidence"),
    )
    rows = rows.withColumn("reject_reason", reason).withColumn("__bare", bare)
    # of one company, and of one address, the first contact only
    place = F.struct("contact_id", "__mail")
    for key in ("company_id", "__mail"):
        first = rows.where("reject_reason is null").groupBy(key).agg(F.min(place).alias("__first"))
        rows = rows.join(first, key, "left").withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & ~(place.eqNullSafe(F.col("__first"))), "already_contacted").otherwise(F.col("reject_reason"))).drop("__first")
    order = [F.desc("__bare"), F.desc("opportunity_score"), F.col("company_id"), F.col("contact_id")]
    # ``cap`` rows at most
    today = rows.where("reject_reason is null").orderBy(*order).limit(max(cap, 0)).select("company_id", F.lit(True).alias("__today"))
    rows = rows.join(F.broadcast(today), "company_id", "left")
    snapshot = F.to_json(F.struct("segment", F.col("cms").alias("tech_cms"), "frontend_stack", F.coalesce("n_opportunities", F.lit(0)).alias("opportunities_count")))
    reason = F.when(F.col("reject_reason").isNull() & F.col("__today").isNull(), "daily_limit").otherwise(F.col("reject_reason"))
    return rows.withColumn("reject_reason", reason).select(*candidates.columns, "reject_reason", F.when(F.col("reject_reason").isNull(), snapshot).alias("evidence_snapshot"))
