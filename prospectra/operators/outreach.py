"""E-mail verdicts, probe classification, segments and staging of messages. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions.domains import validate_email_syntax
from prospectra.functions.text import contains_any

# fixed values: role mailboxes
ROLES = [
    "admin", "administrator", "root", "sysadmin", "webmaster", "postmaster", "hostmaster", "operations", "ops", "support", "help", "helpdesk", "service", "sales", "orders", "billing",
    "invoices", "accounts", "accounting", "finance", "inquiry", "info", "information", "contact", "contactus", "hello", "hi", "team", "office", "reception", "general", "feedback", "marketing", "press",
]
# fixed values: confidence in an accepted address, by provider
PROVIDER_WEIGHT = {"custom_smtp": 85.0, "zoho": 80.0, "yahoo": 75.0, "microsoft_365": 70.0, "protonmail": 70.0, "google_workspace": 65.0, "proofpoint": 60.0, "mimecast": 60.0, "barracuda": 60.0}
# fixed values: texts of refusals
POLICY = [
    "spamhaus", "blocked", "blacklist", "denied", "relay access denied", "relay denied", "policy rejection", "service unavailable", "client host", "5.7.1", "5.7.0", "reputation",
    "unauthorized", "barracuda", "sorbs", "spamcop",
]
FULL = ["mailbox full", "quota", "5.2.2", "over quota"]
NOT_FOUND = [
    "user unknown", "recipient address rejected", "recipient rejected", "no such user", "mailbox unavailable", "mailbox not found", "does not exist", "invalid recipient", "user not found",
    "unknown user", "bad destination mailbox", "invalid address", "5.1.1", "5.4.1", "5.1.0", "5.1.2", "5.2.1",
]


def role_account(email: Column) -> Column:
    """First token of the local part that names a role, else null."""
    local = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(email, F.lit("")), "^([^@]*)", 1)), r"\+.*$", "")
    return F.get(F.filter(F.concat(F.array(local), F.split(local, r"[._-]")), lambda t: t.isin(ROLES)), F.lit(0))


def classify_probe(probes: DataFrame) -> DataFrame:
    """Per address the first decisive answer among its first three mail hosts, else grey-listing or no connection.

    Several answers of one host are taken in the order of code, message, catch-all and provider, nulls first.
    """
    text, code = F.lower(F.coalesce("message", F.lit(""))), F.col("code")
    refused = F.when(contains_any(text, POLICY), "ip_policy_blocked").when(contains_any(text, FULL), "mailbox_full").when(contains_any(text, NOT_FOUND), "mailbox_not_found").otherwise("generic_5xx_rejection")
    status = F.when(code.isin(250, 251), F.when(F.col("catch_all"), "catch_all").otherwise("smtp_accepted")).when(code.between(550, 554), refused)
    rated = probes.where("mx_idx < 3").withColumn("decisive", status)
    order = F.struct("mx_idx", "code", "message", "catch_all", "provider")
    out = rated.groupBy("email").agg(F.min_by("decisive", F.when(F.col("decisive").isNotNull(), order)).alias("d"), F.max_by("code", order).alias("last_code"), F.min_by("provider", order).alias("provider"))
    sub = F.coalesce("d", F.when(F.col("last_code").isin(421, 450, 451, 452), "greylisted").otherwise("connection_failed"))
    weight = F.coalesce(*(F.when(F.col("provider") == k, F.lit(v)) for k, v in PROVIDER_WEIGHT.items()), F.lit(70.0))
    return out.select("email", sub.alias("sub_status"), F.when(sub == "smtp_accepted", weight).when(sub == "catch_all", 40.0).otherwise(0.0).alias("score"))


def email_verdict(rows: DataFrame) -> DataFrame:
    """Syntax, then disposable, then mail hosts, then a probe (roles 10 lower, at least 40), else 85 or 65 by mail hosts alone."""
    role = role_account(F.col("email")).isNotNull()
    probed = F.col("probe_status")
    sub = (
        F.when(validate_email_syntax(F.col("email")).isNotNull(), "malformed_syntax")
        .when(F.col("disposable"), "disposable_email")
        .when(~F.col("has_mx"), "no_mx_records")
        .when((probed == "smtp_accepted") & role, "role_account")
        .when(probed.isNotNull(), probed)
        .when(role, "role_account")
        .otherwise("dns_mx_verified")
    )
    score = (
        F.when(sub.isin("malformed_syntax", "disposable_email", "no_mx_records"), 0.0)
        .when(probed.isNotNull(), F.when((probed == "smtp_accepted") & role, F.greatest(F.lit(40.0), F.col("probe_score") - 10)).otherwise(F.col("probe_score")))
        .when(role, 65.0)
        .otherwise(85.0)
    )
    return rows.withColumn("sub_status", sub).withColumn("score", score)


def mx_rank(records: DataFrame) -> DataFrame:
    """Mail hosts of a domain by preference, null hosts left out."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("preference", "host")).cast("long")
    return records.where("coalesce(host, '') not in ('', '.')").withColumn("rank", rank).withColumn("is_primary", F.col("rank") == 1)


def segment_lead(rows: DataFrame) -> DataFrame:
    """First campaign segment that a company's opportunity, signals and stack call for."""
    kind, front = F.coalesce("opportunity", F.lit("")), F.lower(F.coalesce("library", F.lit("")))
    return rows.withColumn(
        "segment",
        F.when((kind == "new_website_creation") | ~F.col("has_website"), "new_website_creation")
        .when((kind == "staff_augmentation") | F.col("hiring"), "staff_augmentation")
        .when((kind == "cms_to_laravel_migration") | F.contains(F.lower(F.coalesce("cms", F.lit(""))), F.lit("wordpress")), "laravel_modernization")
        .when((kind == "frontend_modernization") | F.contains(front, F.lit("jquery")), "frontend_modernization")
        .when(kind.isin("performance_optimization", "backend_optimization"), "speed_optimization")
        .otherwise("general_engineering"),
    )


def email_candidates(people: DataFrame) -> DataFrame:
    """Five ordered address patterns per person and domain."""
    f, last, d = F.lower("first_name"), F.lower("last_name"), F.col("domain")
    at = lambda *parts: F.concat(*parts, F.lit("@"), d)
    initial = F.substring(f, 1, 1)
    return people.select("id", F.posexplode(F.array(at(f, F.lit("."), last), at(initial, last), at(f), at(f, last), at(last))).alias("position", "email"))


def enrichment_waterfall(contacts: DataFrame) -> DataFrame:
    """Contacts of the first tier that has any, per company; of repeated addresses the first."""
    best = contacts.groupBy("company_id").agg(F.min("tier").alias("tier"))
    once = Window.partitionBy("company_id", F.lower("email")).orderBy("id")
    return contacts.join(best, ["company_id", "tier"]).withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
