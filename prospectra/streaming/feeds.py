"""Structured Streaming forms of the feeds; each gives the rows of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.operators import feeds


def retry_stream(failures: DataFrame) -> DataFrame:
    """Stateless: every failure becomes its next attempt or dead letter."""
    return feeds.retry_schedule(failures)


def bounce_stream(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Classified bounces, an address and type at most once within the watermark's delay."""
    rows = messages.where(feeds.is_bounce_notice(F.col("subject"), F.col("sender")))
    rows = rows.withColumn("bounce_type", feeds.classify_bounce(*(F.col(c) for c in ("dsn", "body", "subject", "sender"))))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["email", "bounce_type"])


def soft_bounce_state(bounces: DataFrame, limit: int = 3) -> DataFrame:
    """Running soft count per address and whether it calls for suppression (update mode)."""
    soft = bounces.where(F.col("bounce_type") == "soft_bounce")
    return soft.groupBy("email").agg(F.count("*").alias("n_soft")).withColumn("suppress", F.col("n_soft") >= limit)


def reply_stream(replies: DataFrame, delay: str = "1 day") -> DataFrame:
    """Replies once each by id, with their intent."""
    once = replies.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.withColumn("reply", feeds.classify_reply(F.col("subject"), F.col("body")))


def send_rate_stream(sends: DataFrame) -> DataFrame:
    """Messages per UTC day; a day closes two days late."""
    return sends.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n_sent"))


def crawl_backlog_stream(companies: DataFrame) -> DataFrame:
    """Accepted companies as backlog rows for a file sink."""
    return companies.where("website_url is not null").select("id", "domain", "website_url")
