"""Sinks that a replayed micro-batch leaves as they are, and streams that end in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospectra.operators import feeds, messages

#: Columns that name a reply without a message id.
REPLY_NAMES = ("sender", "subject", "ts")


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """The rows of a micro-batch as one folder of the table at ``path``, named by the batch.

    A batch that is run again after a crash between its write and its commit replaces its own folder.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_written(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that ``write_batch`` has written to ``path``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Run ``stream`` into the table at ``path``; ``change`` is applied to each micro-batch as a batch DataFrame."""

    def write(rows: DataFrame, batch: int) -> None:
        write_batch(change(rows) if change else rows, batch, path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def crawl_backlog_stream(companies: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Accepted companies as backlog rows in files; a replayed batch writes nothing twice.

    Companies without a website are left out; a company that comes twice is two rows, as in the feed.
    """
    return start(companies.where("website_url is not null").select("id", "domain", "website_url"), path, checkpoint, once=once)


def once_by_message(replies: DataFrame, delay: str = "1 day") -> DataFrame:
    """Replies once each within the watermark's ``delay``: by message id, or by sender, subject and time where it is missing."""
    names = F.to_json(F.struct(*REPLY_NAMES))
    name = F.when(F.coalesce("message_id", F.lit("")) != "", F.concat(F.lit("id:"), "message_id")).otherwise(F.concat(F.lit("row:"), names))
    return replies.where("ts is not null").withColumn("reply_name", name).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["reply_name"]).drop("reply_name")


def reply_actions(replies: DataFrame, contacts: DataFrame, companies: DataFrame, sent: DataFrame) -> DataFrame:
    """Batch form: replies with contact, company, offer, intent, and what the intent does to the offer and the sender."""
    read = replies.withColumn("reply", feeds.classify_reply(F.col("subject"), F.col("body"))).select(*replies.columns, F.col("reply.intent").alias("intent"), F.col("reply.confidence").alias("confidence"))
    found = messages.attach_reply_context(read, contacts, companies, sent)
    intent = F.col("intent")
    status = F.when(intent.isin("positive_interest", "neutral_question"), "in_discussion").when(intent == "not_interested", "closed_lost")
    return found.withColumn("offer_status", status).withColumn("suppress", intent == "not_interested")


def reply_stream(replies: DataFrame, context: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], path: str, checkpoint: str, delay: str = "1 day", once: bool = False) -> StreamingQuery:
    """Replies once each, with context and intent, into the table at ``path``.

    ``context`` returns contacts, companies and sent messages and is called for every micro-batch, so that a contact added
    since the last one is found. Equal to ``reply_actions`` of the rows that come within ``delay``; replies without a
    time are left out.
    """
    return start(once_by_message(replies, delay), path, checkpoint, lambda rows: reply_actions(rows, *context()), once=once)
