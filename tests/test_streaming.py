"""Stateful streams in shuffled micro-batches with a restart, and sinks that a replayed batch leaves as they are."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prospectra.operators import feeds
from prospectra.streaming import sinks, state

START = datetime(2024, 5, 1)


def fed_in_parts(spark, rows, schema, ts, folder, start, closing, parts=6):
    """Feed ``rows`` in shuffled parts, one file a micro-batch, and stop half way: the second run goes on from the checkpoint."""
    rng = random.Random(4)
    rows = sorted(rows, key=lambda r: (r[ts] or START) + timedelta(hours=rng.randrange(60)))  # late by less than three days
    size = -(-len(rows) // parts)
    chunks = [rows[i : i + size] for i in range(0, len(rows), size)]
    for half in (chunks[: parts // 2], [*chunks[parts // 2 :], [closing]]):
        for chunk in half:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run = start(stream)
        run.awaitTermination(300)
        assert run.exception() is None


RUNS = "id long, stage_name string, status string, started_at timestamp, items_processed long, duration_seconds long"


def test_stage_runs_equal_their_batch_form(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["audit", "scoring", "bounce_check"]), rng.choice(["success", "partial", "failed"]), START + timedelta(seconds=rng.randrange(20 * 86400)), rng.choice([None, 0, 3, 40, 55]), rng.choice([None, 7, 90])) for i in range(300)]
    rows += [(500, "audit", "success", rows[0][3], 1, 1), (501, "audit", "success", None, 1, 1)]
    closing = (-1, "closing", "success", START + timedelta(days=3000), None, None)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    fed_in_parts(spark, rows, RUNS, 3, str(tmp_path / "in"), lambda s: sinks.start(state.stage_run_stream(s, "4 days"), path, checkpoint, once=True), closing)
    frame = spark.createDataFrame(rows, RUNS).where("started_at is not null")
    rated = feeds.stage_anomalies(frame)
    told = {r.id for r in feeds.alert_cooldown(rated.where("anomaly").select("id", "stage_name", "started_at")).collect()}
    want = sorted((r.id, r.baseline, r.avg_duration, r.n_before, r.anomaly, r.id in told) for r in rated.collect())
    got = sinks.read_written(spark, path, state.RUN_OUT).where("id >= 0").collect()
    assert sorted((r.id, r.baseline, r.avg_duration, r.n_before, r.anomaly, r.told) for r in got) == want
    assert 3 < len(told) < sum(w[4] for w in want)


MAILS = "id long, email string, ts timestamp, dsn string, body string, subject string, sender string"


def test_bounces_equal_their_batch_form(spark, tmp_path):
    rng = random.Random(2)
    codes = ["4.2.2", "4.2.2", "4.7.1", "5.1.1", None]
    rows = [(i, f"u{rng.randrange(25)}@x.com", START + timedelta(seconds=rng.randrange(12 * 86400)), rng.choice(codes), "mailbox full", "Returned mail", "postmaster@x.org") for i in range(400)]
    rows += [(900 + i, *rows[i][1:]) for i in range(40)] + [(990, None, START, "4.2.2", "", "Returned mail", "x"), (991, "u1@x.com", None, "5.1.1", "", "Returned mail", "x"), (992, "u1@x.com", START, "5.1.1", "", "Hello", "bob@y.org")]
    closing = (-1, "closing", START + timedelta(days=3000), None, "", "bounce", "")
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    fed_in_parts(spark, rows, MAILS, 2, str(tmp_path / "in"), lambda s: sinks.start(state.bounce_stream(s, "4 days"), path, checkpoint, once=True), closing)
    frame = spark.createDataFrame(rows, MAILS).where("ts is not null and email is not null").where(feeds.is_bounce_notice(F.col("subject"), F.col("sender")))
    kind = feeds.classify_bounce(*(F.col(c) for c in ("dsn", "body", "subject", "sender"))).alias("bounce_type")
    want = feeds.bounce_actions(frame.select("id", "email", kind, "ts"))
    plain = lambda df: sorted(map(str, df.select("id", "email", "bounce_type", "ts", "n_soft", "suppress").collect()))
    got = sinks.read_written(spark, path, state.ACTION).where("email <> 'closing'")
    assert plain(got) == plain(want)
    suppressed = [r.email for r in got.where("suppress").collect()]
    promoted = {r.email for r in feeds.soft_bounce_promotion(feeds.bounce_dedup(frame.select("id", "email", kind, "ts"))).collect()}
    hard = {r.email for r in want.where("bounce_type <> 'soft_bounce'").collect()}
    assert len(suppressed) == len(set(suppressed)) and set(suppressed) == promoted | hard and promoted - hard


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "id long, domain string, website_url string"

    def add(lo, hi):
        spark.range(lo, hi).selectExpr("id", "concat('d', id) domain", "case when id % 4 > 0 then concat('https://d', id) end website_url").coalesce(1).write.mode("append").parquet(source)

    def run():
        sinks.crawl_backlog_stream(spark.readStream.schema(schema).parquet(source), path, checkpoint, once=True).awaitTermination(120)
        return sorted(r.id for r in sinks.read_written(spark, path, schema).collect())

    add(0, 40)
    first = run()
    assert first == [i for i in range(40) if i % 4]
    add(40, 60)
    assert run() == [i for i in range(60) if i % 4]
    # the crash: the last batch is written but not committed
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert run() == [i for i in range(60) if i % 4]
    add(60, 70)
    assert run() == [i for i in range(70) if i % 4]


REPLIES = "message_id string, in_reply_to string, subject string, ts timestamp, sender string, body string"


def test_replies_find_a_contact_added_between_batches(spark, tmp_path):
    source, path, checkpoint, people = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "contacts"))
    companies = spark.createDataFrame([(7, "shop.com"), (8, "other.org")], "id long, domain string")
    sent = spark.createDataFrame([(1, "<m1>", 9, 90, 900)], "id long, message_id string, company_id long, contact_id long, opportunity_id long")

    def contact(i, email, company):
        spark.createDataFrame([(i, email, company)], "id long, email string, company_id long").write.mode("append").parquet(people)

    context = lambda: (spark.read.parquet(people), companies, sent)

    def run(rows):
        spark.createDataFrame(rows, REPLIES).coalesce(1).write.mode("append").parquet(source)
        sinks.reply_stream(spark.readStream.schema(REPLIES).parquet(source), context, path, checkpoint, "2 days", once=True).awaitTermination(120)

    contact(1, "Ann@x.com", 5)
    run([
        ("<a>", None, "hi", START, "ann@X.com", "Sounds great, tell me more"),
        ("<a>", None, "hi", START, "ann@X.com", "Sounds great, tell me more"),
        ("<b>", None, "hi", START, "bob@new.net", "who is this?"),
        (None, "<m1>", "re", START, "cy@none.io", "please remove me"),
        ("", "<m1>", "re", START, "cy@none.io", "please remove me"),
    ])
    contact(2, "bob@new.net", 6)
    run([
        ("<b>", None, "hi", START, "bob@new.net", "who is this?"),
        ("<c>", None, "re: hi", START + timedelta(hours=1), "bob@new.net", "ok"),
        ("<d>", None, "hm", START + timedelta(hours=1), "eve@shop.com", "hm"),
        ("<e>", None, "hm", None, "eve@shop.com", "no time"),
    ])
    schema = sinks.reply_actions(spark.createDataFrame([], REPLIES), *context()).schema
    got = sorted((r.sender, r.subject, r.contact_id, r.company_id, r.opportunity_id, r.intent, r.offer_status, r.suppress) for r in sinks.read_written(spark, path, schema).collect())
    assert got == [
        ("ann@x.com", "hi", 1, 5, None, "positive_interest", "in_discussion", False),
        ("bob@new.net", "hi", None, None, None, "neutral_question", "in_discussion", False),
        ("bob@new.net", "re: hi", 2, 6, None, "positive_interest", "in_discussion", False),
        ("cy@none.io", "re", 90, 9, 900, "not_interested", "closed_lost", True),
        ("eve@shop.com", "hm", None, 7, None, "unknown", None, False),
    ]


@pytest.mark.parametrize("total, n, want", [(1, 3, 0.3333), (2, 3, 0.6667), (1, 20000, 0.0001), (0, 0, None), (25, 2, 12.5)])
def test_rounding_is_that_of_the_batch(total, n, want):
    assert state.rounded(total, n) == want
