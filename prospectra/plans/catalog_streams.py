"""Streams over the given tables: the table is fed as a stream, and the written result is held against SQL over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.operators import feeds
from prospectra.operators.lineage import cut, shared_folder
from prospectra.plans import catalog as C
from prospectra.plans import catalog_flow as FLOW
from prospectra.plans import views as V
from prospectra.plans.catalog import query, sql_spaced
from prospectra.streaming import feeds as plain
from prospectra.streaming import sinks, state

#: Rows of a feed may come this late; the row that closes it is later still.
DELAY = "36500 days"


def fed(df: DataFrame, ts: str | None = None, **closing) -> DataFrame:
    """``df`` as a stream of files. With ``ts`` a last row far ahead lets the watermark pass all others; ``closing`` gives its other columns."""
    if ts:
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))  # event time has no other type
        last = df.agg(F.max(ts).alias(ts)).withColumn(ts, F.col(ts) + F.make_interval(years=F.lit(110)))
        row = last.select(*((F.col(c) if c == ts else F.lit(closing.get(c))).cast(t).alias(c) for c, t in df.dtypes))
        df = df.unionByName(row)
    table = cut(df, "fed")
    return df.sparkSession.readStream.schema(table.schema).parquet(table.cut_path)


def landed(spark, begin, schema=None) -> DataFrame:
    """Run a stream to its end: ``begin`` takes the folders of the table and of the checkpoint and starts it."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = begin(f"{folder}/table", f"{folder}/checkpoint")
    run.awaitTermination()
    return sinks.read_written(spark, f"{folder}/table", schema)


def written(spark, stream: DataFrame, *times: str) -> DataFrame:
    """The rows of a stream run to its end, with ``times`` as the tables have them."""
    out = landed(spark, lambda path, checkpoint: sinks.start(stream, path, checkpoint, once=True), stream.schema)
    return out.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


TOLD = sql_spaced(f"(SELECT id, stage_name, started_at FROM ({C.ANOMALY}) a WHERE anomaly)", "stage_name", "started_at", 4 * 3600)
query("stage_run_stream", f"SELECT a.*, a.id IN (SELECT id FROM ({TOLD}) t) AS told FROM ({C.ANOMALY}) a")(
    lambda spark, d: written(spark, state.stage_run_stream(fed(V.frame(spark, d, V.RUNS), "started_at", stage_name="closing", status="success"), DELAY), "started_at").where("stage_name <> 'closing'")
)
KEPT = sql_spaced(f"(SELECT id, email, {C.BTYPE} AS bounce_type, ts FROM {V.sql(V.BOUNCES)} v WHERE {C.NOTICE})", "email, bounce_type", "ts", 86400)
RUNNING = "OVER (PARTITION BY email ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"
ACTIONS = (
    f"SELECT id, email, bounce_type, ts, n_soft, due AND count(*) FILTER (due) {RUNNING} = 1 AS suppress FROM "
    f"(SELECT *, bounce_type <> 'soft_bounce' OR n_soft >= 3 AS due FROM (SELECT *, count(*) FILTER (bounce_type = 'soft_bounce') {RUNNING} AS n_soft FROM ({KEPT}) k) n) a"
)
query("bounce_actions", ACTIONS)(lambda spark, d: feeds.bounce_actions(C.bounces(spark, d).select("id", "email", "bounce_type", "ts")))
query("bounce_stream", ACTIONS)(
    lambda spark, d: written(spark, state.bounce_stream(fed(V.frame(spark, d, V.BOUNCES), "ts", id=-1, email="closing", subject="bounce"), DELAY), "ts").where("email <> 'closing'")
)
query("send_rate_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_sent FROM events GROUP BY 1")(
    lambda spark, d: written(spark, plain.send_rate_stream(fed(spark.read.parquet(f"{d}/events.parquet").select("ts"), "ts")))
    .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_sent")
    .where("day < '2100'")
)
query("crawl_backlog_stream", f"SELECT id, domain, website_url FROM {V.sql(V.COMPANIES)} v WHERE website_url IS NOT NULL")(
    lambda spark, d: landed(spark, lambda path, checkpoint: sinks.crawl_backlog_stream(fed(V.frame(spark, d, V.COMPANIES)), path, checkpoint, once=True), "id long, domain string, website_url string")
)

INBOX = """
SELECT CASE m % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'mid' || CAST(m AS STRING) END AS message_id, CASE WHEN m % 3 = 0 THEN 'm' || CAST(m % 500 AS STRING) END AS in_reply_to, 'note ' || CAST(m % 7 AS STRING) AS subject, e.ts,
  CASE user_id % 4 WHEN 0 THEN 'p' || CAST(m % 900 AS STRING) || '@x.com' WHEN 1 THEN 'sue@biz' || CAST(m % 300 AS STRING) || '.com' WHEN 2 THEN 'bob@z.com' ELSE 'no address' END AS sender,
  CASE m % 8 WHEN 0 THEN 'I am out of the office' WHEN 1 THEN 'Please remove me from this' WHEN 2 THEN 'Sounds great, tell me more' WHEN 3 THEN 'Who is this?' WHEN 4 THEN 'ok' WHEN 5 THEN 'We already have a team' WHEN 6 THEN 'Yes' ELSE 'hm' END AS body
FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS m FROM {events}) q JOIN {events} e ON e.event_id = q.m
"""
REPLY = (
    f"SELECT DISTINCT r.sender, r.subject, r.ts, r.message_id, coalesce(k.contact_id, t.contact_id) AS contact_id, coalesce(k.company_id, h.company_id, t.company_id) AS company_id, t.opportunity_id, intent, confidence, "
    "CASE WHEN intent IN ('positive_interest', 'neutral_question') THEN 'in_discussion' WHEN intent = 'not_interested' THEN 'closed_lost' END AS offer_status, intent = 'not_interested' AS suppress "
    f"FROM (SELECT *, {C.sql_case(C.INTENT(0), "'unknown'")} AS intent, CAST({C.sql_case(C.INTENT(1), '0.5')} AS DOUBLE) AS confidence FROM {V.sql(INBOX)} i) r "
    f"LEFT JOIN (SELECT lower(email) AS email, min(id) AS contact_id, arg_min(company_id, id) AS company_id FROM {V.sql(FLOW.HEARD)} p GROUP BY lower(email)) k ON k.email = r.sender "
    f"LEFT JOIN (SELECT host, min(c.id) AS company_id FROM (SELECT DISTINCT regexp_extract(sender, '@(.*)$', 1) AS host FROM {V.sql(INBOX)} r2) q JOIN {V.sql(V.COMPANIES)} c ON host <> '' AND contains(lower(c.domain), host) GROUP BY host) h ON h.host = regexp_extract(r.sender, '@(.*)$', 1) "
    f"LEFT JOIN (SELECT message_id, arg_min(company_id, id) AS company_id, arg_min(contact_id, id) AS contact_id, arg_min(opportunity_id, id) AS opportunity_id FROM {V.sql(FLOW.THREADS)} m GROUP BY message_id) t ON t.message_id = r.in_reply_to"
)
REPLY_COLUMNS = ("sender", "subject", "ts", "message_id", "contact_id", "company_id", "opportunity_id", "intent", "confidence", "offer_status", "suppress")


@query("reply_stream", REPLY)
def replies(spark, d: str) -> DataFrame:
    context = lambda: tuple(V.frame(spark, d, v) for v in (FLOW.HEARD, V.COMPANIES, FLOW.THREADS))
    inbox = V.frame(spark, d, INBOX)
    inbox = inbox.withColumn("ts", F.col("ts").cast("timestamp"))  # event time has no other type
    schema = sinks.reply_actions(inbox, *context()).schema
    out = landed(spark, lambda path, checkpoint: sinks.reply_stream(fed(inbox), context, path, checkpoint, DELAY, once=True), schema)
    return out.select(*REPLY_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
