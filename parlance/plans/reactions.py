"""Feedback: an event is a reaction to the message of its user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import feedback
from parlance.plans.registry import Tables, query
from parlance.session import run_dir
from parlance.streaming.alerts import alert_stream
from parlance.streaming.jobs import append_to, polarity_stream, read_stream, read_table_stream

POSITIVE, NEGATIVE = ["purchase", "signup"], ["error"]
MARKERS = ["BUILDING", "MACHINERY"]
ALERT_ABOVE = 5
RECORDED_AT = "2024-02-01 00:00:00"

_JUDGED = """
    c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
                 count(*) FILTER (event_type = 'error') AS negative_count,
                 count(*) FILTER (event_type IN ('purchase', 'signup')) AS positive_count FROM events GROUP BY ALL),
    j AS (SELECT *, negative_count + positive_count AS total_reactions,
                 CASE WHEN negative_count > positive_count THEN 'negative' WHEN positive_count > negative_count THEN 'positive'
                      ELSE 'neutral' END AS sentiment FROM c)"""
_BODY = """b AS (SELECT c_custkey AS user_id, day, coalesce(negative_count, 0) AS negative_count, coalesce(positive_count, 0) AS positive_count,
    coalesce(total_reactions, 0) AS total_reactions, coalesce(sentiment, 'neutral') AS sentiment, c_name || ' / ' || c_mktsegment AS body
    FROM customer LEFT JOIN j ON user_id = c_custkey)"""
_AGENT = "(contains(body, 'BUILDING') OR contains(body, 'MACHINERY'))"
_COUNTS = """count(*) AS total_checked, count(*) FILTER (sentiment = 'negative') AS negative_feedback,
    count(*) FILTER (sentiment = 'positive') AS positive_feedback, count(*) FILTER (sentiment = 'neutral') AS neutral_feedback"""


def _judged(t: Tables) -> DataFrame:
    events = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return feedback.message_sentiment(events, ["user_id", "day"], POSITIVE, NEGATIVE, "event_type")


def _agent_messages(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.concat_ws(" / ", "c_name", "c_mktsegment").alias("body"))
    # The marker filter runs on the customers, before the join.  Customers without reactions are messages too.
    return feedback.with_reactions(feedback.agent_messages(customers, markers=MARKERS), _judged(t), ["user_id"])


@query(f"WITH {_JUDGED} SELECT user_id, day, negative_count, positive_count, total_reactions, sentiment FROM j")
def feedback_sentiment(t: Tables) -> DataFrame:
    return _judged(t)


@query(f"WITH {_JUDGED}, {_BODY} SELECT {_COUNTS} FROM b WHERE {_AGENT}")
def feedback_summary(t: Tables) -> DataFrame:
    return feedback.summary(_agent_messages(t))


@query(f"""
    WITH {_JUDGED}, {_BODY}
    SELECT user_id, day, coalesce(text, 'Unknown') AS query, CASE WHEN text IS NULL THEN body ELSE 'Answer ' || item_id END AS response,
           sentiment, negative_count, positive_count, total_reactions, sentiment = 'negative' AS requires_review,
           '2024-02-01T00:00:00' AS recorded_at
    FROM b LEFT JOIN benchmark ON item_id = user_id WHERE {_AGENT} AND sentiment <> 'neutral'""")
def feedback_review_queue(t: Tables) -> DataFrame:
    """The queue is written as nested JSON records and read back."""
    tracked = t.benchmark.select(
        F.col("item_id").alias("user_id"), F.col("text").alias("query"),
        F.concat(F.lit("Answer "), F.col("item_id").cast("string")).alias("response"))
    queue = feedback.review_queue(_agent_messages(t), tracked, "user_id", "body", F.lit(RECORDED_AT).cast("timestamp"))
    path = run_dir(t.spark, "review_queue")
    queue.select(feedback.as_record("user_id", "day", "requires_review").alias("value")).write.text(path)
    read = t.spark.read.schema(feedback.RECORD_SCHEMA.format("user_id bigint", "day string, requires_review boolean")).json(path)
    return read.select("user_id", "day", "query", "response", "sentiment.*", "requires_review", F.col("timestamp").alias("recorded_at"))


@query(f"""
    WITH {_JUDGED}
    SELECT day, {_COUNTS} FROM j GROUP BY day HAVING count(*) FILTER (sentiment = 'negative') > {ALERT_ABOVE}""")
def feedback_alerts(t: Tables) -> DataFrame:
    return feedback.alerts(feedback.summary(_judged(t), ["day"]), ALERT_ABOVE)


@query(f"WITH {_JUDGED} SELECT day, {_COUNTS} FROM j GROUP BY day")
def feedback_trend(t: Tables) -> DataFrame:
    dated = _judged(t).withColumn("at", F.col("day").cast("timestamp"))
    return feedback.trend(dated, "at")


@query(f"""
    WITH {_JUDGED}
    SELECT user_id, day, negative_count, positive_count, total_reactions FROM j
    WHERE day::TIMESTAMP + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def feedback_stream(t: Tables) -> DataFrame:
    """Daily counts from a stream; the last day stays open because its watermark has not passed."""
    out, state = run_dir(t.spark, "feedback_stream_out"), run_dir(t.spark, "feedback_stream_state")
    events = read_table_stream(t.spark, f"{t.folder}/events.parquet")
    counts = polarity_stream(events, "ts", ["user_id"], positive=POSITIVE, negative=NEGATIVE, reaction_col="event_type")
    append_to(counts, out, state).awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(out)


@query(f"WITH {_JUDGED} SELECT user_id, day FROM j WHERE negative_count > 1")
def feedback_alert_stream(t: Tables) -> DataFrame:
    """One alert per message with more than one negative reaction, over two deliveries with a restart between them."""
    folder, out, state = (run_dir(t.spark, f"feedback_alerts_{part}") for part in ("in", "out", "state"))
    events = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_type")
    for delivery in ("day < '2024-01-16'", "day >= '2024-01-16'"):
        events.where(delivery).write.mode("append").parquet(folder)
        stream = read_stream(t.spark, folder, events.schema)
        # The files of a delivery come in any order, so the delay covers a delivery.
        alerts = alert_stream(stream, "ts", ["user_id", "day"], above=1, delay="16 days", negative=NEGATIVE, reaction_col="event_type")
        append_to(alerts, out, state).awaitTermination()
    return t.spark.read.schema(alerts.schema).parquet(out).select("user_id", "day")
