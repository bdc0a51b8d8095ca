from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parlance.operators import feedback
from parlance.streaming.jobs import append_to, polarity_stream, read_stream

MESSAGES = {
    "m1": ["like", "like"], "m2": ["dislike", "dislike", "angry"], "m3": ["like"], "tie": ["like", "dislike"],
    "other": ["shrug", None], "emoji": ["👍", "❤️", "😡"], "none": [],
}
WANT = {
    "m1": (0, 2, "positive"), "m2": (3, 0, "negative"), "m3": (0, 1, "positive"), "tie": (1, 1, "neutral"),
    "other": (0, 0, "neutral"), "emoji": (1, 2, "positive"), "none": (0, 0, "neutral"),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(m, f"🤖 AI Agent says {m}" if m != "m3" else "AI Response", [(r, "u") for r in rs]) for m, rs in MESSAGES.items()]
    rows.append(("human", "hello", [("angry", "u")]))
    df = spark.createDataFrame(rows, "message_id string, body string, reactions array<struct<reactionType:string, user:string>>")
    return feedback.from_reaction_lists(df)


def test_lists(judged):
    got = {r.message_id: (r.negative_count, r.positive_count, r.sentiment) for r in judged.where("message_id != 'human'").collect()}
    assert got == WANT


@pytest.mark.parametrize("ties", ["neutral", "positive"])
def test_long_form(spark, ties):
    rows = [(m, r) for m, rs in MESSAGES.items() for r in rs]
    got = feedback.message_sentiment(spark.createDataFrame(rows, "message_id string, reaction string"), ["message_id"], ties=ties)
    want = {m: v for m, v in WANT.items() if m != "none"}
    want["tie"] = (1, 1, ties)
    assert {r.message_id: (r.negative_count, r.positive_count, r.sentiment) for r in got.collect()} == want


def test_summary_and_alerts(judged):
    total = feedback.summary(feedback.agent_messages(judged))
    assert tuple(total.first()) == (7, 1, 3, 3)
    assert feedback.alerts(total).count() == 1 and feedback.alerts(total, 1).count() == 0


def test_review_queue(spark, judged):
    tracked = spark.createDataFrame([("m1", "Q?", None)], "message_id string, query string, response string")
    queue = feedback.review_queue(feedback.agent_messages(judged), tracked, "message_id", "body",
                                  F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {r.message_id: (r.query, r.response, r.requires_review, r.recorded_at) for r in queue.collect()}
    assert got == {
        "m1": ("Q?", None, False, "2024-01-02T03:04:05"), "m2": ("Unknown", "🤖 AI Agent says m2", True, "2024-01-02T03:04:05"),
        "m3": ("Unknown", "AI Response", False, "2024-01-02T03:04:05"),
        "emoji": ("Unknown", "🤖 AI Agent says emoji", False, "2024-01-02T03:04:05")}
    record = json.loads(queue.where("message_id = 'm2'").select(feedback.as_record("message_id")).first()[0])
    assert record["sentiment"] == {"sentiment": "negative", "negative_count": 3, "positive_count": 0, "total_reactions": 3}


def test_stream_of_closed_windows_equals_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=3 * i), i % 3, ["like", "sad", "shrug"][i % 5 % 3]) for i in range(60)]
    schema = "ts timestamp_ntz, who bigint, reaction string"
    for part in (rows[:25], rows[25:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        counts = polarity_stream(read_stream(spark, folder, schema), "ts", ["who"])
        append_to(counts, out, state).awaitTermination()
    batch = spark.createDataFrame(rows, schema).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "who").agg(
        F.count_if(F.col("reaction") == "sad"), F.count_if(F.col("reaction") == "like"))
    last_closed = "2024-01-07"  # the last event is on the 8th
    want = {tuple(r) for r in batch.where(F.col("day") <= last_closed).collect()}
    got = [tuple(r)[:4] for r in spark.read.parquet(out).select("day", "who", "negative_count", "positive_count").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_reads_tables_of_one_and_of_several_files(spark, data, tmp_path):
    import shutil

    from parlance.plans import QUERIES

    one, several = tmp_path / "one", tmp_path / "several"
    one.mkdir()
    several.mkdir()
    shutil.copy(f"{data}/events.parquet", one / "events.parquet")
    spark.read.parquet(f"{data}/events.parquet").repartition(5).write.parquet(str(several / "events.parquet"))
    got = [sorted(map(tuple, QUERIES["feedback_stream"](spark, str(f)).collect())) for f in (one, several)]
    assert got[0] and got[0] == got[1]


def test_messages_without_reactions_are_neutral(spark):
    messages = spark.createDataFrame([("m1",), ("m2",)], "message_id string")
    judged = feedback.message_sentiment(spark.createDataFrame([("m1", "like")], "message_id string, reaction string"), ["message_id"])
    got = {r.message_id: (r.sentiment, r.total_reactions) for r in feedback.with_reactions(messages, judged, ["message_id"]).collect()}
    assert got == {"m1": ("positive", 1), "m2": ("neutral", 0)}
