from __future__ import annotations

import datetime as dt

import pytest

from parlance.streaming.alerts import alert_stream
from parlance.streaming.jobs import append_to, read_stream

SCHEMA = "ts timestamp_ntz, message string, who bigint, reaction string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def deliver(spark, tmp_path):
    """Writes a delivery, runs the stream from its checkpoint as after a restart, and gives all alerts so far."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(*rows):
        made = [(None if hour is None else START + dt.timedelta(hours=hour), message, 1 << 60, reaction) for hour, message, reaction in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        alerts = alert_stream(read_stream(spark, folder, SCHEMA), "ts", ["message", "who"], above=1, delay="1 hour", keep_hours=24)
        append_to(alerts, out, state).awaitTermination()
        found = spark.read.schema(alerts.schema).parquet(out).collect()
        assert all(r.who == 1 << 60 for r in found)
        return sorted((r.message or "", r.negative_count) for r in found)

    return run


def test_one_alert_over_restarts(deliver):
    assert deliver((0, "a", "sad"), (0, "b", "sad"), (0, "c", "like"), (0.1, "a", "angry")) == [("a", 2)]
    assert deliver((1, "a", "sad"), (1, "b", "shrug"), (1, "c", "sad")) == [("a", 2)]
    assert deliver((1.5, "b", "sad"), (1.5, "a", "sad"), (1.5, "c", None)) == [("a", 2), ("b", 2)]


def test_late_and_undated_reactions_are_left_out(deliver):
    assert deliver((0, "a", "sad"), (10, "b", "like")) == []
    assert deliver((2, "a", "sad"), (None, "a", "sad"), (9.5, "b", "sad")) == []
    assert deliver((9.6, "b", "sad")) == [("b", 2)]


def test_forgotten_messages_count_anew(deliver):
    assert deliver((0, "a", "sad"), (0, "a", "sad"), (0, "b", "sad")) == [("a", 2)]
    assert deliver((100, "z", "like")) == [("a", 2)]
    assert deliver((101, "z", "like")) == [("a", 2)]
    assert deliver((101, "b", "sad"), (101, "a", "sad"), (101, "a", "sad"), (101, "a", "sad")) == [("a", 2), ("a", 3)]


def test_many_reactions_and_missing_keys(deliver):
    rows = [(i / 1000, "hot", "sad" if i % 2 else "like") for i in range(900)]
    assert deliver(*rows, (0, None, "sad"), (0, None, "sad")) == [("", 2), ("hot", 450)]
