"""Alerts of very many messages take a call for a group of them, with the results of one state for each."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from parlance.streaming import alerts
from parlance.streaming.alerts import alert_stream
from parlance.streaming.jobs import append_to, read_stream


def test_calls_do_not_grow_with_messages(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    calls, real = spark.sparkContext.accumulator(0), alerts._watch

    def counting(*given):
        watch = real(*given)

        def run(*args):
            calls.add(1)
            yield from watch(*args)

        return run

    alerts._watch = counting
    try:
        for start in (0, 1000):
            spark.sql(f"select id, if(id % 7 = 0, null, id) as other, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 50) as ts, 'sad' as reaction "
                      f"from range({start}, {start + 2000}) where id % 3 = 0").write.mode("append").parquet(folder)
            stream = read_stream(spark, folder, "id bigint, other bigint, ts timestamp, reaction string")
            found = alert_stream(stream, "ts", ["id", "other"], above=1)
            append_to(found, out, state).awaitTermination()
    finally:
        alerts._watch = real
    rows = spark.read.schema(found.schema).parquet(out).collect()
    assert sorted((r.id, r.other, r.negative_count) for r in rows if r.other) == [(i, i, 2) for i in range(1000, 2000) if i % 3 == 0 and i % 7]
    assert sorted(r.id for r in rows if r.other is None) == [i for i in range(1000, 2000) if i % 21 == 0]
    assert found.schema.simpleString().startswith("struct<id:bigint,other:bigint,")


def test_few_calls(monkeypatch):
    held = {}

    class State(SimpleNamespace):
        exists = property(lambda self: "value" in held)
        get = property(lambda self: held["value"])

        def update(self, value):
            held["value"] = value

        def setTimeoutTimestamp(self, at):
            held["timer"] = at

        def remove(self):
            held.clear()

        def getCurrentWatermarkMs(self):
            return self.now

    watch = alerts._watch(["__key0"], 1, 100)
    frame = pd.DataFrame({"__key0": ["a", "b", None, "a"], "__n": [1, 1, 2, 1], "__ms": [10, 20, 30, 40]})
    found = pd.concat(watch((0,), iter([frame]), State(now=0)))
    assert sorted(zip(found["__key0"].fillna(""), found["negative_count"])) == [("", 2), ("a", 2)] and held["timer"] == 120
    # b has ended without new reactions; a has ended too, but reacts in this batch, so it is still known.
    again = pd.DataFrame({"__key0": ["a", "c"], "__n": [1, 0], "__ms": [200, 200]})
    assert list(watch((0,), iter([again]), State(now=180))) == [] and held["timer"] == 300
    assert list(watch((0,), iter([]), State(now=301))) == [] and not held
