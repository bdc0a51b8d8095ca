from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators.counts import OpinionCounts
from parlance.session import run_dir

SCHEMA = "id bigint, text string"


def _language():
    """What a text stands for: letters name classes, their case the sentiment.  Nested, so that it goes to the workers whole."""
    names = {"q": "QUALITY", "p": "PRICE", "x": "ELSEWHERE"}

    def meaning(text: str | None) -> list[tuple[str, str | None]]:
        return [(names[c.lower()], None if c == "P" else "Positive" if c.isupper() else "Negative") for c in text or "" if c.lower() in names]

    return meaning


_meaning = _language()


@pytest.fixture
def view(spark):
    asked, meaning = spark.sparkContext.accumulator(0), _language()

    @F.udf("string")
    def model(text):
        asked.add(1)
        if text in (None, "unreadable"):
            return text
        return json.dumps([{"classification": c, "comment": text, "sentiment": s} for c, s in meaning(text)])

    made = OpinionCounts(spark, run_dir(spark, "counts_test"), buckets=16)
    made.asked, made.model = asked, model.asNondeterministic()(F.col("text"))
    return made


def _want(rows) -> Counter:
    return Counter(o for _, text in dict.fromkeys(rows) if text != "unreadable" for o in _meaning(text) if o[0] != "ELSEWHERE")


def _got(view) -> Counter:
    return Counter({(r.classification, r.sentiment): r.n_opinions for r in view.counts().collect()})


STATES = [
    [(1, "q"), (2, "QQp"), (3, "x"), (None, "q"), (5, None), (6, ""), (7, "unreadable")],
    [(1, "Q"), (2, "QQp"), (3, "P"), (None, "pp"), (5, "q"), (7, "q"), (8, "qqq"), (8, "qqq")],
    [],
    [(2, "p")],
]


def test_every_snapshot_equals_a_recount(spark, view):
    for state in STATES:
        assert view.refresh(spark.createDataFrame(state, SCHEMA), "id", "text", view.model)
        assert _got(view) == _want(state)
    assert view.refresh(spark.createDataFrame(STATES[-1], SCHEMA), "id", "text", view.model) is None


def test_a_small_change_asks_and_rewrites_little(spark, view):
    rows = [(i, "qp"[i % 2] * (1 + i % 3)) for i in range(400)]
    view.refresh(spark.createDataFrame(rows, SCHEMA), "id", "text", view.model)
    assert view.asked.value == 400
    files = {r.bucket: r.v for r in view.answers.manifest()}
    rows[7], rows[8] = (7, "Q"), (8, "P")
    view.refresh(spark.createDataFrame(rows, SCHEMA), "id", "text", view.model)
    assert view.asked.value == 402 and _got(view) == _want(rows)
    assert sum(files[r.bucket] != r.v for r in view.answers.manifest()) <= 2


def test_deliveries_and_deletes(spark, view):
    rows = dict(STATES[1])
    view.refresh(spark.createDataFrame(list(rows.items()), SCHEMA), "id", "text", view.model)
    delivery, deleted = {1: "ppp", 9: "Q", 2: "q"}, [(2,), (None,), (77,)]
    view.refresh(spark.createDataFrame(list(delivery.items()), SCHEMA), "id", "text", view.model, partial=True,
                 deleted=spark.createDataFrame(deleted, "id bigint"))
    rows = {k: v for k, v in {**rows, **delivery}.items() if (k,) not in deleted}
    assert _got(view) == _want(list(rows.items()))


def test_a_refresh_cut_short_counts_nothing_twice(spark, view, monkeypatch):
    view.refresh(spark.createDataFrame(STATES[0], SCHEMA), "id", "text", view.model)
    after = spark.createDataFrame(STATES[1], SCHEMA)
    with monkeypatch.context() as broken:
        broken.setattr(view.answers, "replace", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            view.refresh(after, "id", "text", view.model)
    assert _got(view) == _want(STATES[0])
    view.refresh(after, "id", "text", view.model)
    assert _got(view) == _want(STATES[1])


def test_empty_at_first(spark, view):
    assert view.counts().count() == 0
    view.refresh(spark.createDataFrame([], SCHEMA), "id", "text", view.model)
    assert view.counts().count() == 0
