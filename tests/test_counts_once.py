"""A refresh moves whole texts only where it must, and counts what was written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.operators.counts import OpinionCounts
from parlance.operators.opinions import mine_opinions
from parlance.session import run_dir
from parlance.sources.buckets import BucketTable


def _answer():
    return mine_opinions(F.col("text"), [("QUALITY", ["good"]), ("PRICE", ["dear"])], ["good"], ["dear"])


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, text string")


def _counts(view):
    return {(r["classification"], r["sentiment"]): r["n_opinions"] for r in view.counts().collect()}


def test_single_rows_are_not_made_distinct(spark, monkeypatch):
    view, seen = OpinionCounts(spark, run_dir(spark, "once"), buckets=4), []
    docs = _docs(spark, (1, "good. dear"), (2, "good"), (None, "dear"))
    plain = type(docs).dropDuplicates
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda df, *a: seen.append(a) or plain(df, *a))
    view.refresh(docs, "id", "text", _answer())
    assert not seen
    assert _counts(view) == {("QUALITY", "Positive"): 2, ("PRICE", "Negative"): 2}
    view.refresh(_docs(spark, (1, "dear"), (1, "dear"), (2, "good")), "id", "text", _answer())
    assert seen
    assert _counts(view) == {("QUALITY", "Positive"): 1, ("PRICE", "Negative"): 1}
    assert sorted(r["key"] for r in view.answers.read().collect()) == [1, 2]


def test_repeated_rows_of_a_first_refresh(spark):
    view = OpinionCounts(spark, run_dir(spark, "twice"), buckets=4)
    view.refresh(_docs(spark, (1, "good"), (1, "good"), (None, "dear"), (None, "dear"), (3, None)), "id", "text", _answer(),
                 deleted=_docs(spark, (3, None)))
    assert _counts(view) == {("QUALITY", "Positive"): 1, ("PRICE", "Negative"): 1}


def test_a_version_counts_after_what_goes_before_it(spark):
    table = BucketTable(spark, run_dir(spark, "late"))
    rows = spark.range(6).withColumn("bucket", (F.col("id") % 2).cast("int"))
    table.replace(rows.where("id < 4"))

    def fail(written):
        assert written.count() == 3
        raise RuntimeError("cut short")

    with pytest.raises(RuntimeError):
        table.replace(rows.where("bucket = 0"), [0], fail)
    assert table.version() == 1 and table.read().count() == 4
    assert table.replace(rows.where("bucket = 0"), [0], lambda written: None) == 2
    assert table.read().count() == 5
