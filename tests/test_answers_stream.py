"""What a delivery of answers shuffles and computes: rows of keys that come once are not ranked, words are counted once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parlance.operators import opinions
from parlance.session import run_dir
from parlance.streaming import jobs

SCHEMA = "id bigint, text string, delivery int"


def order():
    return F.struct("delivery", "text")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_come_once_are_not_ranked(spark, tmp_path):
    path = str(tmp_path / "once")
    spark.createDataFrame([(i, f"t{i}", 0) for i in range(50)], SCHEMA).write.parquet(path)
    last = jobs._latest(spark.read.parquet(path), "id", order())
    assert "Window" not in plan(last)
    assert last.count() == 50


@pytest.mark.parametrize("small", [True, False])
def test_latest_of_repeated_and_missing_keys(spark, monkeypatch, small):
    rows = [(1, "a", 0), (1, "b", 1), (2, "c", 0), (None, "n", 0), (None, "m", 1), (3, "d", 0), (3, "e", 0), (3, None, 0), (4, None, 2)]
    monkeypatch.setattr(jobs, "is_small", lambda df: small)
    got = jobs._latest(spark.createDataFrame(rows, SCHEMA), "id", order())
    assert got.columns == ["id", "text", "delivery"]
    assert {tuple(r) for r in got.collect()} == {(1, "b", 1), (2, "c", 0), (None, "m", 1), (3, "e", 0), (4, None, 2)}
    assert got.count() == 5


@pytest.mark.parametrize("small", [True, False])
def test_stream_answers_new_and_changed_texts_once(spark, schema_name, monkeypatch, small):
    monkeypatch.setattr(opinions, "is_small", lambda df: small)
    table, folder, state = f"{schema_name}.answers", run_dir(spark, "in"), run_dir(spark, "state")
    answer = F.concat(F.lit('[{"classification": "OTHER", "comment": "'), F.col("text"), F.lit('", "sentiment": "Mixed"}]'))
    for rows in ([(1, "a", 0), (2, "b", 0), (2, "B", 1)], [(2, "B", 2), (3, "c", 2), (1, "A", 2), (1, "a", 1)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, SCHEMA)
        jobs.answers_stream(stream, table, "id", "text", answer, state, order()).awaitTermination()
    asked = [(r.id, json.loads(r.extracted_opinions)[0]["comment"]) for r in spark.table(table).collect()]
    assert sorted(asked) == [(1, "A"), (1, "a"), (2, "B"), (3, "c")]


def test_words_of_a_sentence_are_counted_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([("The bad one. The the good, good bad! None",)], "text string").write.parquet(path)
    mined = spark.read.parquet(path).select(opinions.mine_opinions(
        F.col("text"), [("DESIGN", ["one"]), ("PRICE", ["none", "one"])], ["good", "the"], ["bad"]).alias("a"))
    # Sentences, listed words, positive words, negative words.
    assert plan(mined).count("filter(") == 4
    assert [tuple(o.values()) for o in json.loads(mined.first().a)] == [
        ("DESIGN", "The bad one", "Mixed"), ("OTHER", "The the good, good bad", "Positive"), ("PRICE", "None", "Neutral")]


def test_plain_and_odd_keys_in_one_answer(spark):
    answer = '[{"classification":"A","comment":"say \\"COMMENT\\": x","sentiment":"S"},{"Classification" :"B","COMMENT":"c","sentiment" : "T"}]'
    got = spark.range(1).select(opinions.parse_opinions(F.lit(answer))).first()[0]
    assert [tuple(o) for o in got] == [("A", 'say "COMMENT": x', "S"), ("B", "c", "T")]
