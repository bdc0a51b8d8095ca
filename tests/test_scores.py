"""Lexical scores split each text into words once."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.evaluate import distinct_words, lexical_scores
from parlance.plans.registry import QUERIES


def test_runs_share_the_words_of_a_record(spark, data):
    plan = QUERIES["eval_scores"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "regexp_extract_all" not in above
    assert below.count("regexp_extract_all") == 3


def test_given_words_score_like_texts(spark):
    rows = [("Is it on?", "It is on, on http", "is on http"), ("", "", ""), ("a a b", "b that c", None), (None, "x", "x"), ("q", None, "q")]
    records = spark.createDataFrame(rows, "question string, answer string, context string")
    split = records.select("*", *[distinct_words(F.col(c)).alias(f"{c}_words") for c in ("question", "answer", "context")])
    for blocked, tools in ((["on"], ["that"]), ([], [])):
        plain = lexical_scores(records, blocked, tools)
        given = lexical_scores(split, blocked, tools, tokens=("question_words", "answer_words", "context_words"))
        assert given.columns == plain.columns
        assert sorted(map(str, given.collect())) == sorted(map(str, plain.collect()))
    first = lexical_scores(records, ["on"], ["that"]).first()
    assert (first.groundedness, first.relevance, first.safety, first.guidelines) == (0.75, 1.0, 0.0, 1.0)
    assert lexical_scores(records, [], []).where("safety = 1").count() >= 3
