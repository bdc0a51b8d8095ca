from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions.text import html_text, html_title, sentiment_label, url_host
from parlance.operators import opinions


def one(spark, column):
    return spark.range(1).select(column).first()[0]


GOOD = '[{"classification": "PRICE", "comment": "c", "sentiment": "Positive"}]'


@pytest.mark.parametrize("answer, want", [
    (GOOD, [("PRICE", "c", "Positive")]),
    ('[{"Classification": "PRICE", "COMMENT": "c", "Sentiment": "Positive"}]', [("PRICE", "c", "Positive")]),
    ("[{'classification': 'PRICE', 'comment': 'c', 'sentiment': 'Positive'}]", [("PRICE", "c", "Positive")]),
    (GOOD[1:-1], [("PRICE", "c", "Positive")]),
    ('[{"other": 1}]', [(None, None, None)]),
    ("[]", []), ("I cannot say", None), ("```json\n[]\n```", None), (None, None),
])
def test_parse(spark, answer, want):
    got = one(spark, opinions.parse_opinions(F.lit(answer).cast("string")))
    assert (got if got is None else [tuple(o) for o in got]) == want


def test_explode_allow_list_and_rejects(spark):
    rows = [
        (1, json.dumps([{"classification": c, "comment": "x", "sentiment": "Mixed"} for c in ("PRICE", "price", None, "OTHER")])),
        (2, "[]"), (3, "no json"), (4, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, extracted_opinions string")
    got = opinions.explode_opinions(df)
    assert got.columns == ["classification", "comment", "sentiment", "id", "extracted_opinions"]
    assert sorted((r.id, r.classification) for r in got.collect()) == [(1, "OTHER"), (1, "PRICE")]
    assert tuple(opinions.opinion_rejects(df).first()) == (1, 1, 2)


def test_prompt(spark):
    assert one(spark, opinions.opinion_prompt(F.lit("it's good"), "Do:\n")) == "Do:\nit's good\n\nRESULT\n"
    assert one(spark, opinions.opinion_prompt(F.lit(None).cast("string"), "Do")) is None


@pytest.mark.parametrize("text, label", [
    ("Good, GOOD day", "positive"), ("bad", "negative"), ("good bad", "mixed"), ("none", "neutral"), ("", "neutral"), (None, None)])
def test_sentiment(spark, text, label):
    assert one(spark, sentiment_label(F.lit(text).cast("string"), ["good"], ["bad"])) == label


def test_mining_is_whole(spark):
    text = "Price is fine! The good screen.\n\nThe bad screen?  . "
    found = json.loads(one(spark, opinions.mine_opinions(
        F.lit(text), [("DESIGN", ["screen"]), ("PRICE", ["price", "screen"])], ["good"], ["bad"])))
    assert [(o["classification"], o["comment"], o["sentiment"]) for o in found] == [
        ("PRICE", "Price is fine", "Neutral"), ("DESIGN", "The good screen", "Positive"), ("DESIGN", "The bad screen", "Negative")]


def test_refresh_never_asks_twice(spark, schema_name):
    table = f"{schema_name}.answers"
    answer = F.concat(F.lit('[{"classification": "OTHER", "comment": "'), F.col("text"), F.lit('", "sentiment": "Mixed"}]'))

    def docs(*rows):
        return spark.createDataFrame(list(rows), "id bigint, text string")

    def refresh(source):
        opinions.refresh_answers(source, table, "id", "text", answer)
        return sorted((r.id, r.comment) for r in opinions.current_opinions(source, table, "id", "text").collect())

    assert refresh(docs((1, "a"), (2, "b"))) == [(1, "a"), (2, "b")]
    last = docs((2, "B"), (3, "c"))
    assert refresh(last) == [(2, "B"), (3, "c")]
    assert refresh(last) == [(2, "B"), (3, "c")]
    assert spark.table(table).count() == 4


def test_pages(spark):
    html = ("<html><head><title> A &amp;lt; B </title><style>x{}</style></head><body><!-- <p>no</p> --><header>Top</header>"
            "<script>var a = '<b>';</script><p>1&nbsp;&lt; 2\n\n<b>bold</b></p></body></html>")
    assert one(spark, html_title(F.lit(html))) == "A &lt; B"
    assert one(spark, html_text(F.lit(html))) == "Top 1 < 2 bold"
    assert one(spark, url_host(F.lit("https://a.example.org:80/x?y#z"))) == "a.example.org"


def test_summary_tells_missing_values_from_totals(spark):
    from parlance.operators.opinions import opinion_summary

    rows = spark.createDataFrame([("QUALITY", None), ("QUALITY", "Positive")], "classification string, sentiment string")
    got = {(r.classification, r.sentiment): r.n_opinions for r in opinion_summary(rows).collect()}
    assert got == {("QUALITY", "UNKNOWN"): 1, ("QUALITY", "Positive"): 1, ("QUALITY", "ALL"): 2, ("ALL", "ALL"): 2}
