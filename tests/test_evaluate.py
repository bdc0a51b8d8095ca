from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import evaluate


def test_questions_follow_the_order(spark):
    df = spark.createDataFrame([(i, f"u{i}@x") for i in range(25)], "id bigint, email string").repartition(4)
    got = evaluate.questions(df, [F.col("id").desc()], ["A {email}?", "B {email}?", "C"], email="email").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(25))
    assert [r.question for r in got[:4]] == ["A u24@x?", "B u23@x?", "C", "A u21@x?"]


def test_prompt_skips_null_fields(spark):
    prompt = evaluate.judge_prompt([F.lit("a"), F.lit(None).cast("string"), F.lit("b")], F.lit("q?"), "Open:", "Do.")
    assert spark.range(1).select(prompt).first()[0] == "Open: a, b Do. Question: q?"


def test_facts(spark):
    rows = [(1, '["x", "y"]'), (2, "no"), (3, "[]"), (4, None)]
    got = spark.createDataFrame(rows, "id int, a string").select("id", evaluate.expected_facts(F.col("a")).alias("f")).collect()
    assert {r.id: r.f for r in got} == {1: ["x", "y"], 2: None, 3: [], 4: None}


def test_records_shape(spark):
    df = spark.createDataFrame([("q", ["f"])], "question string, expected_facts array<string>")
    row = evaluate.eval_records(df).first()
    assert (row.inputs.question, row.predictions, row.expectations.expected_facts) == ("q", "", ["f"])


def test_upsert(spark):
    def frame(*rows):
        return spark.createDataFrame(list(rows), "k string, v bigint")

    first = evaluate.upsert(None, frame(("a", 2), ("a", 1), ("b", 1)), "k", [F.col("v")])
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 1)]
    second = evaluate.upsert(first, frame(("b", 9), ("c", 3)), "k", [F.col("v")])
    assert sorted(map(tuple, second.collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, evaluate.upsert(second, second, "k", [F.col("v")]).collect())) == sorted(map(tuple, second.collect()))


def test_scores(spark):
    rows = [
        (1, "where is it", "It is in the shed", "the shed is big http://x"),
        (2, "where", "from the database http://x", "http://x"), (3, "where", "damn", ""), (4, "", "", ""),
    ]
    df = spark.createDataFrame(rows, "id bigint, question string, answer string, context string")
    got = {r.id: (round(r.groundedness, 2), round(r.relevance, 2), r.safety, r.guidelines)
           for r in evaluate.lexical_scores(df, ["damn"], ["database"]).collect()}
    assert got == {1: (0.6, 0.67, 1.0, 0.0), 2: (0.4, 0.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0, 1.0), 4: (0.0, 0.0, 1.0, 1.0)}


def test_citation_check(spark):
    text = F.lit("see [SOURCE URL: https://docs.example.org/x]")
    row = spark.range(1).select(
        evaluate.is_cited(text, "[SOURCE URL:", "docs.example.org"), evaluate.is_cited(text, "[SOURCE URL:", "other.org")).first()
    assert tuple(row) == (True, False)


def test_metrics_and_comparison(spark):
    scored = spark.createDataFrame([("a", 1.0, 0.5), ("a", 0.0, None), ("b", 0.25, None)], "run string, s double, g double")
    metrics = evaluate.run_metrics(scored, ["s", "g"])
    got = {r.metric: (r.value_1, r.value_2, r.shown_1, r.shown_difference) for r in evaluate.compare_runs(metrics, "a", "b").collect()}
    assert got == {"s": (0.5, 0.25, "0.500", "+0.250"), "g": (0.5, 0.0, "0.500", "+0.500")}
    assert {r.metric for r in evaluate.compare_runs(metrics, "b", "a").collect()} == {"s"}  # the first run decides


def test_numeric_only(spark):
    df = spark.createDataFrame([("a", "1.5"), ("b", "high"), ("c", None)], "metric string, value string")
    assert [tuple(r) for r in evaluate.numeric_only(df).collect()] == [("a", 1.5)]


def test_upsert_replaces_null_keys(spark):
    from parlance.operators.evaluate import upsert

    rows = spark.createDataFrame([(None, 1), ("a", 1)], "k string, v bigint")
    for _ in range(2):
        assert sorted((str(r.k), r.v) for r in upsert(rows, rows, "k", [F.col("v")]).collect()) == [("None", 1), ("a", 1)]


def test_compare_leaves_text_metrics_out(spark):
    from parlance.operators.evaluate import compare_runs

    rows = spark.createDataFrame([("a", "m", "0.5"), ("b", "m", "0.25"), ("a", "model", "x"), ("b", "model", "x")], "run string, metric string, value string")
    assert [(r.metric, r.difference) for r in compare_runs(rows, "a", "b").collect()] == [("m", 0.25)]


def test_judge(spark):
    from parlance.operators.evaluate import judged_scores

    rows = spark.createDataFrame([("a", "yes"), ("b", "no")], "q string, a string")
    got = judged_scores(rows, lambda ps: ["1" if "yes" in p else "unsure" for p in ps], F.concat_ws(" ", "q", "a"), "s")
    assert {r.q: r.s for r in got.collect()} == {"a": 1.0, "b": None}
