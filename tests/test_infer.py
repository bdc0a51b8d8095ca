from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.operators.infer import embed_distinct, embed_text, safe_infer, timed_infer


def make_shout():
    def shout(texts):
        for t in texts:
            if "bad" in t:
                raise ValueError(f"cannot read {t}")
        return [t.upper() for t in texts]

    return shout


shout = make_shout()  # a closure travels to the workers by value


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, "bad b"), (3, None), (4, "c")], "id bigint, text string")


def test_one_failure_does_not_touch_its_batch(rows):
    got = {r.id: (r.response, r.error) for r in safe_infer(rows.coalesce(1), "text", shout, keep=["id"]).collect()}
    assert got == {1: ("A", None), 2: (None, "cannot read bad b"), 3: (None, None), 4: ("C", None)}


def test_error_as_text(rows):
    got = {r.id: r.response for r in safe_infer(rows, "text", shout, keep=["id"], error_text=True).collect()}
    assert got[2] == "Error: cannot read bad b" and got[1] == "A"


def test_wrong_number_of_answers_is_an_error(rows):
    got = safe_infer(rows.where("id = 1"), "text", lambda texts: [], keep=["id"]).first()
    assert got.response is None and got.error


def test_limit_is_below_the_model(spark, rows):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return texts

    assert safe_infer(rows, "text", counted, limit=2, order=[F.col("id")]).count() == 2
    safe_infer(rows, "text", counted, limit=2, order=[F.col("id").desc()]).collect()
    assert calls.value <= 4


def test_model_is_planned_once(rows):
    plan = safe_infer(rows, "text", shout).where("error IS NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_seconds(rows):
    times = {r.id: r.seconds for r in timed_infer(rows, "text", shout, ["id"]).collect()}
    assert times[1] >= 0 and times[3] is None


def test_embeddings(spark, rows):
    got = {r.id: r.embedding for r in embed_text(rows, "text").collect()}
    assert got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    twice = rows.unionByName(rows)
    assert embed_distinct(twice, "text").count() == 3


def test_a_bad_text_repeats_only_its_own_request(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(texts):
        with open(log, "a") as file:
            file.write("x" * len(texts))
        if "bad" in texts:
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(f"t{i}" if i else "bad",) for i in range(1000)], "text string").coalesce(1)
    got = safe_infer(rows, "text", model, request_size=20).collect()
    assert sum(r.error is not None for r in got) == 1 and len(got) == 1000
    with open(log) as file:
        assert len(file.read()) <= 1020


def test_a_model_may_return_errors(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    got = {r.input: (r.response, r.error) for r in safe_infer(rows, "text", lambda ts: [ValueError("no") if t == "a" else t for t in ts]).collect()}
    assert got == {"a": (None, "no"), "b": ("b", None)}
