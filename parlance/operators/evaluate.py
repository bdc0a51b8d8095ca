"""Evaluation sets, lexical scorers and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.models import ModelFn
from parlance.functions.text import fill_template, has_any, words
from parlance.operators.infer import safe_infer
from parlance.sizing import number_rows


def questions(df: DataFrame, order: list[Column], templates: list[str], **fields: str) -> DataFrame:
    """Adds ``row_id`` (0, 1, 2 ... in the given order) and the ``question`` of template ``row_id mod n``."""
    numbered = number_rows(df, order)
    return numbered.withColumn(
        "question", fill_template(templates, F.col("row_id"), **{n: F.col(c).cast("string") for n, c in fields.items()}))


def judge_prompt(record: list[Column], question: Column, opening: str, task: str) -> Column:
    """Opening, the record's fields (NULL ones left out), the task and the question."""
    return F.concat_ws(" ", F.lit(opening), F.concat_ws(", ", *record), F.lit(task), F.lit("Question:"), question)


def expected_facts(answer: Column) -> Column:
    """A JSON array of strings; anything else is NULL."""
    return F.from_json(answer, T.ArrayType(T.StringType()))


def eval_records(df: DataFrame, question: str = "question", facts: str = "expected_facts") -> DataFrame:
    """``inputs.question``, empty ``predictions``, ``expectations.expected_facts``."""
    return df.select(
        F.struct(F.col(question).alias("question")).alias("inputs"),
        F.lit("").alias("predictions"),
        F.struct(F.col(facts).alias("expected_facts")).alias("expectations"),
    )


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Existing rows, replaced where ``incoming`` has the key, plus its new keys.

    Several incoming rows of one key count as one: the first in the given order, chosen before the shuffle.
    """
    rest = [c for c in incoming.columns if c != key]
    latest = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(key, "__row.*")
    if existing is None:
        return latest
    known = latest.select(F.col(key).alias("__key"))
    return existing.join(known, F.col(key).eqNullSafe(F.col("__key")), "left_anti").unionByName(latest)


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def _shared(own: Column, others: Column) -> Column:
    """Share of the tokens (distinct) that occur among the others; no tokens share nothing."""
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, others)) / F.size(own)).otherwise(F.lit(0.0))


def lexical_scores(
    records: DataFrame,
    blocked: list[str],
    tool_words: list[str],
    source_marker: str = "http",
    question: str = "question",
    answer: str = "answer",
    context: str = "context",
    tokens: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Four scores in [0, 1] per record; local rules in place of a judging model.

    groundedness: answer words found in the context.  relevance: question words found in the answer.
    safety: no blocked word.  guidelines: no tool word, and a source when the context has one.

    ``tokens`` names columns that hold the distinct words of question, answer and context already; they are dropped.
    """
    q, a, c = (F.col(t) for t in tokens) if tokens else (distinct_words(F.col(t)) for t in (question, answer, context))
    cites = ~F.contains(F.col(context), F.lit(source_marker)) | F.contains(F.col(answer), F.lit(source_marker))
    return (
        records.withColumn("__a", a).withColumn("__q", q).withColumn("__c", c)
        .withColumn("groundedness", _shared(F.col("__a"), F.col("__c")))
        .withColumn("relevance", _shared(F.col("__q"), F.col("__a")))
        .withColumn("safety", F.when(~has_any(F.col("__a"), blocked), 1.0).otherwise(0.0))
        .withColumn("guidelines", F.when(~has_any(F.col("__a"), tool_words) & cites, 1.0).otherwise(0.0))
        .drop("__a", "__q", "__c", *(tokens or ()))
    )


def judged_scores(records: DataFrame, judge: ModelFn, prompt: Column, score: str) -> DataFrame:
    """Adds the score that a judging model gives each record; NULL where it fails or answers no number."""
    named = records.withColumn("__prompt", prompt)
    called = safe_infer(named, "__prompt", judge, keep=records.columns)
    return called.select(*records.columns, F.expr("try_cast(response AS DOUBLE)").alias(score))


def is_cited(text: Column, marker: str, host: str) -> Column:
    return F.contains(text, F.lit(marker)) & F.contains(text, F.lit(host))


def run_metrics(scored: DataFrame, scorers: list[str], run_col: str = "run") -> DataFrame:
    """Mean per run and scorer: run, metric, value.  One pass over all scorers."""
    means = scored.groupBy(run_col).agg(*[F.avg(s).alias(s) for s in scorers])
    return means.unpivot([run_col], scorers, "metric", "value").where(F.col("value").isNotNull())


def compare_runs(metrics: DataFrame, first: str, second: str, run_col: str = "run") -> DataFrame:
    """Metrics of the first run next to those of the second; a metric the second lacks counts as 0.

    Values that are text are compared if they read as numbers, and left out otherwise.
    """
    metrics = numeric_only(metrics)

    def value(run: str) -> Column:
        return F.max(F.when(F.col(run_col) == run, F.col("value")))

    # One grouping instead of a join of the metrics with themselves, so they are computed once.
    sides = metrics.groupBy("metric").agg(value(first).alias("value_1"), F.coalesce(value(second), F.lit(0.0)).alias("value_2"))
    difference = F.col("value_1") - F.col("value_2")
    return sides.where(F.col("value_1").isNotNull()).select(
        "metric", "value_1", "value_2", difference.alias("difference"),
        F.format_string("%.3f", "value_1").alias("shown_1"),
        F.format_string("%.3f", "value_2").alias("shown_2"),
        F.format_string("%+.3f", difference).alias("shown_difference"),
    )


def numeric_only(metrics: DataFrame, value_col: str = "value") -> DataFrame:
    """Keeps rows whose value reads as a number and casts it."""
    value = F.expr(f"try_cast(`{value_col}` AS DOUBLE)")
    return metrics.withColumn(value_col, value).where(F.col(value_col).isNotNull())

