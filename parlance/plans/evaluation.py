"""Evaluation questions, prompts, upserts, scores and run comparison."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import evaluate, infer
from parlance.plans.opinions import _sql_count, _sql_list
from parlance.plans.registry import SQL_WORDS, Tables, query
from parlance.session import run_dir
from parlance.sources.buckets import BucketTable, merge

TEMPLATES = [
    "Which segment is {name} in?", "What does {name} owe?", "Where does {name} live?", "List the bills of {name}.",
    "Has {name} open tickets?", "How are refunds handled?", "Why is my line slow?",
]
OPENING, TASK = "You check a support assistant. Customer record:", "List the facts a right answer must hold, as a JSON array."
BLOCKED, TOOL_WORDS = ["nicht", "est"], ["that", "into"]

_NUMBERED = f"""
    q AS (SELECT *, replace(list_extract({_sql_list(TEMPLATES)}, (row_id % {len(TEMPLATES)})::BIGINT + 1), '{{name}}', c_name) AS question
          FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer))"""


def _questions(t: Tables) -> DataFrame:
    return evaluate.questions(t.customer, [F.col("c_custkey")], TEMPLATES, name="c_name")


@query(f"WITH {_NUMBERED} SELECT c_custkey, row_id, question FROM q")
def eval_questions(t: Tables) -> DataFrame:
    return _questions(t).select("c_custkey", "row_id", "question")


@query(f"""
    WITH {_NUMBERED}
    SELECT c_custkey, '{OPENING} ' || c_name || ', ' || c_mktsegment || ', ' || n_name || ' {TASK} Question: ' || question AS prompt
    FROM q JOIN nation ON c_nationkey = n_nationkey""")
def eval_prompts(t: Tables) -> DataFrame:
    record = [F.col(c) for c in ("c_name", "c_mktsegment", "n_name")]
    asked = _questions(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return asked.select("c_custkey", evaluate.judge_prompt(record, F.col("question"), OPENING, TASK).alias("prompt"))


def state_facts(prompts: list[str]) -> list[str]:
    """A small local model: repeats the record in its prompt as facts, and declines for one segment."""
    answers = []
    for prompt in prompts:
        segment, name = prompt.removeprefix(OPENING + " ").split(f" {TASK}")[0].split(", ")
        answers.append("I cannot say" if segment == "BUILDING" else json.dumps([f"Segment: {segment}", f"Name: {name}"]))
    return answers


@query(f"""
    WITH {_NUMBERED}
    SELECT question, '' AS predictions, CASE c_mktsegment WHEN 'BUILDING' THEN 0 ELSE 2 END AS n_facts,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN 'Segment: ' || c_mktsegment END AS first_fact FROM q""")
def eval_records(t: Tables) -> DataFrame:
    """A model answers each prompt with facts as JSON text; some answers are no JSON and have no facts."""
    record = [F.col("c_mktsegment"), F.col("c_name")]
    asked = _questions(t).select("question", evaluate.judge_prompt(record, F.col("question"), OPENING, TASK).alias("prompt"))
    answers = infer.safe_infer(asked, "prompt", state_facts, keep=["question"])
    answered = answers.select("question", evaluate.expected_facts(F.col("response")).alias("expected_facts"))
    records, found = evaluate.eval_records(answered), F.col("expectations.expected_facts")
    return records.select(
        F.col("inputs.question").alias("question"), "predictions",
        F.coalesce(F.when(found.isNotNull(), F.size(found)), F.lit(0)).cast("long").alias("n_facts"),
        F.element_at(F.when(F.size(found) > 0, found), 1).alias("first_fact"))


@query("""
    SELECT c_name AS question, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS facts,
           CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer""")
def eval_upsert(t: Tables) -> DataFrame:
    """The stored set gets changed and new records; only the buckets of their keys are rewritten."""
    table = BucketTable(t.spark, run_dir(t.spark, "eval_upsert"))

    def records(rows: DataFrame, facts: str, version: int) -> DataFrame:
        return rows.select(F.col("c_name").alias("question"), F.lit(facts).alias("facts"), F.lit(version).cast("long").alias("version"))

    for part, facts, version in (("c_acctbal >= 0", "old", 1), ("c_acctbal < 0 OR c_mktsegment = 'BUILDING'", "new", 2)):
        merge(table, records(t.customer.where(part), facts, version), "question", [F.col("version")], buckets=16)
    return table.read().drop("bucket")


SCORERS = ["groundedness", "relevance", "safety", "guidelines"]

_SCORES = f"""
    u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
    c AS (SELECT conv_id, turn + 1 AS turn, text AS context FROM conversations),
    r AS (SELECT 'reply' AS run, conv_id, turn, question, answer, coalesce(context, '') AS context
          FROM u JOIN a USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)
          UNION ALL
          SELECT 'echo', conv_id, turn, question, question, coalesce(context, '')
          FROM u JOIN a USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)),
    w AS (SELECT *, {SQL_WORDS.format('answer')} AS aw, list_distinct({SQL_WORDS.format('answer')}) AS ad,
                 list_distinct({SQL_WORDS.format('question')}) AS qd, {SQL_WORDS.format('context')} AS cw FROM r),
    s AS (SELECT run, conv_id, turn,
                 CASE WHEN len(ad) > 0 THEN len(list_intersect(ad, cw)) / len(ad) ELSE 0 END AS groundedness,
                 CASE WHEN len(qd) > 0 THEN len(list_intersect(qd, aw)) / len(qd) ELSE 0 END AS relevance,
                 CASE WHEN {_sql_count('aw', BLOCKED)} = 0 THEN 1.0 ELSE 0.0 END AS safety,
                 CASE WHEN {_sql_count('aw', TOOL_WORDS)} = 0 AND (NOT contains(context, 'http') OR contains(answer, 'http'))
                      THEN 1.0 ELSE 0.0 END AS guidelines
          FROM w),
    m AS (SELECT run, avg(groundedness) AS groundedness, avg(relevance) AS relevance, avg(safety) AS safety,
                 avg(guidelines) AS guidelines FROM s GROUP BY run),
    metrics AS (UNPIVOT m ON groundedness, relevance, safety, guidelines INTO NAME metric VALUE value)"""


def _scored(t: Tables) -> DataFrame:
    # Joins on the conversation and the turn: a repeated turn meets every row beside it, and a long conversation is no task of its own.
    turns = t.conversations
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    records = asked.join(replies, ["conv_id", "turn"]).join(before, ["conv_id", "turn"], "left").withColumn(
        "context", F.coalesce("context", F.lit("")))
    # Both runs come from one joined row, so the joins run once and no text is split into words twice.
    split = records.select("*", *[evaluate.distinct_words(F.col(c)).alias(f"{c}_words") for c in ("question", "answer", "context")])
    runs = F.explode(F.array(*[
        F.struct(F.lit(run).alias("run"), F.col(c).alias("answer"), F.col(f"{c}_words").alias("answer_words"))
        for run, c in (("reply", "answer"), ("echo", "question"))]))
    shared = ["conv_id", "turn", "question", "context", "question_words", "context_words"]
    both = split.select(*shared, runs.alias("r")).select(*shared, "r.*")
    return evaluate.lexical_scores(both, BLOCKED, TOOL_WORDS, tokens=("question_words", "answer_words", "context_words"))


@query(f"""
    WITH {_SCORES}
    SELECT run, conv_id, turn, round(groundedness, 4) AS groundedness, round(relevance, 4) AS relevance,
           safety::DOUBLE AS safety, guidelines::DOUBLE AS guidelines FROM s""")
def eval_scores(t: Tables) -> DataFrame:
    return _scored(t).select(
        "run", "conv_id", "turn", F.round("groundedness", 4).alias("groundedness"), F.round("relevance", 4).alias("relevance"),
        "safety", "guidelines")


def judge_length(prompts: list[str]) -> list[str]:
    """A small local judge: 1 for an answer that is longer than its question, and no number for short questions."""
    answers = []
    for prompt in prompts:
        question, answer = prompt.split("\x1f")
        answers.append("unsure" if len(question) < 100 else str(int(len(answer) > len(question))))
    return answers


@query(f"""
    WITH {_SCORES}
    SELECT run, conv_id, turn, CASE WHEN length(question) >= 100 THEN (length(answer) > length(question))::INT::DOUBLE END AS judged
    FROM s JOIN (SELECT run, conv_id, turn, question, answer FROM r) USING (run, conv_id, turn)""")
def eval_judge(t: Tables) -> DataFrame:
    """A judging model next to the lexical scorers."""
    prompt = F.concat_ws("\x1f", "question", "answer")
    return evaluate.judged_scores(_scored(t), judge_length, prompt, "judged").select("run", "conv_id", "turn", "judged")


@query(f"""
    WITH {_SCORES}
    SELECT a.metric, round(a.value, 4) AS value_1, round(coalesce(b.value, 0), 4) AS value_2,
           round(a.value - coalesce(b.value, 0), 4) AS difference, printf('%.3f', a.value) AS shown_1,
           printf('%.3f', coalesce(b.value, 0)) AS shown_2, printf('%+.3f', a.value - coalesce(b.value, 0)) AS shown_difference
    FROM metrics a LEFT JOIN (SELECT * FROM metrics WHERE run = 'echo' AND metric <> 'safety') b USING (metric) WHERE a.run = 'reply'""")
def run_compare(t: Tables) -> DataFrame:
    """The second run lacks one metric, which then counts as 0.  A metric that is no number is left out."""
    metrics = evaluate.run_metrics(_scored(t), SCORERS).withColumn("value", F.col("value").cast("string"))
    names = metrics.select("run").distinct().select("run", F.lit("model").alias("metric"), F.lit("local rules").alias("value"))
    metrics = metrics.unionByName(names)
    kept = metrics.where(~((F.col("run") == "echo") & (F.col("metric") == "safety")))
    numbers = [F.round(c, 4).alias(c) for c in ("value_1", "value_2", "difference")]
    return evaluate.compare_runs(kept, "reply", "echo").select("metric", *numbers, "shown_1", "shown_2", "shown_difference")
