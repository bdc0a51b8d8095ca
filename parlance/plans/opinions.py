"""Sentiment, prompts, model calls and opinions over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import infer, opinions
from parlance.operators.counts import OpinionCounts
from parlance.plans.registry import SQL_WORDS, Tables, query
from parlance.session import run_dir
from parlance.sizing import spread
from parlance.sources.tables import scratch_schema
from parlance.streaming.jobs import answers_stream, read_stream

POSITIVE, NEGATIVE = ["the", "and", "la", "der"], ["of", "is", "que", "das"]
# The last topic is not on the allow-list, so its opinions have to go.
TOPICS = [("QUALITY", ["the", "les"]), ("SERVICE", ["of", "de"]), ("DESIGN", ["and", "und"]), ("price", ["with", "ion"])]
INSTRUCTIONS = (
    "List the opinions in the document as JSON objects with classification, comment and sentiment.\n"
    "Classifications: " + ", ".join(opinions.CLASSIFICATIONS) + ".\n\nDOCUMENT\n"
)
LONGEST = 5000


def _sql_list(members: list[str]) -> str:
    return "[" + ", ".join(f"'{m}'" for m in members) + "]"


def _sql_count(tokens: str, members: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda w: list_contains({_sql_list(members)}, w)))"


def _sql_label(mixed: str, up: str, down: str, neutral: str) -> str:
    return f"CASE WHEN up > 0 AND up = down THEN '{mixed}' WHEN up > down THEN '{up}' WHEN down > up THEN '{down}' ELSE '{neutral}' END"


@query(f"""
    SELECT doc_id, {_sql_label('mixed', 'positive', 'negative', 'neutral')} AS sentiment FROM (
        SELECT doc_id, {_sql_count(SQL_WORDS.format('text'), POSITIVE)} AS up,
               {_sql_count(SQL_WORDS.format('text'), NEGATIVE)} AS down FROM documents)""")
def sentiment_label(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", text.sentiment_label(F.col("text"), POSITIVE, NEGATIVE).alias("sentiment"))


@query(f"""
    SELECT doc_id, '{INSTRUCTIONS}' || text || chr(10) || chr(10) || 'RESULT' || chr(10) AS prompt
    FROM documents""")
def opinion_prompts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", opinions.opinion_prompt(F.col("text"), INSTRUCTIONS).alias("prompt"))


def count_lines(texts: list[str]) -> list[str]:
    """A small local model that refuses long texts."""
    answers = []
    for value in texts:
        if len(value) > LONGEST:
            raise ValueError(f"text has {len(value)} characters")
        answers.append(f"{value.count(chr(10)) + 1} lines")
    return answers


@query(f"""
    SELECT doc_id, CASE WHEN length(text) <= {LONGEST} THEN
               (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines' END AS response,
           CASE WHEN length(text) > {LONGEST} THEN 'text has ' || length(text) || ' characters' END AS error
    FROM documents""")
def safe_infer(t: Tables) -> DataFrame:
    return infer.safe_infer(t.documents, "text", count_lines, keep=["doc_id"]).drop("input")


@query(f"""
    SELECT doc_id, CASE WHEN length(text) <= {LONGEST} THEN
               (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines' END AS response,
           length(text) > {LONGEST} AS failed, text IS NOT NULL AS timed FROM documents""")
def timed_infer(t: Tables) -> DataFrame:
    """Model answers with the time that each took; only whether there is a time can be compared."""
    answered = infer.timed_infer(t.documents, "text", count_lines, keep=["doc_id"])
    return answered.select("doc_id", "response", F.col("error").isNotNull().alias("failed"), (F.col("seconds") >= 0).alias("timed"))


@query(f"""
    SELECT doc_id, CASE WHEN length(text) <= {LONGEST} THEN
               (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines'
           ELSE 'Error: text has ' || length(text) || ' characters' END AS response FROM (
        SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100)""")
def safe_infer_limited(t: Tables) -> DataFrame:
    """A trial run: the limit lies below the model, and errors are shown as text in the one answer column."""
    tried = infer.safe_infer(t.documents, "text", count_lines, limit=100, order=[F.col("doc_id")], keep=["doc_id"], error_text=True)
    return tried.select("doc_id", "response")


def _answer() -> Column:
    return opinions.mine_opinions(F.col("text"), TOPICS, POSITIVE, NEGATIVE)


_TOPIC = "CASE " + " ".join(
    f"WHEN list_has_any(words, {_sql_list(members)}) THEN '{name}'" for name, members in TOPICS) + " ELSE 'OTHER' END"
_OPINIONS = f"""
    WITH s AS (SELECT doc_id, lang, trim(unnest(string_split_regex(text, '[.!?\\n]+'))) AS comment FROM documents),
    w AS (SELECT *, {SQL_WORDS.format('comment')} AS words FROM s WHERE comment <> ''),
    o AS (SELECT doc_id, lang, comment, {_TOPIC} AS classification, {_sql_count('words', POSITIVE)} AS up,
                 {_sql_count('words', NEGATIVE)} AS down FROM w),
    opinions AS (SELECT doc_id, lang, classification, comment, {_sql_label('Mixed', 'Positive', 'Negative', 'Neutral')} AS sentiment
                 FROM o WHERE classification <> 'price')"""


@query(f"{_OPINIONS} SELECT classification, comment, sentiment, doc_id, lang FROM opinions")
def opinion_explode(t: Tables) -> DataFrame:
    answered = spread(t.documents).select("doc_id", "lang", _answer().alias("extracted_opinions"))
    return opinions.explode_opinions(answered).drop("extracted_opinions")


@query(f"""{_OPINIONS}
    SELECT CASE WHEN grouping(classification) = 1 THEN 'ALL' ELSE coalesce(classification, 'UNKNOWN') END AS classification,
           CASE WHEN grouping(sentiment) = 1 THEN 'ALL' ELSE coalesce(sentiment, 'UNKNOWN') END AS sentiment, count(*) AS n_opinions FROM opinions GROUP BY ROLLUP (classification, sentiment)""")
def opinion_summary(t: Tables) -> DataFrame:
    answered = spread(t.documents).select(_answer().alias("extracted_opinions"))
    return opinions.opinion_summary(opinions.explode_opinions(answered))


@query(f"""
    WITH s AS (SELECT trim(unnest(string_split_regex(text, '[.!?\\n]+'))) AS comment FROM documents),
    w AS (SELECT {SQL_WORDS.format('comment')} AS words FROM s WHERE comment <> '')
    SELECT 0 AS unreadable, (SELECT count(*) FROM documents WHERE regexp_full_match(text, '(?s)[ .!?\\n]*')) AS empty,
           (SELECT count(*) FROM w WHERE {_TOPIC} = 'price') AS off_list""")
def opinion_rejects(t: Tables) -> DataFrame:
    return opinions.opinion_rejects(spread(t.documents).select(_answer().alias("extracted_opinions")))


def _older(t: Tables) -> DataFrame:
    """An earlier state: no German documents, and Spanish ones with another text."""
    changed = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    return spread(t.documents.where(F.col("lang") != "de").select("doc_id", changed.alias("text")))


@query(f"{_OPINIONS} SELECT doc_id, classification, comment, sentiment FROM opinions")
def opinion_mv_refresh(t: Tables) -> DataFrame:
    """Two refreshes, with new and changed documents in between, equal one run over the last state."""
    table = f"{scratch_schema(t.spark, 'opinions')}.answers"
    documents = spread(t.documents.select("doc_id", "text"))
    for state in (_older(t), documents):
        opinions.refresh_answers(state, table, "doc_id", "text", _answer())
    found = opinions.current_opinions(documents, table, "doc_id", "text")
    return found.select("doc_id", "classification", "comment", "sentiment")


@query(f"{_OPINIONS} SELECT doc_id, classification, comment, sentiment FROM opinions")
def opinion_stream(t: Tables) -> DataFrame:
    """The same through the triggered stream form."""
    folder, checkpoint = run_dir(t.spark, "opinion_stream_in"), run_dir(t.spark, "opinion_stream_state")
    table = f"{scratch_schema(t.spark, 'opinion_stream')}.answers"
    documents = t.documents.select("doc_id", "text")
    for number, delivery in enumerate((_older(t), documents)):
        delivery.withColumn("delivery", F.lit(number)).write.mode("append").parquet(folder)
        stream = read_stream(t.spark, folder, "doc_id bigint, text string, delivery int")
        answers_stream(stream, table, "doc_id", "text", _answer(), checkpoint, F.struct("delivery", "text")).awaitTermination()
    found = opinions.current_opinions(documents, table, "doc_id", "text")
    return found.select("doc_id", "classification", "comment", "sentiment")


@query(f"""{_OPINIONS}
    SELECT CASE WHEN grouping(classification) = 1 THEN 'ALL' ELSE coalesce(classification, 'UNKNOWN') END AS classification,
           CASE WHEN grouping(sentiment) = 1 THEN 'ALL' ELSE coalesce(sentiment, 'UNKNOWN') END AS sentiment, count(*) AS n_opinions FROM opinions GROUP BY ROLLUP (classification, sentiment)""")
def opinion_counts_refresh(t: Tables) -> DataFrame:
    """The summary from counts that two more snapshots and a delivery have changed by differences."""
    view = OpinionCounts(t.spark, run_dir(t.spark, "opinion_counts"))
    documents = t.documents.select("doc_id", "lang", "text")
    for state in (_older(t), documents.where("lang <> 'fr'")):
        view.refresh(spread(state), "doc_id", "text", _answer())
    view.refresh(spread(documents.where("lang = 'fr' or lang is null")), "doc_id", "text", _answer(), partial=True)
    return view.summary()
