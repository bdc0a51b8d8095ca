"""SQL names for the scalar functions.  All but the model call are SQL functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from parlance.functions.models import ModelFn, embed_batch, safe_call_udf, text_embedding_udf
from parlance.functions.text import WORD

# Parameter order and names as callers use them.
_SQL_FUNCTIONS = {
    "dot_product": (
        "(a ARRAY<DOUBLE> COMMENT 'first vector', b ARRAY<DOUBLE> COMMENT 'second vector') RETURNS DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL "
        "WHEN size(a) <> size(b) THEN raise_error(concat('vector lengths differ: ', size(a), ' and ', size(b))) "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (acc, x) -> acc + x) END",
    ),
    "vector_norm": (
        "(v ARRAY<DOUBLE> COMMENT 'vector') RETURNS DOUBLE",
        "sqrt(aggregate(transform(v, x -> x * x), 0D, (acc, x) -> acc + x))",
    ),
    "vector_pnorm": (
        "(v ARRAY<DOUBLE> COMMENT 'vector', p DOUBLE COMMENT 'order of the norm') RETURNS DOUBLE",
        "pow(aggregate(transform(v, x -> pow(abs(x), p)), 0D, (acc, x) -> acc + x), 1D / p)",
    ),
    "text_similarity": (
        "(a STRING COMMENT 'first text', b STRING COMMENT 'second text') RETURNS DOUBLE",
        "dot_product(embed_text(a), embed_text(b))",
    ),
}


def _sentiment_sql(positive: list[str], negative: list[str]) -> str:
    def count(members: list[str]) -> str:
        listed = ", ".join("'" + m.replace("'", "\\'") + "'" for m in members)
        return f"size(filter(w, x -> x IN ({listed})))"

    label = (
        "CASE WHEN c.up > 0 AND c.up = c.down THEN 'mixed' WHEN c.up > c.down THEN 'positive' "
        "WHEN c.down > c.up THEN 'negative' ELSE 'neutral' END"
    )
    counts = f"transform(array(regexp_extract_all(lower(t), r'{WORD}', 0)), w -> named_struct('up', {count(positive)}, 'down', {count(negative)}))"
    return f"CASE WHEN t IS NOT NULL THEN element_at(transform({counts}, c -> {label}), 1) END"


def register_functions(spark: SparkSession, model: ModelFn | None = None,
                       embed: Callable[[list[str]], object] = embed_batch,
                       lexicon: tuple[list[str], list[str]] | None = None) -> None:
    """Registers ``embed_text``, the functions above, ``call_model`` if a model is given, and
    ``text_sentiment`` if positive and negative words are given."""
    if lexicon is not None:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_sentiment(t STRING COMMENT 'text') RETURNS STRING "
                  f"RETURN {_sentiment_sql(*lexicon)}")
    spark.udf.register("embed_text", text_embedding_udf(embed))
    for name, (signature, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    if model is not None:
        spark.udf.register("call_model", safe_call_udf(model))


def drop_functions(spark: SparkSession) -> None:
    for name in [*reversed(_SQL_FUNCTIONS), "embed_text", "call_model", "text_sentiment"]:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
