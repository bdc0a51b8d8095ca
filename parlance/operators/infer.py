"""Row-wise model calls that never fail a job, and embedding of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.models import REQUEST_SIZE, EmbedFn, ModelFn, embed_batch, safe_call_udf, text_embedding_udf


def safe_infer(
    df: DataFrame, text_col: str, model: ModelFn, limit: int | None = None, order: list[Column] | None = None,
    keep: list[str] | None = None, error_text: bool = False, request_size: int = REQUEST_SIZE,
) -> DataFrame:
    """``input``, ``response`` and ``error`` per row; exactly one of the last two is set for non-NULL text.

    A limit applies before the model is called.  ``error_text`` puts ``Error: ...`` into the
    response as well, for callers that want one column.
    """
    if limit is not None:
        df = (df.orderBy(*order) if order else df).limit(limit)
    called = df.select(*(keep or []), F.col(text_col).alias("input")).withColumn("__call", safe_call_udf(model, request_size)("input"))
    response, error = F.col("__call.result"), F.col("__call.errorMessage")
    if error_text:
        response = F.coalesce(response, F.concat(F.lit("Error: "), error))
    return called.select(*(keep or []), "input", response.alias("response"), error.alias("error"))


def timed_infer(df: DataFrame, text_col: str, model: ModelFn, keep: list[str]) -> DataFrame:
    """As ``safe_infer``, with the seconds each answer took."""
    called = df.select(*keep, F.col(text_col).alias("input")).withColumn("__call", safe_call_udf(model)("input"))
    return called.select(*keep, "input", F.col("__call.result").alias("response"),
                         F.col("__call.errorMessage").alias("error"), F.col("__call.seconds").alias("seconds"))


def embed_text(df: DataFrame, text_col: str, embed: EmbedFn = embed_batch, vector_col: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column (one Arrow pass, no shuffle).

    Marked nondeterministic, so that a later filter on the vector cannot make Spark compute it twice.
    """
    return df.withColumn(vector_col, text_embedding_udf(embed).asNondeterministic()(F.col(text_col)))


def embed_distinct(df: DataFrame, text_col: str, embed: EmbedFn = embed_batch) -> DataFrame:
    """One row per distinct text with its embedding: for columns with many repeats and a costly model."""
    return embed_text(df.select(text_col).where(F.col(text_col).isNotNull()).distinct(), text_col, embed)


def nonzero_cells(df: DataFrame, vector_col: str, *keys: str, digits: int = 6) -> DataFrame:
    """Long form of a vector column: keys, dim, value."""
    return df.select(*keys, F.posexplode(vector_col).alias("dim", "value")).where(F.col("value") != 0).select(
        *keys, F.col("dim").cast("long").alias("dim"), F.round("value", digits).alias("value"))
