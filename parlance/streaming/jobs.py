"""Recurring work as Structured Streaming jobs that process what is new and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.functions.models import EmbedFn, embed_batch
from parlance.operators.feedback import NEGATIVE, POSITIVE, polarity_counts
from parlance.operators.index import sync_index
from parlance.operators.opinions import refresh_answers
from parlance.session import shared_dir
from parlance.sizing import is_small, spread


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table, stored as a folder of files or as one file; raises if there is nothing to read."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if not files:
        raise FileNotFoundError(path)
    alone = len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])
    folder, name = path.rstrip("/").rsplit("/", 1)
    return read_stream(spark, folder, table.schema, name) if alone else read_stream(spark, path, table.schema)


def read_stream(spark: SparkSession, folder: str, schema: str, file_glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def _run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(batch).start()
    )


def _latest(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the last by ``order``.

    The keys are counted first.  Rows of keys that come once are not ranked, so their texts are not shuffled for it.
    """
    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
        return rows.withColumn("__r", rank).where(F.col("__r") == 1).drop("__r")

    shared_dir(batch.sparkSession)
    counts = batch.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    repeated = counts.where(F.col("__n") > 1).select("__key").checkpoint()
    if repeated.isEmpty():
        return batch
    if not is_small(repeated):
        return ranked(batch)
    same = F.col(key).eqNullSafe(F.col("__key"))
    once = batch.join(F.broadcast(repeated), same, "left_anti")
    return once.unionByName(ranked(batch.join(F.broadcast(repeated), same, "left_semi")))


def index_stream(stream: DataFrame, index_table: str, key: str, text_col: str, checkpoint: str, order: Column,
                 embed: EmbedFn = embed_batch, deleted: Column | None = None) -> StreamingQuery:
    """Triggered index sync.  A batch that is replayed finds equal content hashes and writes nothing.

    Of several rows of a key the last by ``order`` counts.  Where ``deleted`` holds for it, the key leaves the index.
    """
    def batch(rows: DataFrame, _: int) -> None:
        last = _latest(rows, key, order)
        if deleted is None:
            sync_index(last, index_table, key, text_col, embed, partial=True)
        else:
            gone = F.coalesce(deleted, F.lit(False))
            sync_index(last.where(~gone), index_table, key, text_col, embed, partial=True, deleted=last.where(gone).select(key))

    return _run(stream, checkpoint, batch)


def answers_stream(stream: DataFrame, answers_table: str, key: str, text_col: str, answer: Column,
                   checkpoint: str, order: Column) -> StreamingQuery:
    """Incremental model answers; keys and text hashes already answered are left alone."""
    def batch(rows: DataFrame, _: int) -> None:
        refresh_answers(_latest(spread(rows), key, order), answers_table, key, text_col, answer, partial=True)

    return _run(stream, checkpoint, batch)


def polarity_stream(reactions: DataFrame, ts_col: str, keys: list[str], width: str = "1 day", delay: str = "1 hour",
                    positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, reaction_col: str = "reaction") -> DataFrame:
    """Reaction counts per window and key; in append mode a window comes out once its watermark has passed.

    Watermarks need TIMESTAMP, so the time column is cast (the session time zone is UTC).
    """
    timed = reactions.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    counts = polarity_counts(timed, [F.window(ts_col, width).alias("w"), *keys], positive, negative, reaction_col)
    return counts.select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "negative_count", "positive_count", "total_reactions")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """File sink in append mode: every row lands exactly once."""
    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").start(path)
    )
