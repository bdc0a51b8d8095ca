"""Embedding indexes kept in step with a keyed source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.models import EmbedFn, embed_batch
from parlance.operators.infer import embed_text
from parlance.sizing import small_side, top_n
from parlance.sources.tables import overwrite_table, quoted, recover_table, table_or_none


def text_hash(text: Column) -> Column:
    """md5 of a text; NULL has a value of its own, so that NULL and empty text are told apart."""
    return F.coalesce(F.md5(text), F.lit("null"))


def content_hashes(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Key and md5 of the text: all that a snapshot comparison has to shuffle."""
    return df.select(key, text_hash(F.col(text_col)).alias("content_hash"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key and ``insert``, ``update`` or ``delete`` between two (key, content_hash) snapshots."""
    both = old.select(key, F.col("content_hash").alias("__old")).join(
        new.select(key, F.col("content_hash").alias("__new")), key, "full_outer")
    change = (
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNull(), "delete")
        .when(F.col("__old") != F.col("__new"), "update")
    )
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())


def build_index(source: DataFrame, key: str, text_col: str, embed: EmbedFn = embed_batch) -> DataFrame:
    """key, content_hash, embedding"""
    hashed = source.select(key, text_col, text_hash(F.col(text_col)).alias("content_hash"))
    return embed_text(hashed, text_col, embed).select(key, "content_hash", "embedding")


def read_index(spark: SparkSession, name: str) -> DataFrame:
    """The index as it is now: the base without changed keys, and the latest state of those.

    Changes are few compared with the base, so the base is filtered in place and not shuffled.
    """
    base, changes = spark.table(quoted(name)), table_or_none(spark, _changes(name))
    if changes is None:
        return base
    key = base.columns[0]
    latest = top_n(changes, [key], [F.col("seq").desc()], 1).drop("rank", "seq")
    kept = base.join(small_side(latest.select(key)), key, "left_anti")
    return kept.unionByName(latest.where(F.col("content_hash").isNotNull()))


def compact_index(spark: SparkSession, name: str) -> None:
    """Folds the changes into the base.  If it is cut short in between, applying them again changes nothing."""
    if table_or_none(spark, _changes(name)) is not None:
        overwrite_table(read_index(spark, name), name)
        spark.sql(f"DROP TABLE IF EXISTS {quoted(_changes(name))}")


def _changes(name: str) -> str:
    return f"{name}__changes"


def sync_index(
    source: DataFrame, index_table: str, key: str, text_col: str, embed: EmbedFn = embed_batch, partial: bool = False,
    compact_above: float = 0.1, deleted: DataFrame | None = None,
) -> bool:
    """Creates the index table, or brings it up to date; True if anything was written.

    ``key`` is unique in the source.  Only new and changed texts are embedded, and only they are
    written; the base is rewritten once changes exceed its share ``compact_above``.  Running a sync
    again changes nothing.  With ``partial`` the source holds changed rows only, so keys it lacks are
    kept and only its own keys are compared; ``deleted`` then names the keys that go.
    """
    spark = source.sparkSession
    recover_table(spark, index_table)
    if deleted is not None:
        source = source.join(deleted.select(key), key, "left_anti")
    if table_or_none(spark, index_table) is None:
        overwrite_table(build_index(source, key, text_col, embed), index_table)
        return True
    old, new = read_index(spark, index_table).select(key, "content_hash"), content_hashes(source, key, text_col)
    if partial:
        named = new.select(key) if deleted is None else new.select(key).union(deleted.select(key))
        old = old.join(small_side(named), key, "left_semi")
    changes = snapshot_changes(old, new, key).checkpoint()
    if changes.isEmpty():
        return False
    log = table_or_none(spark, _changes(index_table))
    seq = 1 if log is None else log.agg(F.max("seq")).first()[0] + 1
    renewed = source.join(small_side(changes.where(F.col("change") != "delete").select(key)), key, "left_semi")
    gone = changes.where(F.col("change") == "delete").select(key)
    rows = build_index(renewed, key, text_col, embed).unionByName(gone, allowMissingColumns=True)
    rows.withColumn("seq", F.lit(seq).cast("long")).write.format("parquet").mode("append").saveAsTable(
        quoted(_changes(index_table)))
    if spark.table(quoted(_changes(index_table))).count() > compact_above * spark.table(quoted(index_table)).count():
        compact_index(spark, index_table)
    return True
