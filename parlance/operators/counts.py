"""Counts of opinions, kept up to date by signed differences instead of being counted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.index import text_hash
from parlance.operators.opinions import CLASSIFICATIONS, opinion_summary, parse_opinions
from parlance.sizing import small_side
from parlance.sources.buckets import BucketTable, bucket_of

_COUNTS = "classification string, sentiment string, n_opinions bigint"


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


class OpinionCounts:
    """The answers of every source row in buckets by key, and the number of opinions by class and sentiment.

    A refresh compares keys and text hashes, asks the model for new and changed texts only, and adds +1 for each opinion
    that came and -1 for each that went to the counts before.  Only the buckets of changed keys are read and rewritten; their
    labels as stored, before and after, give the difference, so answers are written once and read by nothing else.

    The counts of a version are written before the version is committed and found by its number, so a refresh that is cut
    short leaves the view as it was, and one that is repeated counts nothing twice.  One writer at a time.

    A NULL key is a key like any other.  Of several source rows of a key the one with the smallest text hash counts.
    Unreadable answers and opinions off the list count nothing.  An empty source empties the view.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, allowed: list[str] = CLASSIFICATIONS):
        self.spark, self.folder, self.buckets, self.allowed = spark, folder.rstrip("/"), buckets, allowed
        self.answers = BucketTable(spark, f"{self.folder}/answers")

    def _counted(self, version: int | None) -> DataFrame:
        return self.spark.createDataFrame([], _COUNTS) if version is None else self.spark.read.schema(_COUNTS).parquet(
            f"{self.folder}/counts/v={version}")

    def counts(self) -> DataFrame:
        """classification, sentiment, n_opinions of the latest version."""
        return self._counted(self.answers.version())

    def summary(self) -> DataFrame:
        """The same with subtotals."""
        return opinion_summary(self.counts(), F.sum("n_opinions"))

    def _labels(self, answer: Column) -> Column:
        """Class and sentiment of each opinion: all that a later subtraction needs, whatever becomes of the parser."""
        fits = F.filter(parse_opinions(answer), lambda o: o["classification"].isin(*self.allowed))
        return F.coalesce(F.transform(fits, lambda o: F.struct(o["classification"].alias("classification"), o["sentiment"].alias("sentiment"))),
                          F.from_json(F.lit("[]"), "array<struct<classification:string, sentiment:string>>"))

    def _bucket(self, key: str) -> Column:
        return bucket_of(F.col(key), self.buckets).alias("bucket")

    def _changes(self, source: DataFrame, key: str, text_col: str, partial: bool, deleted: DataFrame | None) -> DataFrame:
        """key, old and new hash (NULL: none) of the rows that came, went or changed, with their bucket and number of source rows."""
        new = source.select(F.col(key).alias("new_key"), text_hash(F.col(text_col)).alias("h")).groupBy("new_key").agg(
            F.min("h").alias("new_hash"), F.count("*").alias("copies"))
        if deleted is not None:
            gone = deleted.select(F.col(key).alias("gone_key")).distinct()
            new = new.join(gone, _same("new_key", "gone_key"), "left_anti")
        old, version = None, self.answers.version()
        if version is not None and partial:
            named = new.select("new_key") if deleted is None else new.select("new_key").union(gone)
            named = named.select(F.col("new_key").alias("named_key"), self._bucket("new_key")).checkpoint()
            touched = [r[0] for r in named.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            old = self.answers.read(version, touched).join(small_side(named.select("named_key")), _same("key", "named_key"), "left_semi")
        elif version is not None:
            old = self.answers.read(version)
        if old is None:
            both = new.select(F.col("new_key").alias("key"), F.lit(None).cast("string").alias("old_hash"), "new_hash", "copies")
        else:
            both = old.select(F.col("key").alias("old_key"), F.col("content_hash").alias("old_hash")).join(
                new, _same("old_key", "new_key"), "full_outer").select(
                F.coalesce("old_key", "new_key").alias("key"), "old_hash", "new_hash", "copies")
        return both.where(~_same("old_hash", "new_hash")).select(
            F.col("key").alias("changed_key"), "old_hash", "new_hash", "copies", self._bucket("key").alias("changed_bucket")).checkpoint()

    def refresh(self, source: DataFrame, key: str, text_col: str, answer: Column, partial: bool = False,
                deleted: DataFrame | None = None) -> int | None:
        """Brings the view to the state of ``source``; the new version, or None if nothing changed.

        With ``partial`` the source is a delivery of changed rows, and keys that it lacks stay; ``deleted`` names keys that go.
        """
        changes = self._changes(source, key, text_col, partial, deleted)
        before = self.answers.version()
        if before is not None and changes.isEmpty():
            return None
        touched = [r[0] for r in changes.select("changed_bucket").distinct().collect()]  # at most ``buckets`` numbers
        came, asked = changes.where("new_hash is not null"), source.withColumn("__hash", text_hash(F.col(text_col)))
        # Whole texts are shuffled only where rows of the source are not asked about.
        repeated = not came.where("copies > 1").isEmpty()
        if before is not None or deleted is not None or repeated:
            wanted = small_side(came.select("changed_key", "new_hash"))
            asked = asked.join(wanted, _same(key, "changed_key") & (F.col("__hash") == F.col("new_hash")), "left_semi")
        if repeated:
            asked = asked.dropDuplicates([key])
        added = asked.select(F.col(key).alias("key"), F.col("__hash").alias("content_hash"), answer.alias("extracted_opinions"))
        rows = added.select("*", self._labels(F.col("extracted_opinions")).alias("labels"), self._bucket("key"))
        known = None if before is None else self.answers.read(before, touched)
        if known is not None:
            rows = known.join(small_side(changes.select("changed_key")), _same("key", "changed_key"), "left_anti").unionByName(rows)

        def count(written: DataFrame) -> None:
            signed = self._signed(written, 1)
            if known is not None:  # what stayed in these buckets counts on both sides
                signed = signed.unionByName(self._signed(known, -1))
            total = self._counted(before).unionByName(signed.groupBy("classification", "sentiment").agg(F.sum("n_opinions").alias("n_opinions")))
            total = total.groupBy("classification", "sentiment").agg(F.sum("n_opinions").alias("n_opinions")).where("n_opinions <> 0")
            total.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/v={(before or 0) + 1}")

        return self.answers.replace(rows, touched, count)

    @staticmethod
    def _signed(answers: DataFrame, sign: int) -> DataFrame:
        return answers.select(F.explode("labels").alias("o")).select(
            "o.classification", "o.sentiment", F.lit(sign).cast("long").alias("n_opinions"))
