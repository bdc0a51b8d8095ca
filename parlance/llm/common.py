"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import run_dir, shared_dir, ship_package

# The white space that separates words (0x09 to 0x0D and 0x20).
BLANKS = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) under ``name``, with its SQL twin if there is one."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(spark, folder.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers and makes the shared folder known."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts may be long
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    shared_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a fresh folder of the shared storage and reads it back: survives lost executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, and not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that this run has written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` has written, once nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Measured size of a text column; decides how many groups the work is cut into."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def pieces(n_bytes: int, per_piece: int, at_least: int = 1) -> int:
    return max(at_least, -(-n_bytes // per_piece))
