"""The registered queries and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import ARROW_BATCH, shared_dir, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its own name, with its SQL twin."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set(*ARROW_BATCH)
            ship_package(spark)
            shared_dir(spark)
            return build(Tables(spark, folder.rstrip("/")))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def shown(df: DataFrame, digits: int = 4) -> DataFrame:
    """Scores rounded for display only, after the ranking."""
    return df.withColumn("score", F.round("score", digits))


# SQL for the hashed embeddings of the local default model.
SQL_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def sql_cells(table: str, key: str, features: str) -> str:
    """key, dim, value: unit-length hashed vectors; ``features`` is a SQL list of strings."""
    return f"""
        SELECT key, dim, s / sqrt(sum(s * s) OVER (PARTITION BY key)) AS value FROM (
            SELECT key, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM (
                SELECT key, ('0x' || substr(md5(f), 1, 7))::BIGINT AS h FROM (
                    SELECT {key} AS key, unnest({features}) AS f FROM {table}))
            GROUP BY key, h % 64) WHERE s <> 0"""


def sql_trigrams(name: str) -> str:
    return (
        f"list_transform(range(1, length({name}) + 1), lambda i: substr(' ' || lower({name}) || ' ', i::BIGINT, 3))"
    )
