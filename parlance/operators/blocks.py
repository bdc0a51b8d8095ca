"""Joins on conditions that no equality key expresses (similarity, edit distance, ranking scores).

Two shapes, both without a cross join:

* ``score_join``: a bounded query side is sent to every scan task and the other side never moves.
  The bound is measured; more queries go in slices of that size, one scan for each.
* ``block_join``: both sides carry a ``cell`` column and only rows that share a cell can match.  Each
  cell is cut into a grid of blocks of bounded size, so a cell that holds a third of all rows becomes
  many equal tasks instead of one, and a task hands on only its results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.functions.tokens import give_back
from parlance.session import run_dir, shared_dir
from parlance.sizing import is_small, number_rows

BLOCK_ROWS = 8192
MAX_QUERIES = 4096
_KEYS = ["cell", "__i", "__j"]


class Scorer(Protocol):
    """Holds one set of queries; sees the other side batch by batch."""

    def feed(self, batch: pa.RecordBatch | pa.Table) -> Iterator[pa.Table]: ...

    def finish(self) -> Iterator[pa.Table]: ...


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _splits(df: DataFrame, name: str, block_rows: int) -> DataFrame:
    return df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))


def _spread(df: DataFrame, grid: DataFrame, own: tuple[str, str], other: tuple[str, str], spread_on: Column) -> DataFrame:
    """Each row goes to one block along its own axis and is repeated along the other."""
    placed = df.join(grid, "cell")
    return (
        placed.withColumn(own[0], F.pmod(F.xxhash64(spread_on), F.col(own[1])).cast("int"))
        .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
        .drop("__home_blocks", "__probe_blocks")
    )


def block_join(
    home: DataFrame,
    probe: DataFrame,
    home_id: str,
    probe_id: str,
    kernel: Callable[[pa.Table, pa.Table], Iterator[pa.Table]],
    schema: str,
    max_cells: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Applies ``kernel(home_block, probe_block)`` to every pair of blocks of a cell.

    A kernel yields its results as it finds them, so a task holds two blocks and one part of what they give.
    ``max_cells`` states how many cells the caller can have made; the table of block counts has one
    row per cell and is broadcast only because of that bound.
    """
    grid = _splits(home, "__home_blocks", block_rows).join(_splits(probe, "__probe_blocks", block_rows), "cell")
    if max_cells <= 100_000:
        grid = F.broadcast(grid)
    left = _spread(home, grid, ("__i", "__home_blocks"), ("__j", "__probe_blocks"), F.col(home_id))
    right = _spread(probe, grid, ("__j", "__probe_blocks"), ("__i", "__home_blocks"), F.col(probe_id))
    right = right.select([F.col(c).alias(c) for c in right.columns])  # own column ids, for self joins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        is_home = block.column("__home")
        sides = block.filter(is_home), block.filter(pc.invert(is_home))
        if all(side.num_rows for side in sides):
            for found in kernel(*sides):
                yield from found.to_batches()

    both = left.withColumn("__home", F.lit(True)).unionByName(right.withColumn("__home", F.lit(False)), allowMissingColumns=True)
    return both.groupBy(*_KEYS).applyInArrow(run, schema)


def score_join(
    queries: DataFrame,
    rows: DataFrame,
    query_id: str,
    scorer: Callable[[pa.Table], Scorer],
    schema: str,
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Everything ``scorer`` finds between the queries and the rows (partial results per task).

    Queries beyond ``max_queries`` are numbered and go through in slices; the partial results of a slice are
    written before the next one is sent, so driver and tasks hold one slice at a time and the rows are
    never shuffled.
    """
    spark: SparkSession = rows.sparkSession
    shared_dir(spark)
    queries = queries.checkpoint()  # measured and used without being computed twice

    def scan_for(part: DataFrame) -> DataFrame:
        asked = spark.sparkContext.broadcast(part.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = scorer(asked.value)
            for batch in batches:
                if batch.num_rows and asked.value.num_rows:
                    for table in state.feed(batch):
                        yield from table.to_batches()
                    give_back()
            for table in state.finish():
                yield from table.to_batches()

        return rows.mapInArrow(scan, schema)

    if is_small(queries, max_queries):
        return scan_for(queries)
    path = run_dir(spark, "slices")
    numbered = number_rows(queries, [F.col(query_id)], number_col="__n").checkpoint()
    for start in range(0, numbered.count(), max_queries):
        part = numbered.where(F.col("__n").between(start, start + max_queries - 1)).drop("__n")
        scan_for(part).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
