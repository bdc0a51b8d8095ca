"""Size checks, hot-key handling and distributed row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import shared_dir

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
FEW_SPLITS = 8


def _byte_size(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the rows and bytes of ``df`` are both measured to be within the bounds."""
    sizes = [_byte_size(f) for f in df.schema.fields]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    found = df.select(total.alias("size")).limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).first()
    return found["n"] <= max_rows and found["bytes"] <= max_bytes


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A join side that is broadcast if it is measured to be small, and shuffled otherwise.

    It is checkpointed first, so measuring it does not compute it twice.
    """
    shared_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Uses more cores when a table is so small that it comes in a few pieces.

    For work that is heavy per row.  The bound is a number of file splits (about 1 GB) and does not depend on the size of
    the cluster, so anything larger is returned as it is, without a shuffle.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 4 * FEW_SPLITS)
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  Spark limits each key before the shuffle, so hot keys stay cheap."""
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank_col) <= n)


def number_rows(df: DataFrame, order: list[Column], keys: list[str] | None = None, number_col: str = "row_id") -> DataFrame:
    """Gap-free row numbers from 0, for the whole table or per key, without a one-task window.

    The rows are range-partitioned on the complete order, so a key with very many rows is spread
    over many tasks.  The result is checkpointed because the range bounds are sampled: both passes
    below have to see the same partitions.
    """
    keys = keys or []
    shared_dir(df.sparkSession)
    sort = [F.col(k) for k in keys] + order
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__place", 33))
        .checkpoint()
    )
    runs = placed.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__place").alias("__start"))
    # Without keys this window sees one row per partition, with keys one row per key and partition.
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    if keys:
        named = [F.col(k).alias(f"__{k}") for k in keys]
        offsets = offsets.select("__start", "__before", F.col("__part").alias("__opart"), *named)
        match = F.col("__part") == F.col("__opart")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
        joined = placed.join(offsets, match).drop("__opart", *[f"__{k}" for k in keys])
    else:
        joined = placed.join(F.broadcast(offsets), "__part")  # one row per partition
    number = F.col("__place") - F.col("__start") + F.col("__before")
    return joined.withColumn(number_col, number.cast("long")).drop("__place", "__part", "__start", "__before")


def split_hot(df: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``limit`` rows, and the rows of all other keys (None if there are none).

    The key must not be NULL.
    """
    hot = small_side(df.groupBy(key).count().where(F.col("count") > limit).select(key))  # counted once
    if hot.isEmpty():
        return df, None
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")
