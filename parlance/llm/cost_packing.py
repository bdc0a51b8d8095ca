"""Cost-balanced packing of token sequences.

Documents are dealt to groups of bounded size by a hash of their key, text and number among equal rows.  In every group whole sequences are
cut off first; what is left of each document goes, longest first, to the sequence with the lowest estimated
cost that still has room.  Only if none has room is a document cut again, so a group leaves less than one
sequence of padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import default_path, encoder
from parlance.llm.common import pieces, query, table, total_bytes

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double")
CHUNK = 1000  # equal rows that one task unfolds at a time
END = np.zeros(1, "<u4").tobytes()


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places lengths below ``capacity``, given in descending order, into as few sequences as can hold them.

    Returns (index, start, length, sequence, offset).  The cost of a part is linear in its length plus a
    quadratic term for the attention inside it.
    """
    n = int(-(-lengths.sum() // capacity))
    cost, room, out = np.zeros(n), np.full(n, capacity), []
    for i, length in enumerate(lengths.tolist()):
        start = 0
        while length:
            fits = room >= length
            if fits.any():
                k, part = int(np.where(fits, cost, np.inf).argmin()), length
            else:
                k = int(np.where(room > 0, cost, np.inf).argmin())
                part = int(room[k])
            out.append((i, start, part, k, capacity - int(room[k])))
            cost[k] += linear * part + quadratic * part * part
            room[k] -= part
            start, length = start + part, length - part
    return out


def _pack_group(group: int, keys: list, texts: list, path: str, capacity: int, linear: float, quadratic: float) -> pa.Table:
    encode = encoder(path).encode
    ids = [encode(t or "") + END for t in texts]
    tokens = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    parts: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset
    sequence = 0
    for d, n in enumerate(tokens.tolist()):
        for start in range(0, n - n % capacity, capacity):
            parts.append((d, start, capacity, sequence, 0))
            sequence += 1
    left = tokens % capacity
    order = np.argsort(-left, kind="stable")
    order = order[left[order] > 0]
    for i, start, length, k, offset in balance(left[order], capacity, linear, quadratic):
        d = int(order[i])
        parts.append((d, int(tokens[d] - left[d]) + start, length, sequence + k, offset))
    base = group << 32
    return pa.table({
        "doc_id": pa.array([keys[p[0]] for p in parts], pa.int64()),
        "start": pa.array([p[1] for p in parts], pa.int64()),
        "length": pa.array([p[2] for p in parts], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(memoryview(ids[p[0]])[4 * p[1]:4 * (p[1] + p[2])]) for p in parts], pa.int64()),
        "doc_tokens": pa.array([int(tokens[p[0]]) for p in parts], pa.int64()),
        "sequence_id": pa.array([base + p[3] for p in parts], pa.int64()),
        "offset": pa.array([p[4] for p in parts], pa.int64()),
        "cost": pa.array([linear * p[2] + quadratic * p[2] * p[2] for p in parts], pa.float64()),
    })


def numbered_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``repeat``, the number of a row among equal rows (doc_id, text), without a task that holds all of them."""
    counts = rows.groupBy("doc_id", F.xxhash64("text").alias("own")).count()
    if counts.where("count > 1").isEmpty():
        return rows.withColumn("repeat", F.lit(0).cast("long"))
    folded = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    chunks = folded.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition(F.xxhash64("doc_id", "text", "first"))
    last = F.least(F.col("n"), F.col("first") + CHUNK) - 1
    return chunks.select("doc_id", "text", F.explode(F.sequence("first", last)).alias("repeat"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 2048,
         group_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): where it starts, and its sequence and offset.

    A NULL or empty text is the single end id 0.  Rows that repeat a doc_id are packed one by one.  A NULL
    doc_id is kept.  Other columns are ignored.  An empty table has no pieces.  ``group_bytes`` bounds the
    text that one task holds, except that a text is never divided between tasks.
    """
    groups = pieces(total_bytes(docs), group_bytes)
    rows = numbered_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text", "repeat", F.lit("packing")), F.lit(groups))).drop("repeat")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return _pack_group(key[0].as_py(), rows["doc_id"].to_pylist(), rows["text"].to_pylist(), tokenizer, capacity, linear, quadratic)

    return dealt.groupBy("group").applyInArrow(run, SCHEMA)


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(table(spark, folder, "documents"), default_path())
