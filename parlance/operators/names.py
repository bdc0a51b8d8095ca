"""Name lists: union, cleaning and dictionary correction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import clean_name
from parlance.operators.blocks import arrow_schema, score_join
from parlance.operators.trie import Trie, letter_masks, ratio_of
from parlance.sizing import small_side, top_n

# Entries that a task holds as a trie (about 100 MB); only larger dictionaries go in slices.
MAX_ENTRIES = 200_000


def union_names(*sources: tuple[DataFrame, str]) -> DataFrame:
    """All names of all sources; duplicates stay."""
    first, *rest = [df.select(F.col(c).alias("cust_name")) for df, c in sources]
    for names in rest:
        first = first.unionByName(names)
    return first


def clean_names(df: DataFrame, name_col: str = "cust_name", id_col: str = "id") -> DataFrame:
    """Cleaned names in name order.  The id is part of the sort key, so equal names still spread out."""
    return df.withColumn(name_col, clean_name(F.col(name_col))).orderBy(name_col, id_col)


def similarity_ratio(a: str, b: str) -> int:
    """0 to 100: twice the longest common subsequence over the summed lengths, half rounded up."""
    return ratio_of(common_subsequence(letter_masks(a), len(a), b), len(a) + len(b))


def common_subsequence(masks: dict[str, int], length: int, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel rows."""
    full = (1 << length) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


class _Dictionary:
    """Best entry per word from a trie of the entries."""

    def __init__(self, asked: pa.Table, threshold: int, target: pa.Schema):
        entries = list(zip(asked.column("entry").to_pylist(), asked.column("position").to_pylist()))
        self.trie, self.entries = Trie(entries), {position: entry for entry, position in entries}
        self.threshold, self.target = threshold, target

    def feed(self, batch):
        hits = []
        for word in batch.column("word").to_pylist():
            found = self.trie.best(word, self.threshold)
            if found:
                ratio, position, _ = found
                hits.append((word, self.entries[position], ratio, position))
        yield pa.Table.from_arrays(
            [pa.array([h[i] for h in hits], type=f.type) for i, f in enumerate(self.target)], schema=self.target)

    def finish(self):
        return ()


def best_entries(
    words: DataFrame,
    dictionary: DataFrame,
    threshold: int = 70,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """For each distinct ``word``: the ``entry`` with the highest ratio strictly above the threshold.

    ``dictionary`` has ``position`` and ``entry``; the lowest position wins ties.  Words without such an
    entry are absent.  Each distinct word is aligned once however many rows hold it.
    """
    schema = "word string, entry string, ratio int, position bigint"
    target = arrow_schema(schema)
    dictionary = dictionary.select(F.col("position").cast("long").alias("position"), "entry").where(F.col("entry").isNotNull())
    unique = words.select("word").where(F.col("word").isNotNull()).distinct()
    partial = score_join(
        dictionary, unique, "position", lambda asked: _Dictionary(asked, threshold, target), schema, max_entries)
    return top_n(partial, ["word"], [F.col("ratio").desc(), F.col("position")], 1).drop("rank", "position")


def correct_names(df: DataFrame, name_col: str, dictionary: DataFrame, threshold: int = 70, **bounds: int) -> DataFrame:
    """Adds ``corrected`` and ``ratio``; both are NULL where no entry is close enough."""
    found = best_entries(df.select(F.col(name_col).alias("word")), dictionary, threshold, **bounds)
    found = found.select(F.col("word").alias(name_col), F.col("entry").alias("corrected"), "ratio")
    return df.join(small_side(found), name_col, "left")
