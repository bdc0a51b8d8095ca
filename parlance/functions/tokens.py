"""Words of a batch of texts, in Arrow.  Used inside tasks; ``functions.text.words`` is the column form."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NO_WORD = r"[^\p{L}\p{N}]+"

# Tokens, their owners and codes take many times the bytes of a text, so a task works on this much of a batch at a time.
PIECE_BYTES = 2 << 20
_ENTRY_BYTES = 32  # a listed (term, tf)
_set_aside = False


def give_back() -> None:
    """Returns the memory of earlier batches to the system.

    Batches that have passed hang on in reference cycles of few but large objects, so the collector rarely starts by
    itself, and allocators keep what is freed; a task's memory then grows with its input and stays with the worker.
    What is there at the first call, mostly modules, is set aside once, so that a later collection takes little time.
    """
    global _set_aside
    gc.collect()
    if not _set_aside:
        gc.freeze()
        _set_aside = True
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def cuts(sizes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[slice]:
    """Row ranges, in order, whose sizes add up to about ``limit``: less than that and one more row."""
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit, prepend=-1))
    return (slice(int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(sizes)]))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts that hold about ``limit`` bytes of a text column, or of a list column, each."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.list_value_length(values).cast(pa.int64()), _ENTRY_BYTES)
    else:
        sizes = pc.binary_length(values).cast(pa.int64())
    for part in cuts(sizes.fill_null(0).to_numpy(zero_copy_only=False), limit):
        yield batch.slice(part.start, part.stop - part.start)
        give_back()


@dataclass
class Tokens:
    """All tokens of a batch in order, the row each belongs to, and the number of rows."""

    flat: pa.Array
    owner: np.ndarray
    rows: int

    def lengths(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.rows)


def tokenise(texts: pa.Array | pa.ChunkedArray) -> Tokens:
    """Lower-case runs of letters and digits.  A NULL text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), pattern=NO_WORD)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten()
    keep = pc.not_equal(flat, "")
    return Tokens(flat.filter(keep), owner[keep.to_numpy(zero_copy_only=False)], len(texts))


def from_lists(lists: list[list[str]]) -> Tokens:
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
    return Tokens(pa.array([t for x in lists for t in x], type=pa.string()), owner, len(lists))
