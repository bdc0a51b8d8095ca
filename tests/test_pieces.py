"""Tasks work on bounded pieces of a batch, however long its texts are."""

from __future__ import annotations

import gc
import weakref
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.functions.models import embed_batch, text_embedding_udf
from parlance.functions.tokens import PIECE_BYTES, cuts, pieces, tokenise
from parlance.operators import blocks, postings
from parlance.plans.registry import QUERIES
from parlance.session import ARROW_BATCH


def test_cuts_cover_all_rows_in_order():
    sizes = np.array([3, 0, 9, 1, 1, 30, 0, 2])
    parts = list(cuts(sizes, 10))
    assert [r for p in parts for r in range(p.start, p.stop)] == list(range(len(sizes)))
    assert all(sizes[p][:-1].sum() < 10 for p in parts)
    assert list(cuts(np.array([], dtype=np.int64))) == []


def test_pieces_of_texts_and_lists():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "bbbb", "", "c"], "counted": [[1, 2], [], None, [3], [4]]})
    assert pa.Table.from_batches(pieces(batch, "text", 4)).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in pieces(batch, "text", 4)] == [3, 2]
    assert [p.num_rows for p in pieces(batch, "counted", 64)] == [1, 4]


def test_long_texts_are_embedded_in_pieces(spark):
    text, asked = "word " * 100_000, []

    def embed(texts: list[str]) -> np.ndarray:
        asked.append(sum(map(len, texts)))
        return embed_batch(texts)

    series = pd.Series([text, None] * 10)
    found = [v for out in text_embedding_udf(embed).func(iter([series])) for v in out]
    assert max(asked) < PIECE_BYTES + len(text) and len(asked) > 1
    assert [v is None for v in found] == [False, True] * 10
    assert all(np.array_equal(v, embed_batch([text])[0]) for v in found[::2])


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    tasks, seen = [], []
    given = spark.createDataFrame([(1, "a")], "id bigint, text string")
    monkeypatch.setattr(type(given), "mapInArrow", lambda df, run, schema: tasks.append(run))
    postings._terms(given, "id", F.col("text"))
    monkeypatch.setattr(postings, "tokenise", lambda texts: seen.append(texts.nbytes) or tokenise(texts))
    texts = [f"n{i} " + "common " * 60_000 for i in range(12)]
    batch = pa.RecordBatch.from_pydict({"id": range(12), "content_hash": ["h"] * 12, "text": texts})
    rows = pa.Table.from_batches(tasks[0](iter([batch]))).to_pylist()
    assert max(seen) < PIECE_BYTES + 2 * len(texts[0]) and len(seen) > 1
    assert Counter((r["id"], r["term"], r["tf"]) for r in rows) == Counter(
        (i, term, tf) for i in range(12) for term, tf in (("", 0), (f"n{i}", 1), ("common", 60_000)))


def test_queries_bound_the_bytes_of_a_batch(spark, data):
    before = spark.conf.get(ARROW_BATCH[0])
    spark.conf.unset(ARROW_BATCH[0])
    QUERIES["vector_norms"](spark, data)
    assert spark.conf.get(ARROW_BATCH[0]) == ARROW_BATCH[1] == before


class Loop:
    """A passed batch as it hangs on in a reference cycle."""

    def __init__(self):
        self.own = self


def _kept_at_most(parts, seen: list) -> int:
    """The most cycles alive at once while the parts are consumed, with the collector's own starts switched off."""
    gc.collect()
    gc.disable()
    try:
        most = 0
        for _ in parts:
            loop = Loop()
            seen.append(weakref.ref(loop))
            most = max(most, sum(r() is not None for r in seen))
        return most
    finally:
        gc.enable()


def test_passed_pieces_do_not_hang_on():
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 100_000] * 60})
    seen: list = []
    assert _kept_at_most(pieces(batch, "text"), seen) <= 2
    assert len(seen) > 10


def test_passed_batches_do_not_hang_on(spark):
    seen: list = []
    assert _kept_at_most(text_embedding_udf().func(iter([pd.Series(["a", None])] * 20)), seen) <= 2
    assert len(seen) == 20


def test_scored_batches_do_not_hang_on(spark, monkeypatch):
    tasks, seen = [], []
    rows = spark.createDataFrame([(1,)], "id bigint")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema: tasks.append(run) or df)
    found = pa.table({"id": [1]})

    class Scorer:
        def __init__(self, asked):
            pass

        def feed(self, batch):
            yield found

        def finish(self):
            return iter(())

    blocks.score_join(rows, rows, "id", Scorer, "id bigint")
    assert _kept_at_most(tasks[0](iter(found.to_batches() * 20)), seen) <= 2
    assert len(seen) == 20
