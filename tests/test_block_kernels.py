"""Block joins: results in parts, a row sent to few cells, exact neighbours from bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import cells, vectors
from parlance.operators.blocks import block_join
from parlance.operators.cells import CellIndex
from parlance.session import run_dir


def _frame(spark, x: np.ndarray, ids=None):
    kind = "string" if ids else "bigint"
    rows = [(i, [float(c) for c in row]) for i, row in zip(ids or range(len(x)), x)]
    return spark.createDataFrame(rows, f"id {kind}, embedding array<double>")


def _neighbours(x: np.ndarray, ids: list, k: int) -> set:
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 10) + 0.0
    best = {(a, tuple(sorted(((-scores[a, b], ids[b]) for b in range(len(x)) if b != a))[:k])) for a in range(len(x))}
    return {(ids[a], i, -s) for a, hits in best for s, i in hits}


def test_a_kernel_yields_parts(spark):
    rows = spark.range(10).select("id", F.lit(0).alias("cell"))

    def kernel(home: pa.Table, probe: pa.Table):
        for i in home.column("id").to_pylist():
            yield pa.table({"a": pa.array([i] * probe.num_rows, pa.int64()), "b": probe.column("id")})

    found = block_join(rows, rows, "id", "id", kernel, "a bigint, b bigint", 1, block_rows=4)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(10) for b in range(10)]
    assert block_join(rows, rows.where("id < 0"), "id", "id", kernel, "a bigint, b bigint", 1).count() == 0


@pytest.mark.parametrize("named", [False, True])
def test_neighbours_with_copies_and_zero_vectors(spark, named, monkeypatch):
    monkeypatch.setattr(cells, "_PAIR_CELLS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[20:60], x[70], x[71] = x[5], 0, 0
    ids = [f"k{i:03d}" for i in range(120)] if named else list(range(120))
    index = CellIndex(spark, run_dir(spark, "neighbours"))
    index.sync(_frame(spark, x, ids if named else None), n_cells=9)
    for block in (16, 1000):
        got = {(r["id"], r["neighbour"], r["score"]) for r in index.neighbours(4, block).collect()}
        assert got == _neighbours(x, ids, 4)


def test_a_row_is_sent_to_a_group_of_cells_once(spark, monkeypatch):
    sent = []

    def counted(home, probe, *rest):
        sent.append(probe.count())
        return block_join(home, probe, *rest)

    monkeypatch.setattr(cells, "block_join", counted)
    index = CellIndex(spark, run_dir(spark, "groups"))
    index.sync(_frame(spark, np.random.default_rng(5).normal(size=(400, 12))))  # 20 cells
    index.neighbours(3, 200).count()
    assert sent[0] == 400 and sent[1] <= 400 * 3


def test_low_thresholds_make_no_more_cells_than_blocks(spark, monkeypatch):
    sent = []

    def counted(home, probe, *rest):
        sent.append(probe.count())
        return block_join(home, probe, *rest)

    monkeypatch.setattr(vectors, "block_join", counted)
    x = np.random.default_rng(4).normal(size=(1600, 24))
    got = {(r["id_a"], r["id_b"]) for r in vectors.similarity_self_join(_frame(spark, x), 0.3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T > 0.3, 1))
    assert got == set(zip(a.tolist(), b.tolist()))
    assert sent[0] <= 1600 * 16  # 40 cells would be visited about 20 times each
    assert sent[0] < 1600 * 12
