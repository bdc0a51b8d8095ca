"""Similarity search and similarity joins over embedding columns.

Scores are cosines: vectors are scaled to unit length inside the scoring task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.blocks import BLOCK_ROWS, MAX_QUERIES, arrow_schema, block_join, score_join, sql_type
from parlance.session import shared_dir
from parlance.sizing import top_n

# Scores are compared to this many digits, so that the order of summation inside a product decides nothing.
SCORE_DIGITS = 10
_TILE = 1024
_CELLS = 2_000_000
# A self join has at least so many cells; where a row visits more than this share of many cells, it has no more than it needs.
_FEW_CELLS, _OPEN_SHARE = 16, 0.25


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix of unit rows; vectors of different length raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vector lengths differ: {lengths.min()} and {lengths.max()}")
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, sizes, out=np.zeros_like(matrix), where=sizes > 0)


def with_vector(batch, column: str):
    """The rows that have a vector.  Tested here and not in the plan, where a filter on a computed
    column would compute the embedding a second time."""
    valid = batch.column(column).is_valid()
    return batch if batch.column(column).null_count == 0 else batch.filter(valid)


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    if rows.shape[1] != queries.shape[1]:
        raise ValueError(f"vector lengths differ: {rows.shape[1]} and {queries.shape[1]}")
    return rows @ queries.T


def tiles(rows: int, queries: int) -> Iterator[slice]:
    """Row ranges whose score matrix stays small however many queries there are."""
    step = max(64, _CELLS // max(queries, 1))
    return (slice(start, min(start + step, rows)) for start in range(0, rows, step))


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_DIGITS) + 0.0


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers where they are numbers, which are compared and written without a Python object for each."""
    column = plain(column)
    exact = pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy() if exact else np.array(column.to_pylist(), dtype=object)


class TopK:
    """The best k (score descending, id ascending) per group and query, kept while batches pass."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.best: dict[object, list[list[tuple]]] = {}
        self.floor: dict[object, np.ndarray] = {}

    def add(self, group: object, ids: list, scores: np.ndarray, other: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """``scores`` has one row per id and one column per query, or per query in ``which``; -inf means no match."""
        if not len(ids) or not self.queries:
            return
        best = self.best.setdefault(group, [[] for _ in range(self.queries)])
        floor = self.floor.setdefault(group, np.full(self.queries, -np.inf))
        bound = floor if which is None else floor[which]
        if len(ids) > self.k:
            bound = np.maximum(bound, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        columns, rows = np.nonzero((scores >= bound).T & np.isfinite(scores.T))
        starts = np.flatnonzero(np.diff(columns, prepend=-1))
        for c, chosen in zip(columns[starts], np.split(rows, starts[1:])):
            q = c if which is None else which[c]
            new = [(-scores[r, c], ids[r], None if other is None else other[r, c]) for r in chosen]
            best[q] = sorted(best[q] + new, key=lambda item: item[:2])[: self.k]
            if len(best[q]) == self.k:
                floor[q] = -best[q][-1][0]

    def rows(self) -> Iterator[tuple]:
        """(group, query position, id, score, other score)"""
        for group, lists in self.best.items():
            for q, items in enumerate(lists):
                for negative, key, other in items:
                    yield group, q, key, -negative, other


def to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def vector_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    index_id: str = "id",
    index_vector: str = "embedding",
    group_col: str | None = None,
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """The ``k`` most similar index rows per query (and per group): query id, [group], id, score, rank.

    Ties are broken by id.  Each task hands on at most k rows per query.
    """
    groups = [group_col] if group_col else []
    index = index.select(index_id, index_vector, *groups)
    queries = queries.select(query_id, query_vector)
    fields = [(query_id, queries), *[(g, index) for g in groups], (index_id, index)]
    schema = ", ".join(f"{name} {sql_type(df, name)}" for name, df in fields) + ", score double"
    target = arrow_schema(schema)

    class Search:
        def __init__(self, asked: pa.Table):
            asked = with_vector(asked, query_vector)
            self.names = asked.column(query_id).to_pylist()
            self.vectors = unit_rows(asked.column(query_vector))
            self.top = TopK(len(self.names), k)

        def feed(self, batch):
            batch = with_vector(batch, index_vector)
            if not batch.num_rows or not self.names:
                return ()
            ids, vectors = batch.column(index_id).to_pylist(), unit_rows(batch.column(index_vector))
            groups = np.array(batch.column(group_col).to_pylist(), dtype=object) if group_col else None
            for tile in tiles(len(ids), len(self.names)):
                scores = rounded(cosines(vectors[tile], self.vectors))
                if groups is None:
                    self.top.add(None, ids[tile], scores)
                    continue
                for value in set(groups[tile].tolist()):
                    rows = np.flatnonzero(groups[tile] == value)
                    self.top.add(value, [ids[tile.start + r] for r in rows], scores[rows])
            return ()

        def finish(self):
            found = self.top.rows()
            if group_col:
                yield to_table([(self.names[q], g, key, s) for g, q, key, s, _ in found], target)
            else:
                yield to_table([(self.names[q], key, s) for _, q, key, s, _ in found], target)

    partial = score_join(queries, index, query_id, Search, schema, max_queries)
    return top_n(partial, [query_id, *groups], [F.col("score").desc(), F.col(index_id)], k)


def vector_threshold(
    queries: DataFrame,
    index: DataFrame,
    threshold: float,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    index_id: str = "id",
    index_vector: str = "embedding",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Every index row whose similarity to a query is strictly above the threshold; scored once per pair."""
    index, queries = index.select(index_id, index_vector), queries.select(query_id, query_vector)
    schema = f"{query_id} {sql_type(queries, query_id)}, {index_id} {sql_type(index, index_id)}, score double"
    target = arrow_schema(schema)

    class Above:
        def __init__(self, asked: pa.Table):
            asked = with_vector(asked, query_vector)
            self.names = plain(asked.column(query_id)).cast(target.field(0).type)
            self.vectors = unit_rows(asked.column(query_vector))

        def feed(self, batch):
            batch = with_vector(batch, index_vector)
            if not batch.num_rows or not len(self.names):
                return
            ids = plain(batch.column(index_id)).cast(target.field(1).type)
            vectors = unit_rows(batch.column(index_vector))
            for start in range(0, len(vectors), _TILE):
                scores = cosines(vectors[start:start + _TILE], self.vectors)
                rows, columns = np.nonzero(scores > threshold)
                if len(rows):
                    yield pa.Table.from_arrays(
                        [self.names.take(pa.array(columns)), ids.take(pa.array(rows + start)),
                         pa.array(rounded(scores[rows, columns]))], schema=target)

        def finish(self):
            return ()

    return score_join(queries, index, query_id, Above, schema, max_queries)


def nearest_rows(index: DataFrame, queries: DataFrame, k: int, index_id: str = "id", index_vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most similar to each chosen row, itself left out: query id, id, score, rank.

    ``queries`` holds ids of the index.  The result has at most k rows per query, whatever the threshold of a
    join would let through.
    """
    asked = index.join(queries.select(index_id), index_id, "left_semi").select(
        F.col(index_id).alias("query_id"), F.col(index_vector).alias("query_vector"))
    hits = vector_topk(asked, index, k + 1, index_id=index_id, index_vector=index_vector)
    others = hits.where(F.col("query_id") != F.col(index_id)).drop("rank")
    return top_n(others, ["query_id"], [F.col("score").desc(), F.col(index_id)], k)


def distinct_vectors(index: DataFrame, index_id: str = "id", index_vector: str = "embedding") -> DataFrame:
    """One row per distinct vector: its smallest id and how many rows hold it.

    Exact copies are folded before any pairing, so a group of copies costs one row, not its square.
    """
    return index.groupBy(index_vector).agg(F.min(index_id).alias(index_id), F.count("*").alias("copies"))


def copy_groups(index: DataFrame, index_id: str = "id", index_vector: str = "embedding") -> DataFrame:
    """Row id -> id of the row that stands for its vector in ``similarity_self_join``."""
    stand_ins = distinct_vectors(index, index_id, index_vector).select(
        F.col(index_vector).alias("__v"), F.col(index_id).alias("stand_in")
    )
    return index.join(stand_ins, F.col(index_vector) == F.col("__v")).select(index_id, "stand_in")


def _pivot_cells(pivots: np.ndarray, radius: float):
    """Cell = nearest pivot.  A row also visits each other cell its ball of ``radius`` can reach.

    For a row y with nearest pivot h, every point nearer to p than to h lies at least
    (|y-p|^2 - |y-h|^2) / (2 |p-h|) away, so a larger value rules the cell out: nothing is lost.
    """
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = (x ** 2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots ** 2).sum(1)[None]
        home = squares.argmin(1)
        gap = squares - squares[np.arange(len(x)), home][:, None]
        return home, gap <= 2 * apart[home] * radius + 1e-9

    return assign


def _projection_cells(directions: np.ndarray, radius: float, per_axis: int):
    """Cell = bucketed random projections, bucket width at least ``radius``.

    A projection never lengthens a distance, so every partner lies in the same or an adjacent
    bucket of each direction; visiting those makes the bucketing lossless.
    """
    width = max(radius, 2.0 / per_axis)
    axes = len(directions)
    base = int(np.ceil(1.0 / width)) + 1
    span = 2 * base + 1
    keys = np.stack(np.meshgrid(*[np.arange(span)] * axes, indexing="ij"), -1).reshape(-1, axes)

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.floor(x @ directions.T / width).astype(int) + base
        home = bucket @ (span ** np.arange(axes)[::-1])
        return home, (np.abs(bucket[:, None, :] - keys[None]) <= 1).all(2)

    return assign


def similarity_self_join(
    index: DataFrame,
    threshold: float,
    index_id: str = "id",
    index_vector: str = "embedding",
    cells: str = "pivots",
    n_cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs of distinct vectors with cosine strictly above the threshold.

    Columns: ``id_a < id_b``, ``score``, ``copies_a``, ``copies_b``.  Candidates come from cells that
    provably hold every partner (nearest ``pivots``, or bucketed random ``projections``), then the
    cosine itself decides.  High thresholds visit few cells; at low ones the join turns into a
    plain blocked product, which is what such a result costs.
    """
    shared_dir(index.sparkSession)
    radius = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    unique = distinct_vectors(index.select(index_id, index_vector), index_id, index_vector).checkpoint()
    unique = unique.where(F.col(index_vector).isNotNull())
    fixed, total = n_cells, unique.count()
    if n_cells is None:  # more vectors, more cells; a row keeps a flag for each, so their number stays bounded
        n_cells = int(np.clip(np.sqrt(total), _FEW_CELLS, 1024))

    chosen = unique.select(index_vector, index_id).orderBy(F.xxhash64(index_vector), index_id).limit(n_cells).toArrow()
    sample = unit_rows(chosen.column(0)) if chosen.num_rows else np.zeros((1, 1))
    if cells == "pivots":
        assign, max_cells = _pivot_cells(np.unique(sample, axis=0), radius), n_cells
        if fixed is None and assign(sample)[1].mean() > _OPEN_SHARE:
            # Cells rule out little here.  A row is sent to each cell it visits, so cells become as large as blocks.
            n_cells = max_cells = int(np.clip(np.ceil(total / block_rows), _FEW_CELLS, n_cells))
            assign = _pivot_cells(np.unique(sample[:n_cells], axis=0), radius)
    elif cells == "projections":
        width = sample.shape[1]
        axes = min(2, width)
        directions, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(width, axes)))
        per_axis = max(int(n_cells ** (1 / axes)), 1)
        assign, max_cells = _projection_cells(directions.T, radius, per_axis), (per_axis + 5) ** axes
    else:
        raise ValueError(f"unknown cells: {cells}")

    id_type = sql_type(unique, index_id)
    placed_schema = f"id {id_type}, copies bigint, v {sql_type(unique, index_vector)}, home int, visits array<int>"
    placed_arrow = arrow_schema(placed_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column(index_vector))
            home, reach = assign(x)
            # A pair is found once: the row of the higher cell visits the lower one.
            reach &= np.arange(reach.shape[1])[None] <= home[:, None]
            columns = [batch.column(index_id), batch.column("copies"), batch.column(index_vector), home.astype("int32"),
                       [np.flatnonzero(r) for r in reach]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, placed_arrow)], schema=placed_arrow)

    placed = unique.mapInArrow(place, placed_schema).checkpoint()
    home = placed.select("id", "copies", "v", "home", F.col("home").alias("cell"))
    probe = placed.select("id", "copies", "v", "home", F.explode("visits").alias("cell"))

    schema = f"id_a {id_type}, id_b {id_type}, score double, copies_a bigint, copies_b bigint"
    target = arrow_schema(schema)

    def kernel(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        a, b = unit_rows(left.column("v")), unit_rows(right.column("v"))
        a_id, b_id = (values(t.column("id")) for t in (left, right))
        a_n, b_n = left.column("copies").to_numpy(), right.column("copies").to_numpy()
        same_cell = right.column("home").to_numpy() == left.column("home")[0].as_py()
        for tile in tiles(len(a), len(b)):
            scores = a[tile] @ b.T
            i, j = np.nonzero(scores > threshold)
            s, i = scores[i, j], i + tile.start
            lower = (a_id[i] < b_id[j]).astype(bool)
            keep = ~same_cell[j] | lower
            i, j, s, lower = i[keep], j[keep], s[keep], lower[keep]
            pairs = [np.where(lower, a_id[i], b_id[j]), np.where(lower, b_id[j], a_id[i]), rounded(s),
                     np.where(lower, a_n[i], b_n[j]), np.where(lower, b_n[j], a_n[i])]
            yield pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(pairs, target)], schema=target)

    return block_join(home, probe, "id", "id", kernel, schema, max_cells, block_rows)
