from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.registry import drop_functions, register_functions
from parlance.functions.vectors import dot, norm, normalise
from parlance.operators.vectors import copy_groups, similarity_self_join, vector_threshold, vector_topk

RNG = np.random.default_rng(3)


def frame(spark, vectors, id_col="id", vec_col="embedding", first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{id_col} bigint, {vec_col} array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered():
    """A third of the rows are copies of one vector, others crowd around it, the rest are spread out."""
    base = RNG.normal(size=8)
    copies = np.repeat(base[None], 40, 0)
    near = base + RNG.normal(scale=0.15, size=(30, 8))
    return np.vstack([copies, near, RNG.normal(size=(50, 8))])


def brute_topk(index, queries, k):
    scores = np.round(unit(index) @ unit(queries).T, 10)
    return {(q, i, scores[i, q], r + 1) for q in range(len(queries))
            for r, i in enumerate(sorted(range(len(index)), key=lambda i: (-scores[i, q], i))[:k])}


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 2}])
def test_topk_equals_brute_force_on_skewed_rows(spark, clustered, bounds):
    queries = np.vstack([clustered[:1], RNG.normal(size=(6, 8))])
    got = vector_topk(frame(spark, queries, "query_id", "query_vector"), frame(spark, clustered).repartition(5), 7, **bounds)
    assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == brute_topk(clustered, queries, 7)


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 1}])
def test_threshold_is_strict_and_whole(spark, clustered, bounds):
    queries = RNG.normal(size=(4, 8))
    got = vector_threshold(frame(spark, queries, "query_id", "query_vector"), frame(spark, clustered), 0.2, **bounds)
    scores = unit(clustered) @ unit(queries).T
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, i) for i, q in zip(*np.nonzero(scores > 0.2))}
    exact = vector_threshold(frame(spark, [[1, 0]], "query_id", "query_vector"), frame(spark, [[1, 0], [0, 1]]), 1.0, **bounds)
    assert exact.count() == 0


@pytest.mark.parametrize("cells", ["pivots", "projections"])
@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.9, 0.99])
def test_self_join_is_lossless(spark, clustered, cells, threshold):
    got = similarity_self_join(frame(spark, clustered).repartition(6), threshold, cells=cells, n_cells=9, block_rows=11)
    firsts = [0, *range(40, len(clustered))]
    scores = unit(clustered) @ unit(clustered).T
    want = {(a, b, 40 if a == 0 else 1) for a in firsts for b in firsts if a < b and scores[a, b] > threshold}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r.id_a, r.id_b, r.copies_a) for r in rows} == want


def test_copies_lead_back_to_every_row(spark, clustered):
    groups = {r.id: r.stand_in for r in copy_groups(frame(spark, clustered)).collect()}
    assert [groups[i] for i in range(40)] == [0] * 40 and len(groups) == len(clustered)


def test_self_join_of_nothing(spark):
    assert similarity_self_join(frame(spark, []), 0.5).count() == 0


def test_null_vectors_are_left_out(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, query_vector array<double>")
    assert [(r.query_id, r.id) for r in vector_topk(queries, index, 3).collect()] == [(1, 1)]
    assert [(r.query_id, r.id) for r in vector_threshold(queries, index, 0.5).collect()] == [(1, 1)]


def test_different_lengths_raise(spark):
    index, queries = frame(spark, [[1, 0, 0]]), frame(spark, [[1, 0]], "query_id", "query_vector")
    with pytest.raises(Exception, match="vector lengths differ: 3 and 2"):
        vector_topk(queries, index, 1).collect()
    with pytest.raises(Exception, match="vector lengths differ"):
        spark.range(1).select(dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_scalar_expressions(spark):
    v = F.array(F.lit(3.0), F.lit(-4.0))
    none = F.lit(None).cast("array<double>")
    row = spark.range(1).select(
        norm(v), norm(v, 1), norm(v, 3), norm(v, "inf"), norm(v, "-inf"), norm(v, 0), dot(v, v), dot(v, none), normalise(v)).first()
    assert [round(x, 6) for x in row[:7]] == [5, 7, round(91 ** (1 / 3), 6), 4, 3, 2, 25]
    assert row[7] is None and row[8] == [0.6, -0.8]


def test_sql_functions(spark):
    register_functions(spark, model=lambda texts: [t.upper() for t in texts], lexicon=(["good"], ["it's", "bad"]))
    labels = spark.sql("SELECT text_sentiment(c) s FROM VALUES ('Good'), ('bad'), ('good bad'), ('x'), (NULL) AS v(c)").collect()
    assert [r.s for r in labels] == ["positive", "negative", "mixed", "neutral", None]
    row = spark.sql("""SELECT dot_product(array(1D, 2D), array(3D, 4D)) AS d, vector_norm(array(3D, 4D)) AS n,
        vector_pnorm(array(3D, -4D), 1D) AS p, round(text_similarity('red bolt', 'bolt red'), 6) AS same,
        call_model('a').result AS r, dot_product(NULL, array(1D)) AS missing""").first()
    assert tuple(row) == (11.0, 5.0, 7.0, 1.0, "A", None)
    plan = spark.sql("SELECT id FROM range(3) WHERE dot_product(array(id), array(id)) > 1")._jdf.queryExecution().toString()
    assert "EvalPython" not in plan
    drop_functions(spark)
    with pytest.raises(Exception, match="dot_product"):
        spark.sql("SELECT dot_product(array(1D), array(1D))").collect()


def test_ranking_uses_unrounded_scores(spark):
    """Scores that differ only behind the fourth digit."""
    rows = [(i, [1.0, 0.001 * (20 - i)]) for i in range(1, 20)]
    index = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, query_vector array<double>")
    assert [r.id for r in vector_topk(query, index, 3).orderBy("rank").collect()] == [19, 18, 17]


def test_many_queries_go_in_slices_without_a_cross_join(spark, clustered):
    index = frame(spark, clustered)
    queries = index.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one, many = vector_topk(queries, index, 2), vector_topk(queries, index, 2, max_queries=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("NestedLoop", "Cartesian", "CoGroup"))
