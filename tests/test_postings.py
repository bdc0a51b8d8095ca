from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators.postings import compact_postings, hybrid_postings_topk, postings_topk, sync_postings
from parlance.operators.search import hybrid_topk, keyword_topk


def docs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string")


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def test_stored_postings_follow_the_source(spark, schema_name):
    name = f"{schema_name}.words"
    queries = spark.createDataFrame([(1, "red bolt bolt"), (2, "gear"), (3, None), (4, "none")], "query_id bigint, query_text string")
    first = [(1, "red bolt"), (2, "blue gear gear"), (3, None), (4, ""), (5, "bolt bolt gear " * 5)]
    second = [(1, "red bolt"), (2, "blue bolt"), (4, "gear"), (6, "red red gear")]
    assert sync_postings(docs(spark, first), name, "id", "text")
    assert not sync_postings(docs(spark, first), name, "id", "text")
    postings = lambda: spark.table(f"{name}__postings").where("term <> ''").count()
    before = postings()
    assert sync_postings(docs(spark, second), name, "id", "text")
    # Only the changed texts were tokenised: 2, 4 and 6 bring two, one and two terms.
    assert postings() == before + 5
    for _ in range(2):
        assert hits(postings_topk(queries, name, 3, "id")) == hits(keyword_topk(queries, docs(spark, second), 3))
        compact_postings(spark, name, "id")


def test_going_back_to_an_earlier_text_needs_no_tokenising(spark, schema_name):
    name = f"{schema_name}.back"
    for rows in ([(1, "red")], [(1, "blue")]):
        sync_postings(docs(spark, rows), name, "id", "text")
    assert not sync_postings(docs(spark, [(1, "red")]), name, "id", "text")
    queries = spark.createDataFrame([(1, "red blue")], "query_id bigint, query_text string")
    assert len(hits(postings_topk(queries, name, 3, "id"))) == 1


@pytest.mark.parametrize("k, bound", [(1, 4096), (5, 4096), (5, 2)])
def test_hybrid_from_postings_equals_hybrid_from_texts(spark, schema_name, k, bound):
    rng = np.random.default_rng(k)
    words = ["red", "blue", "bolt", "gear", "ring", "axle"]
    # Few words and few directions, so that both rankings have many ties; some rows lack a text or a vector.
    rows = [(n, None if n % 41 == 0 else " ".join(rng.choice(words, rng.integers(0, 6))), None if n % 37 == 5 else rng.integers(-1, 2, 3).astype(float).tolist())
            for n in range(300)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, embedding array<double>").where("text is not null")
    queries = spark.createDataFrame(
        [(n, " ".join(rng.choice([*words, "none"], 2)), rng.integers(-1, 2, 3).astype(float).tolist()) for n in range(7)] + [(8, "none", [1.0, 0.0, 0.0]), (9, "red", None)],
        "query_id bigint, query_text string, query_vector array<double>")
    name = f"{schema_name}.hybrid{k}_{bound}"
    sync_postings(corpus.where("embedding is not null"), name, "id", "text")
    found = hybrid_postings_topk(queries, name, corpus.select("id", "embedding"), k, "id", max_queries=bound)
    expected = hybrid_topk(queries.where("query_vector is not null"), corpus.where("embedding is not null"), k)
    columns = ["query_id", "id", "keyword_rank", "vector_rank", F.round("score", 9).alias("score"), "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))


def test_search_reads_the_parts_of_its_terms(spark, schema_name):
    name = f"{schema_name}.parts"
    sync_postings(docs(spark, [(n, f"word{n} other{n % 7}") for n in range(200)]), name, "id", "text")
    from parlance.operators.postings import PARTS, _read

    plan = _read(spark, name, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "[3,5]" in plan.replace(", ", ",").replace("(", "[").replace(")", "]")
    assert len({r.part for r in spark.table(f"{name}__postings").select("part").distinct().collect()}) > PARTS // 2
