from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from parlance.functions.models import embed_batch
from parlance.operators import search as ops
from parlance.operators.infer import embed_text

WORDS = ["red", "blue", "bolt", "gear", "ring", "plate", "rod"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    docs = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(150)]
    docs += ["red bolt"] * 80 + ["", "nothing here"]  # one text fills a third of the rows
    queries = ["red bolt", "blue gear ring", "rod rod", "unknown", ""]
    return docs, queries


@pytest.fixture(scope="module")
def frames(spark, texts):
    docs, queries = texts
    corpus = spark.createDataFrame(list(enumerate(docs)), "id bigint, text string").repartition(6)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query_text string")
    return embed_text(asked, "query_text", vector_col="query_vector"), embed_text(corpus, "text")


def bm25(docs, query):
    tokens = [re.findall(r"\w+", d) for d in docs]
    mean = sum(map(len, tokens)) / len(docs)
    out = {}
    for i, doc in enumerate(tokens):
        score = 0.0
        for term in set(re.findall(r"\w+", query)):
            df, tf = sum(term in d for d in tokens), doc.count(term)
            if tf:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        if score > 0:
            out[i] = round(score, 10)
    return out


def ranked(scores):
    return {i: r + 1 for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)))}


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 2}])
def test_keyword_equals_brute_force(frames, texts, bounds):
    docs, queries = texts
    got = {(r.query_id, r.id): (r.score, r.rank) for r in ops.keyword_topk(*frames, 6, **bounds).collect()}
    want = {}
    for q, query in enumerate(queries):
        scores = bm25(docs, query)
        want.update({(q, i): (scores[i], r) for i, r in ranked(scores).items() if r <= 6})
    assert got == want


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 2}])
def test_hybrid_ranks_equal_full_rankings(frames, texts, bounds):
    docs, queries = texts
    vectors, asked = embed_batch(docs), embed_batch(queries)
    got = {(r.query_id, r.id): (r.keyword_rank, r.vector_rank, r.score, r.rank)
           for r in ops.hybrid_topk(*frames, 4, **bounds).collect()}
    want = {}
    for q, query in enumerate(queries):
        kw = ranked(bm25(docs, query))
        vec = ranked(dict(enumerate((np.round(vectors @ asked[q], 10) + 0.0).tolist())))
        fused = {i: (1 / (60 + kw[i]) if i in kw else 0.0) + 1 / (60 + r) for i, r in vec.items()}
        want.update({(q, i): (kw.get(i), vec[i], fused[i], r) for i, r in ranked(fused).items() if r <= 4})
    assert got == want


def test_search_modes_and_unknown_mode(frames):
    for mode in ("vector", "keyword", "hybrid"):
        assert ops.search(*frames, k=2, mode=mode).where("query_id = 0").count() == 2
    with pytest.raises(ValueError, match="unknown mode"):
        ops.search(*frames, mode="other")


def test_number_of_results_per_base(spark, frames):
    queries, corpus = frames
    from pyspark.sql import functions as F

    based = corpus.withColumn("base", F.when(F.col("id") < 100, "a").otherwise("b"))
    counts = ops.base_topk(queries, based, "base", 2, {"b": 3}).groupBy("query_id", "base").count().collect()
    assert {(r["base"], r["count"]) for r in counts} == {("a", 2), ("b", 3)}


def test_citations(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame(
        [(1, 2, "T2", "two", None), (1, 1, None, "one", "http://x/1")],
        "query_id bigint, rank bigint, title string, content string, source_url string")
    got = {r.query_id: r.answer for r in ops.cited_answers(queries, hits).collect()}
    assert got[1] == (
        "--- Document 1 ---\nDocument Title: None\n\none\n\n[SOURCE URL: http://x/1]\n\n"
        "--- Document 2 ---\nDocument Title: T2\n\ntwo\n\n[SOURCE URL: None]")
    assert got[2] == "No relevant documents found."
    bare = ops.cited_answers(queries, hits, title=None, source_url=None).where("query_id = 1").first().answer
    assert bare == "--- Document 1 ---\none\n\n\n\n--- Document 2 ---\ntwo\n\n"


def test_hits_bring_chosen_columns(spark, frames):
    queries, corpus = frames
    hits = ops.keyword_topk(queries, corpus, 3)
    full = ops.with_columns(hits, corpus, "id", ["text"])
    assert full.count() == hits.count() and "text" in full.columns and "embedding" not in full.columns
