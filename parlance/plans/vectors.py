"""Search and joins over embeddings and hashed names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.models import embed_names
from parlance.functions.registry import register_functions
from parlance.functions.vectors import norm
from parlance.operators.cells import CellIndex
from parlance.operators.infer import embed_distinct, embed_text as embed_column, nonzero_cells
from parlance.operators.vectors import nearest_rows, similarity_self_join, vector_threshold, vector_topk
from parlance.plans.registry import SQL_WORDS, Tables, query, shown, sql_cells, sql_trigrams
from parlance.session import run_dir
from parlance.sources.tables import overwrite_table, scratch_schema

THRESHOLD = 0.3
NAME_THRESHOLD = 0.3
NAME = "bleu widgit"
MISSPELLED = ["bleu widget", "wigdet", "stel gear", "small rring", "redbolt", "gizzmo"]


def centroids(embeddings: DataFrame) -> DataFrame:
    """One query per label: the mean vector of its rows, reduced per label and dimension."""
    means = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vector"))


_CENTROIDS = """
    SELECT label, list(m ORDER BY i) AS v FROM (
        SELECT label, i, avg(x) AS m FROM (
            SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
        GROUP BY label, i) GROUP BY label"""

_SCORED = f"""
    WITH q AS ({_CENTROIDS}),
    s AS (SELECT q.label AS query_id, vec_id, list_cosine_similarity(q.v, embedding::DOUBLE[]) AS raw FROM q, embeddings)"""


@query(f"""{_SCORED},
    r AS (SELECT query_id, vec_id, round(raw, 4) AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def semantic_topk(t: Tables) -> DataFrame:
    return shown(vector_topk(centroids(t.embeddings), t.embeddings, 5, index_id="vec_id"))


def _cell_index(t: Tables) -> CellIndex:
    """An index that followed two states of the vectors: fewer of them and some turned round, then all as they are."""
    index = CellIndex(t.spark, run_dir(t.spark, "cells"), "vec_id")
    turned = F.when(F.col("label") == 1, F.reverse("embedding")).otherwise(F.col("embedding"))
    index.sync(t.embeddings.where("label <> 2").select("vec_id", turned.alias("embedding")))
    index.sync(t.embeddings.select("vec_id", "embedding"))
    return index


@query(f"""{_SCORED},
    r AS (SELECT query_id, vec_id, round(raw, 4) AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def ann_topk(t: Tables) -> DataFrame:
    """The results of semantic_topk from stored cells, of which only those that can hold a result are opened."""
    return shown(_cell_index(t).topk(centroids(t.embeddings), 5))


@query("""
    WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw
               FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, neighbour, round(raw, 4) AS score,
                 row_number() OVER (PARTITION BY vec_id ORDER BY round(raw, 10) DESC, neighbour) AS rank FROM s)
    SELECT vec_id, neighbour, score, rank FROM r WHERE rank <= 3""")
def knn_graph(t: Tables) -> DataFrame:
    """The three nearest other vectors of every vector."""
    return shown(_cell_index(t).neighbours(3))


@query(f"{_SCORED} SELECT query_id, vec_id, round(raw, 4) AS score FROM s WHERE raw > {THRESHOLD}")
def semantic_threshold(t: Tables) -> DataFrame:
    hits = vector_threshold(centroids(t.embeddings), t.embeddings, THRESHOLD, index_id="vec_id")
    return shown(hits).orderBy(F.col("score").desc(), "query_id", "vec_id")


_PAIRS = f"""
    WITH u AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS id, count(*) AS copies FROM embeddings GROUP BY embedding)
    SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 4) AS score,
           a.copies AS copies_a, b.copies AS copies_b
    FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {THRESHOLD}"""


@query(_PAIRS)
def semantic_self_join(t: Tables) -> DataFrame:
    return shown(similarity_self_join(t.embeddings, THRESHOLD, "vec_id"))


@query(_PAIRS)
def lsh_self_join(t: Tables) -> DataFrame:
    return shown(similarity_self_join(t.embeddings, THRESHOLD, "vec_id", cells="projections"))


@query("""
    WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw
               FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT query_id, vec_id, round(raw, 4) AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def nearest_vectors(t: Tables) -> DataFrame:
    """Five neighbours of every twentieth vector, out of all vectors."""
    asked = t.embeddings.where("vec_id % 20 = 0").select("vec_id")
    return shown(nearest_rows(t.embeddings, asked, 5, "vec_id"))


@query("""
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x))), 4) AS l1,
           round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS l2,
           round(pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3))), 1.0 / 3), 4) AS l3,
           round(list_max(list_transform(v, lambda x: abs(x))), 4) AS l_max
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def vector_norms(t: Tables) -> DataFrame:
    v = F.col("embedding")
    sizes = {"l1": norm(v, 1), "l2": norm(v), "l3": norm(v, 3), "l_max": norm(v, "inf")}
    return t.embeddings.select("vec_id", *[F.round(size, 4).alias(name) for name, size in sizes.items()])


@query("""
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS dot,
           round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS l2,
           round(list_sum(list_transform(v, lambda x: abs(x))), 4) AS l1
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def sql_vector_functions(t: Tables) -> DataFrame:
    """The vector functions under their SQL names; they stay JVM expressions."""
    register_functions(t.spark)
    v = "CAST(embedding AS ARRAY<DOUBLE>)"
    return t.embeddings.selectExpr(
        "vec_id", f"round(dot_product({v}, {v}), 4) AS dot", f"round(vector_norm({v}), 4) AS l2", f"round(vector_pnorm({v}, 1D), 4) AS l1")


@query(f"SELECT key AS p_partkey, dim, round(value, 6) AS value FROM ({sql_cells('part', 'p_partkey', SQL_WORDS.format('p_name'))})")
def embed_text(t: Tables) -> DataFrame:
    """Names are stored, then the same table is rewritten with an embedding column."""
    table = f"{scratch_schema(t.spark, 'embed_text')}.names"
    overwrite_table(t.part.select("p_partkey", "p_name"), table)
    overwrite_table(embed_column(t.spark.table(table), "p_name"), table)
    return nonzero_cells(t.spark.table(table), "embedding", "p_partkey")


def _name_queries(t: Tables, names: list[str]) -> DataFrame:
    return embed_column(t.spark.createDataFrame([(n,) for n in names], "query_id string"), "query_id", embed_names, "query_vector")


def _sql_names(names: list[str]) -> str:
    listed = ", ".join(f"('{n}')" for n in names)
    return f"""
    WITH n AS (SELECT DISTINCT p_name FROM part), q(name) AS (VALUES {listed}),
    nc AS ({sql_cells('n', 'p_name', sql_trigrams('p_name'))}),
    qc AS ({sql_cells('q', 'name', sql_trigrams('name'))}),
    s AS (SELECT q.name AS query_id, n.p_name, coalesce(d.raw, 0) AS raw FROM q CROSS JOIN n
          LEFT JOIN (SELECT qc.key AS q, nc.key AS n, sum(qc.value * nc.value) AS raw FROM qc JOIN nc USING (dim) GROUP BY ALL) d
          ON d.q = q.name AND d.n = n.p_name)"""


@query(f"{_sql_names([NAME])} SELECT query_id, p_name, round(raw, 4) AS score FROM s WHERE raw > {NAME_THRESHOLD}")
def name_similarity(t: Tables) -> DataFrame:
    hits = vector_threshold(_name_queries(t, [NAME]), embed_distinct(t.part, "p_name", embed_names), NAME_THRESHOLD, index_id="p_name")
    return shown(hits).orderBy(F.col("score").desc(), "p_name")


_TOP_NAMES = """,
    r AS (SELECT query_id, p_name, round(raw, 4) AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, p_name) AS rank FROM s)
    SELECT query_id, p_name, score, rank FROM r WHERE rank <= 5"""


@query(_sql_names([NAME]) + _TOP_NAMES)
def name_similarity_topk(t: Tables) -> DataFrame:
    return shown(vector_topk(_name_queries(t, [NAME]), embed_distinct(t.part, "p_name", embed_names), 5, index_id="p_name"))


@query(_sql_names(MISSPELLED) + _TOP_NAMES)
def name_search_batch(t: Tables) -> DataFrame:
    """A set of misspelled names at once; every hit carries the name it answers."""
    return shown(vector_topk(_name_queries(t, MISSPELLED), embed_distinct(t.part, "p_name", embed_names), 5, index_id="p_name"))
