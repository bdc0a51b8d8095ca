"""A stored keyword index: postings kept by a sync, and keyword and hybrid search over them without reading texts again.

One table holds (term, key, content_hash, tf, length), partitioned by a hash of the term, and a second the live (key, content_hash,
length).  A sync tokenises new and changed texts only and appends their postings; postings of replaced and deleted
texts stay until ``compact_postings`` and are passed over, because their hash is not live.  The empty term is every
document's own row: it tells which texts are known, and how long they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import words
from parlance.functions.tokens import pieces, tokenise
from parlance.operators.blocks import MAX_QUERIES, sql_type
from parlance.operators.index import text_hash
from parlance.operators.search import fused_topk, words_topk
from parlance.operators.vectors import plain
from parlance.sizing import small_side
from parlance.sources.buckets import bucket_of
from parlance.sources.tables import overwrite_table, quoted, recover_table, table_or_none

PARTS = 32


def _postings(name: str) -> str:
    return f"{name}__postings"


def _terms(source: DataFrame, key: str, text: Column) -> DataFrame:
    """term, key, content_hash, tf, length: the words of a text are counted where it is read, so nothing is shuffled."""
    given = source.select(key, text_hash(text).alias("content_hash"), text.alias("text"))
    schema = f"term string, {key} {sql_type(given, key)}, content_hash string, tf long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            tokens = tokenise(batch["text"])
            coded = tokens.flat.cast(pa.string()).dictionary_encode()
            width = max(len(coded.dictionary), 1)
            pairs, tf = np.unique(tokens.owner * width + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            docs, terms = np.divmod(pairs, width)
            rows, lengths = np.concatenate([np.arange(batch.num_rows), docs]), tokens.lengths()
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array([""] * batch.num_rows, pa.string()), coded.dictionary.take(pa.array(terms))]),
                batch[key].take(pa.array(rows)), batch["content_hash"].take(pa.array(rows)),
                pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), tf])), pa.array(lengths[rows].astype(np.int64)),
            ], names=["term", key, "content_hash", "tf", "length"])

    return given.mapInArrow(run, schema)


def _read(spark: SparkSession, name: str, parts: list[int]) -> DataFrame:
    """Postings of some parts; the files of others are not opened."""
    return spark.table(quoted(_postings(name))).where(F.col("part").isin(parts))


def _documents(spark: SparkSession, name: str) -> DataFrame:
    own = spark.range(1).select(bucket_of(F.lit(""), PARTS)).first()[0]
    return _read(spark, name, [own]).where("term = ''")


def sync_postings(source: DataFrame, name: str, key: str, text_col: str) -> bool:
    """Brings the index in line with the source (unique keys); True if texts were tokenised.

    NULL texts are known documents without terms.  Running it again changes nothing, also after a run that was
    cut short: postings are appended for (key, hash) pairs only that have none yet, and the live table is replaced last.
    """
    spark = source.sparkSession
    recover_table(spark, name)
    hashes = source.select(key, text_hash(F.col(text_col)).alias("content_hash"))
    stored = table_or_none(spark, _postings(name)) is not None
    wanted = source
    if stored:
        known = _documents(spark, name).select(key, "content_hash").distinct()
        wanted = source.join(small_side(hashes.join(known, [key, "content_hash"], "left_anti").select(key)), key, "left_semi")
    fresh = not wanted.isEmpty()
    if fresh or not stored:
        rows = _terms(wanted, key, F.col(text_col)).withColumn("part", bucket_of(F.col("term"), PARTS))
        rows.hint("rebalance", F.col("part")).write.format("parquet").mode("append").partitionBy("part").saveAsTable(quoted(_postings(name)))
    lengths = _documents(spark, name).select(key, "content_hash", "length").distinct()
    overwrite_table(hashes.join(lengths, [key, "content_hash"]), name)
    return fresh


def compact_postings(spark: SparkSession, name: str, key: str) -> None:
    """Drops postings that are no longer live."""
    live = spark.table(quoted(name)).select(key, "content_hash")
    kept = spark.table(quoted(_postings(name))).join(live, [key, "content_hash"], "left_semi").select(
        "term", key, "content_hash", "tf", "length", "part").checkpoint()
    # If this is cut short after the drop, the next sync finds no postings and tokenises the source again.
    spark.sql(f"DROP TABLE {quoted(_postings(name))}")
    kept.hint("rebalance", F.col("part")).write.format("parquet").partitionBy("part").saveAsTable(quoted(_postings(name)))


def _found(spark: SparkSession, terms: DataFrame, name: str, key: str) -> tuple[Row, DataFrame]:
    """(number and mean length of documents, live postings of the terms); only the parts of the terms are read."""
    vocabulary = small_side(terms.select("term").distinct())
    parts = [r[0] for r in vocabulary.select(bucket_of(F.col("term"), PARTS)).distinct().collect()]  # at most PARTS numbers
    live = spark.table(quoted(name))
    total = live.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    found = _read(spark, name, parts).join(vocabulary, "term", "left_semi")
    found = found.join(small_side(live.select(key, "content_hash")), [key, "content_hash"], "left_semi")
    return total, found.select("term", key, "tf", "length").checkpoint()


def _weights(found: DataFrame, total: Row) -> DataFrame:
    df = F.col("df")
    return found.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (total["n"] - df + 0.5) / (df + 0.5)).alias("idf"))


def _asked(queries: DataFrame, found: DataFrame, total: Row, query_id: str, query_text: str, *more: str) -> DataFrame:
    """Per query its terms that some document has, with their weights."""
    terms = queries.select(query_id, F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
    weighted = terms.join(small_side(_weights(found, total)), "term").groupBy(query_id).agg(
        F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf"))
    return queries.select(query_id, *more).join(weighted, query_id, "left").select(
        query_id, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("idf", F.array().cast("array<double>")).alias("idf"),
        F.lit(total["mean"]).cast("double").alias("mean_length"), *more)


def _by_document(found: DataFrame, key: str) -> DataFrame:
    """The found postings of each document together: no more than the queries' different terms."""
    return found.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("counted"), F.max("length").alias("length"))


def _match(words_: object, batch: pa.RecordBatch) -> tuple:
    return words_.match_counted(plain(batch.column("counted")), batch.column("length").to_numpy())


def postings_topk(
    queries: DataFrame, name: str, k: int, key: str, query_id: str = "query_id", query_text: str = "query_text", max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """BM25 top ``k`` per query from the stored index: query id, key, score, rank.

    The postings of the queries' terms are gathered once per document and scored there for all queries, so rows of
    queries and documents never multiply.
    """
    queries = queries.where(F.col(query_text).isNotNull()).select(query_id, query_text).checkpoint()
    terms = queries.select(F.explode(words(F.col(query_text))).alias("term"))
    total, found = _found(queries.sparkSession, terms, name, key)
    return words_topk(_asked(queries, found, total, query_id, query_text), _by_document(found, key), "counted", _match, k, query_id, key, max_queries)


def hybrid_postings_topk(
    queries: DataFrame, name: str, index: DataFrame, k: int, key: str, query_id: str = "query_id", query_text: str = "query_text",
    query_vector: str = "query_vector", vector: str = "embedding", max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Reciprocal rank fusion of the full keyword ranking and the full vector ranking, from stored postings and stored vectors.

    query id, key, keyword_rank (NULL where no word matched), vector_rank, score, rank; the ranks are exact, as in ``hybrid_topk``.
    The postings of the queries' terms are gathered once per document, next to its stored vector; no text is read and nothing is
    embedded.  ``index`` holds the documents (key, vector) that the postings have; those without a vector take no part.
    """
    spark = queries.sparkSession
    queries = queries.where(F.col(query_text).isNotNull()).select(query_id, query_text, query_vector).checkpoint()
    index = index.where(F.col(vector).isNotNull()).select(key, vector)
    total, found = _found(spark, queries.select(F.explode(words(F.col(query_text))).alias("term")), name, key)
    asked = _asked(queries, found, total, query_id, query_text, query_vector).checkpoint()
    docs = index.join(_by_document(found, key), key, "left").select(
        key, vector, F.coalesce("counted", F.array().cast("array<struct<term: string, tf: bigint>>")).alias("counted"),
        F.coalesce("length", F.lit(0).cast("long")).alias("length")).checkpoint()  # both passes read it
    return fused_topk(asked, docs, "counted", _match, k, query_id, query_vector, key, vector, max_queries)
