"""Keyword, hybrid and multi-base search, and results formatted with citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.tokens import pieces, tokenise
from parlance.operators.blocks import MAX_QUERIES, arrow_schema, score_join, sql_type
from parlance.operators.vectors import TopK, cosines, rounded, tiles, to_table, unit_rows, vector_topk, with_vector
from parlance.session import shared_dir
from parlance.sizing import is_small, small_side, top_n

# The usual BM25 and reciprocal-rank-fusion constants.
K1, B, RRF = 1.2, 0.75, 60

NO_DOCUMENTS = "No relevant documents found."


def _texts(corpus: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return corpus.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"), *more)


def _term_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, df, total: the documents that hold each query term, and the sum of their lengths.

    The empty term stands for "any document", so corpus totals come from the same pass.  Each task
    counts its batches before the shuffle, so a frequent term costs no more than a rare one.
    """
    schema = "term string, df bigint, total bigint"
    wanted = None
    if is_small(vocabulary):
        wanted = texts.sparkSession.sparkContext.broadcast(vocabulary.toArrow().column(0).combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            tokens = tokenise(batch.column("text"))
            lengths = tokens.lengths()
            if wanted is None:
                coded = tokens.flat.dictionary_encode()
                names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                names = wanted.value
                codes = pc.index_in(tokens.flat, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(len(names), 1)
            docs, terms = np.divmod(np.unique((tokens.owner * width + codes)[codes >= 0]), width)
            df = np.bincount(terms, minlength=len(names))
            total = np.bincount(terms, weights=lengths[docs], minlength=len(names)).astype(np.int64)
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array([""]), names.take(pa.array(seen)).cast(pa.string())]),
                pa.array(np.append(batch.num_rows, df[seen])), pa.array(np.append(lengths.sum(), total[seen])),
            ], names=["term", "df", "total"])

    counts = texts.select("text").mapInArrow(count, schema).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total"))
    if wanted is not None:
        return counts
    return counts.join(vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("",)], "term string")), "term")


def _weighted_queries(queries: DataFrame, texts: DataFrame, query_id: str, query_text: str, *more: str) -> DataFrame:
    """Per query: its distinct terms and their idf, and the average document length."""
    id_type = sql_type(queries, query_id)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, query_text)):
            tokens = tokenise(batch.column(1))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(pa.array(tokens.owner))]),
                pa.concat_arrays([pa.array([""] * len(ids), type=pa.string()), tokens.flat.cast(pa.string())]),
            ], names=[query_id, "term"])

    shared_dir(queries.sparkSession)
    asked = queries.where(F.col(query_text).isNotNull()).select(query_id, query_text)
    terms = asked.mapInArrow(split, f"{query_id} {id_type}, term string").distinct().checkpoint()
    counts = _term_counts(texts, terms.select("term").where("term <> ''").distinct().checkpoint())
    # The empty term is in every query and has its totals; it is not part of the vocabulary.
    weighted = terms.join(counts, "term").groupBy(query_id).agg(
        F.collect_list(F.when(F.col("term") != "", F.struct("term", "df"))).alias("found"),
        F.max(F.when(F.col("term") == "", F.col("df"))).alias("docs"),
        F.max(F.when(F.col("term") == "", F.col("total") / F.col("df"))).alias("mean_length"),
    )
    idf = lambda t: F.log(1 + (F.col("docs") - t["df"] + 0.5) / (t["df"] + 0.5))
    prepared = weighted.select(
        query_id,
        F.transform("found", lambda t: t["term"]).alias("terms"),
        F.transform("found", idf).alias("idf"),
        "mean_length",
    )
    if more:
        prepared = prepared.join(queries.select(query_id, *more), query_id)
    return prepared


class _Keywords:
    """BM25 of token lists against all queries: one sparse count, then one product per chunk of queries.

    Chunks keep the term-by-query matrices small; a chunk knows only the terms of its own queries.
    """

    CHUNK, ROWS = 64, 512

    def __init__(self, asked: pa.Table):
        lists = asked.column("terms").to_pylist()
        weights = asked.column("idf").to_pylist()
        vocabulary = sorted({t for terms in lists for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        self.vocabulary, self.queries = pa.array(vocabulary, type=pa.string()), len(lists)
        self.chunks = []
        for start in range(0, len(lists), self.CHUNK):
            part = slice(start, start + self.CHUNK)
            own = np.array(sorted({place[t] for terms in lists[part] for t in terms}), dtype=np.int64)
            local = np.full(len(vocabulary), -1, dtype=np.int32)
            local[own] = np.arange(len(own))
            weight = np.zeros((len(own), len(lists[part])))
            for q, (terms, idf) in enumerate(zip(lists[part], weights[part])):
                for t, w in zip(terms, idf):
                    weight[local[place[t]], q] = w
            self.chunks.append((part, local, weight))
        means = [m for m in asked.column("mean_length").to_pylist() if m]
        self.mean_length = means[0] if means else 1.0

    def match(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, saturated frequency) of every query term in every document, by document."""
        width = max(len(self.vocabulary), 1)
        tokens = tokenise(texts)
        lengths = tokens.lengths()
        codes = pc.index_in(tokens.flat, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, counts = np.unique((tokens.owner * width + codes)[codes >= 0], return_counts=True)
        docs, terms = np.divmod(pairs, width)
        return docs, terms, self._grown(counts, lengths[docs])

    def match_counted(self, counted: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for documents that come as lists of (term, tf) with their lengths."""
        owner = np.repeat(np.arange(len(counted)), pc.list_value_length(counted).fill_null(0).to_numpy(zero_copy_only=False))
        flat = counted.flatten()
        codes = pc.index_in(flat.field("term"), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = codes >= 0
        docs = owner[known]
        return docs, codes[known], self._grown(flat.field("tf").to_numpy(zero_copy_only=False)[known], lengths[docs])

    def _grown(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.mean_length))

    def scores(self, matched: tuple[np.ndarray, np.ndarray, np.ndarray], rows: slice) -> np.ndarray:
        """Scores of a range of documents; -inf where no query term occurs."""
        docs, terms, grown = matched
        out = np.empty((rows.stop - rows.start, self.queries))
        for start in range(rows.start, rows.stop, self.ROWS):
            stop = min(start + self.ROWS, rows.stop)
            here = slice(*np.searchsorted(docs, [start, stop]))
            for part, local, weight in self.chunks:
                column = local[terms[here]]
                known = column >= 0
                counts = np.zeros((stop - start, len(weight)))
                counts[docs[here][known] - start, column[known]] = grown[here][known]
                out[start - rows.start:stop - rows.start, part] = counts @ weight
        return np.where(out > 0, rounded(out), -np.inf)


def keyword_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_text: str = "query_text",
    corpus_id: str = "id",
    corpus_text: str = "text",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """BM25 top ``k`` per query: query id, id, score, rank.  Only documents that share a term are results."""
    texts = _texts(corpus, corpus_id, corpus_text)
    prepared = _weighted_queries(queries, texts, query_id, query_text)
    return words_topk(prepared, texts, "text", lambda words, batch: words.match(batch.column("text")), k, query_id, corpus_id, max_queries)


def words_topk(
    prepared: DataFrame, corpus: DataFrame, content: str, match: Callable[[_Keywords, pa.RecordBatch], tuple], k: int, query_id: str, corpus_id: str,
    max_queries: int,
) -> DataFrame:
    """BM25 top ``k`` of weighted queries; ``match`` finds the query terms of a batch of documents, which it is given in pieces by ``content``."""
    queries = prepared
    schema = f"{query_id} {sql_type(queries, query_id)}, {corpus_id} {sql_type(corpus, corpus_id)}, score double"
    target = arrow_schema(schema)

    class Search:
        def __init__(self, asked: pa.Table):
            self.names = asked.column(query_id).to_pylist()
            self.keywords = _Keywords(asked)
            self.top = TopK(len(self.names), k)

        def feed(self, batch):
            for part in pieces(batch, content):
                ids, matched = part.column(corpus_id).to_pylist(), match(self.keywords, part)
                for tile in tiles(len(ids), len(self.names)):
                    self.top.add(None, ids[tile], self.keywords.scores(matched, tile))
            return ()

        def finish(self):
            yield to_table([(self.names[q], key, s) for _, q, key, s, _ in self.top.rows()], target)

    partial = score_join(prepared, corpus, query_id, Search, schema, max_queries)
    return top_n(partial, [query_id], [F.col("score").desc(), F.col(corpus_id)], k)


def hybrid_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_text: str = "query_text",
    query_vector: str = "query_vector",
    corpus_id: str = "id",
    corpus_text: str = "text",
    corpus_vector: str = "embedding",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Reciprocal rank fusion of the full keyword ranking and the full vector ranking.

    The first pass keeps the best ``2k + 60`` of each ranking.  A document outside both lists
    scores at most 2/(2k + 121), below the 1/(k + 60) that k documents reach for certain, so no
    winner is missing.  The second pass counts how many documents beat each kept one in either
    ranking, which gives its exact ranks without ever ranking the whole corpus.
    """
    docs = _texts(corpus, corpus_id, corpus_text, corpus_vector)
    shared_dir(queries.sparkSession)
    asked = _weighted_queries(
        queries, docs, query_id, query_text, query_vector
    ).checkpoint()  # both passes use it
    return fused_topk(asked, docs, "text", lambda words, batch: words.match(batch.column("text")), k, query_id, query_vector, corpus_id, corpus_vector,
                      max_queries)


def fused_topk(
    asked: DataFrame, docs: DataFrame, content: str, match: Callable[[_Keywords, pa.RecordBatch], tuple], k: int, query_id: str, query_vector: str,
    corpus_id: str, corpus_vector: str, max_queries: int,
) -> DataFrame:
    """Both passes of ``hybrid_topk`` over weighted queries; ``match`` finds the query terms of a batch of documents, cut by ``content``."""
    corpus, queries = docs, asked
    qtype, itype = sql_type(queries, query_id), sql_type(corpus, corpus_id)
    depth = 2 * k + RRF

    def prepare(table: pa.Table) -> tuple[pa.Table, _Keywords, np.ndarray]:
        table = with_vector(table, query_vector)
        return table, _Keywords(table), unit_rows(table.column(query_vector))

    def both(keywords: _Keywords, vectors: np.ndarray, batch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Ids, keyword scores and vector scores, tile by tile."""
        batch = with_vector(batch, corpus_vector)
        if not batch.num_rows or not len(vectors):
            return
        for part in pieces(batch, content):
            ids, rows = part.column(corpus_id).to_pylist(), unit_rows(part.column(corpus_vector))
            matched = match(keywords, part)
            for tile in tiles(len(ids), len(vectors)):
                yield ids[tile], keywords.scores(matched, tile), rounded(cosines(rows[tile], vectors))

    first_schema = f"{query_id} {qtype}, {corpus_id} {itype}, keyword_score double, vector_score double, by_keyword boolean"
    first_target = arrow_schema(first_schema)

    class Candidates:
        def __init__(self, table: pa.Table):
            table, self.keywords, self.vectors = prepare(table)
            self.names = table.column(query_id).to_pylist()
            self.by_keyword, self.by_vector = TopK(len(self.names), depth), TopK(len(self.names), depth)

        def feed(self, batch):
            for ids, kw, vec in both(self.keywords, self.vectors, batch):
                self.by_keyword.add(None, ids, kw, vec)
                self.by_vector.add(None, ids, vec, kw)
            return ()

        def finish(self):
            rows = [(self.names[q], key, s, o, True) for _, q, key, s, o in self.by_keyword.rows()]
            rows += [(self.names[q], key, o, s, False) for _, q, key, s, o in self.by_vector.rows()]
            yield to_table(rows, first_target)

    found = score_join(asked, docs, query_id, Candidates, first_schema, max_queries)
    own = F.when(F.col("by_keyword"), F.col("keyword_score")).otherwise(F.col("vector_score"))
    kept = top_n(found, [query_id, "by_keyword"], [own.desc(), F.col(corpus_id)], depth)
    candidates = kept.groupBy(query_id).agg(
        F.collect_set(F.struct(F.col(corpus_id).alias("id"), "keyword_score", "vector_score")).alias("items")
    )  # at most 2 * depth items per query

    second_schema = (
        f"{query_id} {qtype}, {corpus_id} {itype}, keyword_score double, vector_score double, "
        "keyword_ahead bigint, vector_ahead bigint"
    )
    second_target = arrow_schema(second_schema)

    class Ahead:
        def __init__(self, table: pa.Table):
            table, self.keywords, self.vectors = prepare(table)
            self.names = table.column(query_id).to_pylist()
            self.items = [[(i["id"], i["keyword_score"], i["vector_score"]) for i in items]
                          for items in table.column("items").to_pylist()]
            self.ahead = [np.zeros((len(items), 2), dtype=np.int64) for items in self.items]

        def feed(self, batch):
            for ids, *scores in both(self.keywords, self.vectors, batch):
                self.count(ids, scores)
            return ()

        def count(self, ids: list, both_scores: list[np.ndarray]) -> None:
            by_id = np.array(sorted(range(len(ids)), key=lambda r: ids[r]), dtype=np.int64)
            ids = np.array(ids, dtype=object)
            for which, scores in enumerate(both_scores):
                for q, items in enumerate(self.items):
                    order = by_id[np.argsort(-scores[by_id, q], kind="stable")]
                    down, keys = -scores[order, q], ids[order]
                    mine = np.array([-item[1 + which] for item in items])
                    lo, hi = np.searchsorted(down, mine, "left"), np.searchsorted(down, mine, "right")
                    ties = np.zeros(len(items), dtype=np.int64)
                    for n in np.flatnonzero(hi > lo):
                        ties[n] = np.searchsorted(keys[lo[n]:hi[n]], items[n][0], "left")
                    self.ahead[q][:, which] += np.where(np.isfinite(mine), lo + ties, 0)

        def finish(self):
            yield to_table([
                (name, *item, int(a[0]), int(a[1]))
                for name, items, ahead in zip(self.names, self.items, self.ahead) for item, a in zip(items, ahead)
            ], second_target)

    counted = score_join(
        asked.join(candidates, query_id), docs, query_id, Ahead, second_schema, max_queries
    )
    infinite = F.lit(float("-inf"))
    fused = (
        counted.groupBy(query_id, corpus_id, "keyword_score", "vector_score")
        .agg(F.sum("keyword_ahead").alias("k_ahead"), F.sum("vector_ahead").alias("v_ahead"))
        .withColumn("keyword_rank", F.when(F.col("keyword_score") > infinite, F.col("k_ahead") + 1))
        .withColumn("vector_rank", F.col("v_ahead") + 1)
        .withColumn("score", F.coalesce(1 / (RRF + F.col("keyword_rank")), F.lit(0.0)) + 1 / (RRF + F.col("vector_rank")))
        .select(query_id, corpus_id, "keyword_rank", "vector_rank", "score")
    )
    return top_n(fused, [query_id], [F.col("score").desc(), F.col(corpus_id)], k)


def search(queries: DataFrame, index: DataFrame, k: int = 5, mode: str = "hybrid", **columns: str) -> DataFrame:
    """One entry point for the three kinds of search (``vector``, ``keyword``, ``hybrid``)."""
    if mode == "vector":
        renamed = {"index_id": columns.get("corpus_id", "id"), "index_vector": columns.get("corpus_vector", "embedding")}
        kept = {n: columns[n] for n in ("query_id", "query_vector") if n in columns}
        return vector_topk(queries, index, k, **renamed, **kept)
    if mode == "keyword":
        kept = {n: c for n, c in columns.items() if n not in ("query_vector", "corpus_vector")}
        return keyword_topk(queries, index, k, **kept)
    if mode == "hybrid":
        return hybrid_topk(queries, index, k, **columns)
    raise ValueError(f"unknown mode: {mode}")


def base_topk(
    queries: DataFrame, index: DataFrame, base_col: str, k: int, per_base: dict[str, int] | None = None, **columns: str
) -> DataFrame:
    """Top results per query and knowledge base; ``per_base`` sets other numbers of results by base name."""
    per_base = per_base or {}
    deepest = max([k, *per_base.values()])
    hits = vector_topk(queries, index, deepest, group_col=base_col, **columns)
    wanted = F.lit(k)
    for name, number in per_base.items():
        wanted = F.when(F.col(base_col) == name, number).otherwise(wanted)
    return hits.where(F.col("rank") <= wanted)


@dataclass
class KnowledgeBase:
    """An index (id, embedding and text columns) with its own number of results and result columns."""

    name: str
    index: DataFrame
    id_col: str = "id"
    k: int = 2
    title: str | None = None
    content: str | None = "content"
    source_url: str | None = None
    vector: str = "embedding"


def search_bases(queries: DataFrame, bases: list[KnowledgeBase], query_id: str = "query_id", **columns: str) -> DataFrame:
    """Several knowledge bases at once: query id, base, id, score, rank, document.

    All bases are scored in one pass; then each hit gets the columns its own base shows.
    """
    parts = [b.index.select(F.lit(b.name).alias("base"), F.col(b.id_col).alias("id"), F.col(b.vector).alias("embedding"))
             for b in bases]
    every = reduce(DataFrame.unionByName, parts)
    limits = {b.name: b.k for b in bases}
    hits = base_topk(queries, every, "base", max(limits.values()), limits, query_id=query_id, **columns).checkpoint()
    shown = []
    for b in bases:
        document = citation(*[F.col(c) if c else None for c in (b.title, b.content, b.source_url)])
        texts = b.index.select(F.col(b.id_col).alias("id"), document.alias("document"))
        shown.append(with_columns(hits.where(F.col("base") == b.name), texts, "id", ["document"]))
    return reduce(DataFrame.unionByName, shown).select(query_id, "base", "id", "score", "rank", "document")


def with_columns(hits: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds the chosen source columns to the hits.  Hits are few; they are broadcast when measured so."""
    return source.select(key, *columns).join(small_side(hits), key)


def citation(title: Column | None = None, content: Column | None = None, source_url: Column | None = None) -> Column:
    """Title line, content and source marker; each part only if its column exists.  NULL prints as None."""
    parts = []
    if title is not None:
        parts.append(F.concat(F.lit("Document Title: "), F.coalesce(title, F.lit("None")), F.lit("\n\n")))
    if content is not None:
        parts.append(F.concat(F.coalesce(content, F.lit("None")), F.lit("\n\n")))
    if source_url is not None:
        parts.append(F.concat(F.lit("[SOURCE URL: "), F.coalesce(source_url, F.lit("None")), F.lit("]")))
    return F.concat(*parts) if parts else F.lit("")


def cited_answers(
    queries: DataFrame,
    hits: DataFrame,
    query_id: str = "query_id",
    title: str | None = "title",
    content: str | None = "content",
    source_url: str | None = "source_url",
) -> DataFrame:
    """One text per query: its hits in rank order, numbered, or the sentence for "nothing found".

    A query has at most k hits, so the list per query is bounded.
    """
    block = F.concat(
        F.lit("--- Document "), F.col("rank").cast("string"), F.lit(" ---\n"),
        citation(*[F.col(c) if c else None for c in (title, content, source_url)]),
    )
    texts = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("doc")))).alias("docs"))
    joined = F.array_join(F.transform("docs", lambda d: d["doc"]), "\n\n")
    return (
        queries.select(query_id)
        .join(texts, query_id, "left")
        .select(query_id, F.coalesce(joined, F.lit(NO_DOCUMENTS)).alias("answer"))
    )
