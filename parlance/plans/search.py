"""Index upkeep, keyword, hybrid and multi-base search, pages and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.models import embed_names
from parlance.operators import search as ops
from parlance.operators.cells import CellIndex
from parlance.operators.evaluate import is_cited
from parlance.operators.index import content_hashes, read_index, snapshot_changes, sync_index
from parlance.operators.infer import embed_text
from parlance.operators.postings import hybrid_postings_topk, postings_topk, sync_postings
from parlance.operators.vectors import vector_topk
from parlance.plans.registry import SQL_WORDS, Tables, query, shown, sql_cells, sql_trigrams
from parlance.session import run_dir
from parlance.sizing import small_side, spread
from parlance.sources.pages import ingest_pages
from parlance.sources.tables import overwrite_table, scratch_schema
from parlance.streaming.jobs import index_stream, read_stream

_DOC_WORDS, _QUERY_WORDS = SQL_WORDS.format("text"), SQL_WORDS.format("text")

# The older state of the documents: no German ones yet, Spanish ones in capitals, French ones still there.
_OLD = "SELECT doc_id, CASE WHEN lang = 'es' THEN upper(text) ELSE text END AS text FROM documents WHERE lang <> 'de'"
_NEW = "SELECT doc_id, text FROM documents WHERE lang <> 'fr'"


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    changed = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    old = t.documents.where(F.col("lang") != "de").select("doc_id", changed.alias("text"))
    return old, t.documents.where(F.col("lang") != "fr").select("doc_id", "text")


@query(f"""
    WITH o AS ({_OLD}), n AS ({_NEW})
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
           CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text""")
def index_changes(t: Tables) -> DataFrame:
    old, new = (content_hashes(df, "doc_id", "text") for df in _snapshots(t))
    return snapshot_changes(old, new, "doc_id")


def _sql_index(rows: str) -> str:
    return f"""
    WITH n AS ({rows}), c AS ({sql_cells('n', 'doc_id', _DOC_WORDS)})
    SELECT doc_id, md5(text) AS content_hash, count(dim) AS n_cells, round(coalesce(sum(abs(value)), 0), 4) AS l1
    FROM n LEFT JOIN c ON c.key = n.doc_id GROUP BY doc_id, text"""


def _index_rows(index: DataFrame) -> DataFrame:
    return index.select(
        "doc_id", "content_hash",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_cells"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x)), 4).alias("l1"))


@query(_sql_index(_NEW))
def index_sync(t: Tables) -> DataFrame:
    table = f"{scratch_schema(t.spark, 'index_sync')}.documents_index"
    for snapshot in _snapshots(t):
        sync_index(spread(snapshot), table, "doc_id", "text")
    return _index_rows(read_index(t.spark, table))


@query(_sql_index("SELECT doc_id, text FROM documents WHERE lang <> 'fr'"))
def index_sync_stream(t: Tables) -> DataFrame:
    """Two deliveries of the documents pass through the triggered stream form; the second deletes the French ones."""
    folder, checkpoint = run_dir(t.spark, "index_stream_in"), run_dir(t.spark, "index_stream_state")
    table = f"{scratch_schema(t.spark, 'index_stream')}.documents_index"
    old, _ = _snapshots(t)
    new = t.documents.select("doc_id", "text", (F.col("lang") == "fr").alias("deleted"))
    for number, delivery in enumerate((old.withColumn("deleted", F.lit(False)), new)):
        delivery.withColumn("delivery", F.lit(number)).write.mode("append").parquet(folder)
        stream = read_stream(t.spark, folder, "doc_id bigint, text string, deleted boolean, delivery int")
        index_stream(stream, table, "doc_id", "text", checkpoint, F.struct("delivery", "text"), deleted=F.col("deleted")).awaitTermination()
    return _index_rows(read_index(t.spark, table))


_EVERY = "SELECT doc_id, text FROM documents"


@query(f"""
    WITH a AS ({_OLD}), b AS ({_NEW}), c AS ({_EVERY}),
    s AS (SELECT 2 AS version, a.doc_id AS o, b.doc_id AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text
          UNION ALL
          SELECT 3, b.doc_id, c.doc_id FROM b FULL JOIN c ON b.doc_id = c.doc_id WHERE b.text IS DISTINCT FROM c.text)
    SELECT version, coalesce(o, n) AS doc_id, CASE WHEN o IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' ELSE 'update' END AS change FROM s""")
def index_feed(t: Tables) -> DataFrame:
    """What each of three syncs of one stored index changed, read from its versions: of two versions only the cells that differ."""
    index = CellIndex(t.spark, run_dir(t.spark, "feed"), "doc_id")
    for state in (*_snapshots(t), t.documents.select("doc_id", "text")):
        index.sync(spread(state), text_col="text")
    first, *later = index.rows.versions()
    feed = [index.rows.changes_between(old, new, "doc_id").select(F.lit(new).alias("version"), "doc_id", "change")
            for old, new in zip([first, *later], later)]
    return reduce(DataFrame.unionByName, feed)


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _vector_queries(t: Tables) -> DataFrame:
    return embed_text(_queries(t), "query_text", vector_col="query_vector")


_BM25 = f"""
    dt AS (SELECT doc_id, unnest({_DOC_WORDS}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    dl AS (SELECT doc_id, len({_DOC_WORDS}) AS dl FROM documents),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest({_QUERY_WORDS}) AS term FROM benchmark),
    kw AS (
        SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 10) AS score
        FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
    kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM kr WHERE rank <= 5")
def keyword_topk(t: Tables) -> DataFrame:
    return shown(ops.keyword_topk(_queries(t), t.documents, 5, corpus_id="doc_id"))


@query(f"""
    WITH documents AS (SELECT * FROM documents WHERE lang <> 'fr'), {_BM25}
    SELECT query_id, doc_id, round(score, 4) AS score, rank FROM kr WHERE rank <= 5""")
def keyword_index_topk(t: Tables) -> DataFrame:
    """The stored postings follow two states of the documents; the second sync tokenises what differs only."""
    table = f"{scratch_schema(t.spark, 'postings')}.documents"
    for snapshot in _snapshots(t):
        sync_postings(snapshot, table, "doc_id", "text")
    return shown(postings_topk(_queries(t), table, 5, "doc_id"))


def _index_of(t: Tables, source: DataFrame, key: str, text_col: str) -> DataFrame:
    """key and embedding, from an index that a sync has built: searches read stored vectors."""
    table = f"{scratch_schema(t.spark, 'kb')}.base"
    sync_index(source.select(key, text_col), table, key, text_col)
    return read_index(t.spark, table).drop("content_hash")


def _sql_cosine(table: str, key: str, words: str) -> str:
    """v: query_id, doc key, rounded score for every pair."""
    return f"""
    qc AS ({sql_cells('benchmark', 'item_id', _QUERY_WORDS)}),
    dc AS ({sql_cells(table, key, words)}),
    hit AS (SELECT qc.key AS q, dc.key AS d, sum(qc.value * dc.value) AS raw FROM qc JOIN dc USING (dim) GROUP BY ALL),
    v AS (SELECT item_id AS query_id, {key}, round(coalesce(raw, 0), 10) + 0 AS score
          FROM benchmark CROSS JOIN {table} LEFT JOIN hit ON hit.q = item_id AND hit.d = {key})"""


_FUSED = """
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v),
    f AS (SELECT query_id, doc_id, coalesce(kr.rank, 0) AS keyword_rank, vr.rank AS vector_rank,
                 coalesce(1.0 / (60 + kr.rank), 0) + 1.0 / (60 + vr.rank) AS score
          FROM vr LEFT JOIN kr USING (query_id, doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


@query(f"""
    WITH {_BM25}, {_sql_cosine('documents', 'doc_id', _DOC_WORDS)}, {_FUSED}
    SELECT query_id, doc_id, keyword_rank, vector_rank, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def hybrid_topk(t: Tables) -> DataFrame:
    """Texts are embedded once into a table; both passes of the search read that table."""
    table = f"{scratch_schema(t.spark, 'hybrid')}.documents"
    overwrite_table(embed_text(spread(t.documents.select("doc_id", "text")), "text"), table)
    corpus = t.spark.table(table)
    return _ranked(ops.hybrid_topk(_vector_queries(t), corpus, 5, corpus_id="doc_id"))


@query(f"""
    WITH documents AS (SELECT * FROM documents WHERE lang <> 'fr'), {_BM25}, {_sql_cosine('documents', 'doc_id', _DOC_WORDS)}, {_FUSED}
    SELECT query_id, doc_id, keyword_rank, vector_rank, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def hybrid_index_topk(t: Tables) -> DataFrame:
    """Postings and vectors that followed two states of the documents; the search reads neither texts nor words."""
    name = scratch_schema(t.spark, "hybrid_index")
    for snapshot in _snapshots(t):
        sync_postings(snapshot, f"{name}.words", "doc_id", "text")
        sync_index(spread(snapshot), f"{name}.vectors", "doc_id", "text")
    return _ranked(hybrid_postings_topk(_vector_queries(t), f"{name}.words", read_index(t.spark, f"{name}.vectors"), 5, "doc_id"))


def _ranked(hits: DataFrame) -> DataFrame:
    """Keyword rank 0 where no word matched."""
    return shown(hits, 6).withColumn("keyword_rank", F.coalesce("keyword_rank", F.lit(0)))


@query(f"""
    WITH {_sql_cosine('documents', 'doc_id', _DOC_WORDS)},
    r AS (SELECT query_id, lang, doc_id, score,
                 row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS rank
          FROM v JOIN documents USING (doc_id))
    SELECT query_id, lang, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= CASE lang WHEN 'en' THEN 3 ELSE 2 END""")
def kb_topk(t: Tables) -> DataFrame:
    corpus = _index_of(t, spread(t.documents), "doc_id", "text").join(t.documents.select("doc_id", "lang"), "doc_id")
    return shown(ops.base_topk(_vector_queries(t), corpus, "lang", 2, {"en": 3}, index_id="doc_id"))


UPDATED = "2024-02-01 12:00:00"


def _pages(t: Tables) -> DataFrame:
    return ingest_pages(spread(t.pages), F.lit(UPDATED).cast("timestamp"))


def _sql_unescape(text: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


def _sql_strip(text: str) -> str:
    for pattern in (r"(?is)<head(\s[^>]*)?>.*?</head>", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>",
                    r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({_sql_unescape(text)}, '[ \\t\\r\\n]+', ' ', 'g'))"


_TITLE = "trim(" + _sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ")"
_PAGES = f"""
    p AS (SELECT page_id, url, html, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, {_TITLE} AS title,
                 {_sql_strip('html')} AS text FROM pages)"""


@query(f"""
    WITH {_PAGES}
    SELECT page_id, url AS source_url, host, title, text AS content, md5(html) AS html_md5,
           array_to_string(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^?#]*)', 1), '/'),
                                       lambda s: regexp_matches(s, '[^0-9]')), ',') AS tags,
           '{UPDATED}' AS last_updated FROM p""")
def page_text(t: Tables) -> DataFrame:
    return _pages(t).select(
        "page_id", "source_url", "host", "title", "content", F.md5("content_html").alias("html_md5"),
        F.array_join("tags", ",").alias("tags"), F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


@query(f"""
    WITH {_PAGES}, {_sql_cosine('p', 'page_id', _DOC_WORDS)},
    r AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM v)
    SELECT *, contains(answer, '[SOURCE URL:') AND contains(answer, 'example.com') AS cited FROM (
    SELECT query_id, string_agg('--- Document ' || rank || ' ---' || chr(10) || 'Document Title: ' || title || chr(10) || chr(10)
           || text || chr(10) || chr(10) || '[SOURCE URL: ' || url || ']', chr(10) || chr(10) ORDER BY rank) AS answer
    FROM r JOIN p USING (page_id) WHERE rank <= 2 GROUP BY query_id)""")
def kb_citations(t: Tables) -> DataFrame:
    pages, queries = _pages(t), _vector_queries(t)
    hits = small_side(vector_topk(queries, _index_of(t, pages, "page_id", "content"), 2, index_id="page_id"))
    # The raw pages meet the few hits first, and only those are parsed again.
    raw = t.pages.join(small_side(hits.select("page_id").distinct()), "page_id", "left_semi")
    cited = ops.with_columns(hits, ingest_pages(raw, F.lit(UPDATED).cast("timestamp")), "page_id", ["title", "content", "source_url"])
    answers = ops.cited_answers(queries, cited)
    return answers.withColumn("cited", is_cited(F.col("answer"), "[SOURCE URL:", "example.com"))


@query(f"""
    WITH {_PAGES},
    d AS (SELECT 'documents' AS base, doc_id AS id, text, text || chr(10) || chr(10) AS document FROM documents UNION ALL
          SELECT 'pages', page_id, text, 'Document Title: ' || title || chr(10) || chr(10) || text || chr(10) || chr(10)
                 || '[SOURCE URL: ' || url || ']' FROM p),
    k AS (SELECT *, base || id AS bid FROM d), {_sql_cosine('k', 'bid', _DOC_WORDS)},
    r AS (SELECT query_id, base, id, score, document, row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, id) AS rank
          FROM v JOIN k USING (bid))
    SELECT query_id, base, id, round(score, 4) AS score, document, rank FROM r WHERE rank <= CASE base WHEN 'pages' THEN 2 ELSE 3 END""")
def kb_search(t: Tables) -> DataFrame:
    """Two knowledge bases, each with its own number of results and its own columns."""
    documents = embed_text(spread(t.documents.select("doc_id", "text")), "text")
    pages = embed_text(_pages(t), "content")
    return shown(ops.search_bases(_vector_queries(t), [
        ops.KnowledgeBase("documents", documents, "doc_id", k=3, content="text"),
        ops.KnowledgeBase("pages", pages, "page_id", k=2, title="title", source_url="source_url")]))


_NAMES = ["bleu widget", "red wigdet", "steel gear", "small rring", "redbolt", "gizzmo"]
_NAME_TRIGRAMS = sql_trigrams("text")


@query(f"""
    WITH q(query_id) AS (VALUES {', '.join(f"('{n}')" for n in _NAMES)}), benchmark AS (SELECT query_id AS item_id, query_id AS text FROM q),
    documents AS (SELECT DISTINCT p_name AS doc_id, p_name AS text FROM part), {_BM25},
    qc AS ({sql_cells('benchmark', 'item_id', _NAME_TRIGRAMS)}), dc AS ({sql_cells('documents', 'doc_id', _NAME_TRIGRAMS)}),
    hit AS (SELECT qc.key AS q, dc.key AS d, sum(qc.value * dc.value) AS raw FROM qc JOIN dc USING (dim) GROUP BY ALL),
    v AS (SELECT item_id AS query_id, doc_id, round(coalesce(raw, 0), 10) + 0 AS score
          FROM benchmark CROSS JOIN documents LEFT JOIN hit ON hit.q = item_id AND hit.d = doc_id), {_FUSED}
    SELECT query_id, doc_id AS p_name, keyword_rank, vector_rank, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def name_hybrid_search(t: Tables) -> DataFrame:
    """The test set of misspelled names in hybrid mode: whole words by keyword, close spellings by trigram."""
    names = t.part.select("p_name", F.col("p_name").alias("text")).distinct()
    asked = t.spark.createDataFrame([(n, n) for n in _NAMES], "query_id string, query_text string")
    return _ranked(ops.search(
        embed_text(asked, "query_text", embed_names, "query_vector"), embed_text(names, "text", embed_names), 5,
        corpus_id="p_name"))
