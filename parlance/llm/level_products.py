"""Term divergences between the sources of each language, priced from joint tables of count levels.

The price of a term for two groups depends only on its counts in both, so all that a pair of groups needs is a joint
table: how many terms have count level a in the one and b in the other.  A block of terms becomes an indicator matrix, one
row per term and one column per (group, count level) that occurs in it; the matrix multiplied by its transpose
holds the joint tables of every pair of groups at once.  Blocks are added up.  Levels of zero need no columns: what they
hold follows from the sizes of the other levels.

Everything is whole numbers.  A product cell counts at most 4,096 terms, which 32-bit floats hold exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import discard, query, stored, table
from parlance.sizing import small_side

SCALE = 1_000_000_000
MIN_DOCS = 3
ROWS, COLUMNS = 4096, 1024  # terms of one product, columns of one tile
BLOCK_ENTRIES = 200_000  # non-zero counts of one block
MAX_TERMS = 400_000  # terms that a counting task holds
WRAP = 1 << 64

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8").translate(_LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of (lang, source, text) without NULLs; an empty term stands for every group that occurs."""

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, held) in groups.items():
            names = [b"", *total]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string()),
                pa.array([0, *total.values()], pa.int64()), pa.array([0, *(held[t] for t in names[1:])], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
                total, held = groups.setdefault((lang, source), (Counter(), Counter()))
                found = terms_of(text)
                total.update(found)
                held.update(set(found))
            if sum(len(total) for total, _ in groups.values()) > MAX_TERMS:
                yield from rows(groups)
                groups = {}
        yield from rows(groups)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for counts of any size."""
    wide = F.lit(SCALE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _costs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def indicator_products(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left column, right column, rows that have both) of the indicator matrix times its transpose, left < right.

    ``rows`` is ascending.  Row ranges are halved until their columns fit one tile; a single row with more columns
    is multiplied tile by tile.
    """
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    ends = np.append(starts[1:], len(rows))
    todo = [(k, min(k + ROWS, len(starts))) for k in range(0, len(starts), ROWS)]
    while todo:
        low, high = todo.pop()
        part = slice(starts[low], ends[high - 1])
        own, local = np.unique(columns[part], return_inverse=True)
        if len(own) > COLUMNS and high - low > 1:
            middle = (low + high) // 2
            todo += [(low, middle), (middle, high)]
            continue
        matrix = np.zeros((high - low, len(own)), np.float32)
        matrix[np.repeat(np.arange(high - low), ends[low:high] - starts[low:high]), local] = 1
        for a in range(0, len(own), COLUMNS):
            for b in range(a, len(own), COLUMNS):
                product = matrix[:, a:a + COLUMNS].T @ matrix[:, b:b + COLUMNS]
                i, j = np.nonzero(np.triu(product, 1) if a == b else product)
                yield own[a + i], own[b + j], product[i, j].astype(np.int64)


def _added(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(values, starts) if len(starts) else values


def block_prices(block: pa.Table) -> pa.Table:
    """source, item, value: what a block of (lang, term, source, p, zero) adds to each ordered pair of groups.

    Cells are priced against what their terms would cost at level zero.  Sums wrap at 64 bits, as their consumer expects.
    """
    block = block.combine_chunks()
    source = block["source"].combine_chunks().dictionary_encode()
    term = block["term"].combine_chunks().dictionary_encode()
    names, group = source.dictionary, source.indices.to_numpy().astype(np.int64)
    term = term.indices.to_numpy().astype(np.int64)
    p, zero = block["p"].to_numpy(), block["zero"].to_numpy()
    # Frequent terms have many levels and rare ones few: rows of about one frequency share their columns.
    weight = np.zeros(term.max() + 1, np.int64)
    np.maximum.at(weight, term, p)
    order = np.lexsort((group, term, weight[term]))
    term, group, p, zero = term[order], group[order], p[order], zero[order]
    row = np.cumsum(np.diff(term, prepend=term[0]) != 0)
    levels, column = np.unique(np.stack([group, p], 1), axis=0, return_inverse=True)
    of_zero = np.zeros(len(names), np.int64)
    of_zero[group] = zero
    width = len(names)
    codes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    for i, j, n in indicator_products(row, column.ravel()):
        gi, gj, pi, pj = levels[i, 0], levels[j, 0], levels[i, 1], levels[j, 1]
        zi, zj = of_zero[gi], of_zero[gj]
        codes += [gi * width + gj, gj * width + gi]
        values += [n * (_costs(pi, pj) - _costs(pi, zj) - _costs(zi, pj) + _costs(zi, zj)),
                   n * (_costs(pj, pi) - _costs(pj, zi) - _costs(zj, pi) + _costs(zj, zi))]
        held += 2 * len(n)
        if held > 1 << 20:
            done = _added(np.concatenate(codes), np.concatenate(values))
            codes, values, held = [done[0]], [done[1]], 0
    code, value = _added(np.concatenate(codes), np.concatenate(values))
    lang = pa.array([block["lang"][0].as_py()] * len(code), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(code // width)), names.take(pa.array(code % width)), pa.array(value)],
                                names=["lang", "source", "item", "value"])


def divergences(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = 200, min_docs: int = MIN_DOCS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language lies from its other sources (``pair``), and
    the terms by which it exceeds the language (``term``, ``top`` ranks per source).

    NULL texts, languages and sources count as empty strings; an empty table gives no rows.  Rows that are repeated are documents of
    their own.  A language keeps the terms of ``min_docs`` documents or more; one that keeps none has pairs of value 0 and no terms.
    Ties of a value are ordered by the bytes of the item.  Other columns are ignored, whatever their names.  A group of a third
    of all rows is counted inside the scan tasks before anything is shuffled.
    """
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # One exchange by (lang, term) serves the sums per source, those per language and their join.
    counts = count_terms(texts).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "level-counts")
    groups = counts.where("term = ''").select("lang", "source")
    used = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).drop("docs")
    entries = stored(counts.where("term <> ''").drop("docs").join(used, ["lang", "term"]), "level-entries")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = entries.select("lang", "term", "of_lang").groupBy("lang", "term").agg(F.max("of_lang").alias("of_lang"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"),
        "lang_total")
    known = small_side(known.withColumn("zero", F.when(F.col("terms") > 0, price(F.lit(0).cast("long"), F.col("total"), F.col("terms")))))
    priced = entries.join(known, ["lang", "source"]).select(
        "lang", "source", "term", "zero", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        price(F.col("of_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    priced = stored(priced, "level-prices")
    discard(counts)

    order = [F.col("value").desc(), F.col("item")]
    per_group = Window.partitionBy("lang", "source").orderBy(*order)
    ranked = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    by_term = ranked.withColumn("rank", F.row_number().over(per_group)).where(F.col("rank") <= top)

    blocks = max(1, -(-priced.count() // block_entries))
    placed = priced.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "term", "source", "p", "zero")
    cells = placed.groupBy("lang", "block").applyInArrow(block_prices, "lang string, source string, item string, value long")
    joint = cells.select("lang", "source", "item", F.col("value").cast("decimal(20,0)").alias("value"))

    # Terms at level zero of one side or both, from the sizes of the levels.
    zeros = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    levels = small_side(priced.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n")))
    wide = lambda value: (F.col("n").cast("decimal(20,0)") * value.cast("decimal(19,0)")).cast("decimal(38,0)")
    beside = levels.join(zeros, "lang").where("source <> item")
    own, p, other = F.col("zero"), F.col("p"), F.col("other")
    forward = beside.select("lang", "source", "item", wide(cost(p, other) - cost(own, other)).alias("value"))
    back = beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(cost(other, p) - cost(other, own)).alias("value"))
    base = known.select("lang", "source", "zero", F.col("terms").alias("n")).join(zeros, "lang").where("source <> item").select(
        "lang", "source", "item", F.coalesce(wide(cost(own, other)), F.lit(0).cast("decimal(38,0)")).alias("value"))
    pairs = joint.union(forward).union(back).union(base).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    exact = F.pmod("value", F.lit(str(WRAP)).cast("decimal(21,0)"))  # a true sum lies below 2^63
    pairs = pairs.select("lang", "source", "item", exact.cast("long").alias("value"))
    by_pair = pairs.withColumn("rank", F.row_number().over(per_group))
    return by_pair.withColumn("part", F.lit("pair")).unionByName(by_term.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op13_level_products", sql=f"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
    t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
    v AS (SELECT lang, count(*) AS terms, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.terms) AS p,
                 1 + ({SCALE}::HUGEINT * (k.n + 1)) // (v.total + v.terms) AS q
          FROM k JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    WHERE part = 'pair' OR rank <= 200""")
def op13_level_products(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of the sources of every language, by pair and by term."""
    return divergences(table(spark, folder, "documents"))
