"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Its result is written as Parquet and reread as the docs of the next stage.

1. language_id: documents whose language the nearest centroids reject go.  The model learns from all documents that
   the stage is given.
2. simhash_dedup: of each group of near-duplicates (5-word shingles with a similarity of 0.8 or more, linked directly or
   through others) the document with the smallest doc_id stays.  Golay keys of SimHashes and a prefix filter propose, whole
   sets of shingles decide.
3. suffix_dedup: passages of 50 bytes or more that an earlier document has are cut out; documents of which nothing
   is left go.
4. source_mix: documents are repeated or left out so that the sources come to their target weights.
5. packing: documents are packed into sequences of at most 1,024 tokens.

NULL texts have no language and go in the first stage.  NULL ids count as larger than any other.  Empty tables pass.
Columns besides doc_id, text, lang, source and n_chars are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import default_path
from parlance.llm.centroid_lang import fit, identify
from parlance.llm.common import prepare, stored, table
from parlance.llm.cost_packing import pack
from parlance.llm.entropy_mix import mix
from parlance.llm.near_copies import similar_documents
from parlance.llm.suffixes import cut_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    return identify(docs, fit(docs)).where(~F.col("rejected")).select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Rows that repeat id and text are one document.  Different texts under the id that a group begins with all stay, and so do
    different texts without an id if their group has none.
    """
    prepare(spark)
    docs = docs.select(COLUMNS)
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    groups = similar_documents(docs.select("doc_id", "text", own.alias("own")))
    marked = docs.select("doc_id", own.alias("own")).join(groups, "own")
    heads = stored(marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "own").count(), "near-heads")
    repeated = not heads.where("count > 1").isEmpty()
    heads = heads.select(F.col("doc_id").alias("head"), F.col("own").alias("head_own"))
    kept = docs.withColumn("own", own).join(
        heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("own") == F.col("head_own")), "left_semi")
    return (kept.dropDuplicates(["doc_id", "own"]) if repeated else kept).select(COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; drops texts that are used up."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    cut = cut_repeats(docs, with_text=True).where("n_removed > 0").select(
        F.col("doc_id").alias("cut_id"), F.col("hash").alias("cut_hash"), F.coalesce("kept_text", F.lit("")).alias("rest"))
    if not cut.groupBy("cut_id", "cut_hash").count().where("count > 1").isEmpty():
        cut = cut.dropDuplicates(["cut_id", "cut_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("cut_hash"))
    out = docs.join(cut, same, "left").where("rest is null or rest <> ''")
    text = F.coalesce("rest", "text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("rest").isNull(), F.col("n_chars")).otherwise(
        F.char_length("rest")).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes to its target."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    # Rows that repeat id and text are one document with a sum of copies.
    copies = mix(docs).groupBy("doc_id", "draw").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    repeated = not copies.where("rows > 1").isEmpty()
    copies = copies.where("copies > 0").select(F.col("doc_id").alias("mix_id"), "draw", "copies")
    rows = docs.withColumn("own", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = rows.dropDuplicates(["doc_id", "own"]) if repeated else rows
    same = F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("own") == F.col("draw"))
    return rows.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    prepare(spark)
    return pack(docs.select(COLUMNS), default_path())


STAGES = [
    ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix), ("packing", packing),
]

# Neither Unicode case folding in TF-IDF vectors, nor XXH64, nor byte-pair tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
