"""Token totals by source, language and tokenizer version, maintained by signed changes.

The state is two append-only tables in shared storage, one folder per batch: the ledger holds the signed
count of every changed document, the deltas hold its sums per key.  Totals are the sum of all deltas.  A batch
counts once its delta folder is complete, so repeating a commit changes nothing, and a commit that was cut
short is simply written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import default_path, encoder
from parlance.llm.common import query, table
from parlance.session import run_dir

LEDGER = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
KEYS = ["source", "lang", "tokenizer_version"]


def count_tokens(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Ledger rows (n_docs 1) for rows with doc_id, text, source and lang; NULL texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            counts = [len(encode(t)) // 4 if t else 0 for t in batch["text"].to_pylist()]
            one = pa.array([1] * len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], batch["lang"], pa.array([version] * len(counts), pa.string()), one,
                 pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "tokenizer_version", "n_docs", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").mapInArrow(run, LEDGER)


class TokenRollup:
    """Totals that batches of upserts and deletes keep up to date.

    A batch of ``upserts`` (doc_id, text, source, lang) inserts new documents and revises known ones: their
    earlier signed counts are taken back.  ``deletes`` (doc_id) take them back only.  Rows of one batch that
    repeat a doc_id all count, and are replaced together later.  Rows with a NULL doc_id count, and can be
    neither revised nor deleted.  NULL source and lang are keys of their own.  A deletion of an unknown document
    changes nothing.  Other columns are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str, version: str):
        self.spark, self.folder, self.tokenizer, self.version = spark, folder.rstrip("/"), tokenizer, version

    def committed(self) -> list[str]:
        """Ids of the batches that are complete, found by the marker that Spark writes last."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().getParent().getName() for f in found or [])

    def _read(self, kind: str, schema: str) -> DataFrame | None:
        paths = [f"{self.folder}/{kind}/{batch}" for batch in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch once; False if it had been applied before."""
        if batch in self.committed():
            return False
        ledger = self._read("ledger", LEDGER)
        fresh = None if upserts is None else count_tokens(upserts, self.tokenizer, self.version)
        changed = [df.select(F.col("doc_id").cast("long").alias("doc_id")) for df in (upserts, deletes) if df is not None]
        entries = fresh
        if ledger is not None and changed:
            ids = changed[0] if len(changed) == 1 else changed[0].union(changed[1])
            known = ledger.join(ids.distinct(), "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(
                F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            back = known.where("n_docs <> 0 or n_tokens <> 0").select(
                "doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
            entries = back if entries is None else entries.unionByName(back)
        if entries is None:
            entries = self.spark.createDataFrame([], LEDGER)
        path = f"{self.folder}/ledger/{batch}"
        entries.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(LEDGER).parquet(path)
        sums = written.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; keys that are used up do not appear."""
        deltas = self._read("deltas", DELTAS)
        if deltas is None:
            return self.spark.createDataFrame([], DELTAS)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
            "n_docs <> 0 or n_tokens <> 0")


def without_repeated_lines(text: str = "text") -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four commits: all documents; exact copies deleted; repeated lines revised; the copies again."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    rollup = TokenRollup(spark, run_dir(spark, "token-counts"), default_path(), "byte_bpe_50k")
    rollup.commit("load", docs)
    hashed = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    copies = hashed.join(first, ["hash", "doc_id"], "left_anti").select("doc_id")
    rollup.commit("copies", deletes=copies)
    lines = F.split("text", "\n")
    revised = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).join(copies, "doc_id", "left_anti").withColumn(
        "text", without_repeated_lines())
    rollup.commit("lines", revised)
    rollup.commit("copies", deletes=copies)
    return rollup.totals()
