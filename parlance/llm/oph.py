"""Document fingerprints by one-permutation MinHash, in column expressions only.

The shingles of a text are hashed once; the top bits of a hash name its bin and the smallest hash of each bin
stays.  An empty bin borrows from the filled bin that comes first in an order of all bins drawn for it (optimal
densification).  The low-order bits of all bins are packed into hexadecimal digits, and the share of equal
digits is corrected for chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import WORD, query, stored, table
from parlance.sizing import number_rows

BINS = 128  # a power of two
LOW_BITS = 4  # one hexadecimal digit
SHINGLE = 5
_SHIFT = 64 - (BINS.bit_length() - 1)


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, _SHIFT).cast("int")


def with_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds the fingerprint of a text column: BINS hexadecimal digits, or the empty string without words.

    Shingles are SHINGLE words; a text with fewer words is one shingle.  NULL counts as empty.  Equal texts have
    equal fingerprints; white space between words does not matter.  The intermediate arrays are columns of
    their own, so that no expression is evaluated twice; they begin with ``__``.
    """
    n = F.size("__w")
    windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(SHINGLE)]))
    single = F.when(n > 0, F.array(F.xxhash64(F.array_join("__w", " ")))).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("__w", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)))
    out = out.withColumn("__h", F.sort_array(F.when(n >= SHINGLE, windows).otherwise(single)))
    # In signed order the hashes of a bin are neighbours, the smallest first.
    first = F.filter("__h", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("__h", i - 1))))
    out = out.withColumn("__m", F.transform(first, lambda h: F.struct(_bin(h).alias("bin"), F.conv(h.bitwiseAND((1 << LOW_BITS) - 1).cast("string"), 10, 16).alias("low"))))

    def borrowed(j: Column) -> Column:
        ranked = F.transform("__m", lambda m: F.struct(F.hash(j * F.lit(BINS) + m["bin"]).alias("rank"), m["low"].alias("low")))
        return F.array_min(ranked)["low"]

    own = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(F.filter("__m", lambda m: m["bin"] == j), 0)["low"])
    out = out.withColumn("__own", own)
    digits = F.transform("__own", lambda low, j: F.coalesce(low, borrowed(j)))
    return out.withColumn(out_col, F.when(F.size("__m") > 0, F.lower(F.array_join(digits, ""))).otherwise(F.lit(""))).drop(
        "__w", "__h", "__m", "__own")


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance (0 to 1) of the texts of two fingerprints, corrected for digits that agree by chance.

    Two texts without words are alike (1); one without words is like no other (0).  NULL gives NULL.
    """
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(F.col(a), i, F.lit(1)) == F.substr(F.col(b), i, F.lit(1))))
    chance = 2.0**-LOW_BITS
    share = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(share)


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per different (id, hash of text): both keys of the rows before and after in descending id order, and
    the length of the row before.  Only ids, hashes and lengths are sorted.  After the last row comes the first."""
    keys = docs.groupBy("id", "hash").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    numbered = stored(number_rows(keys, [F.col("id").desc_nulls_last(), F.col("hash")], number_col="n"), "neighbours")
    total = numbered.count()
    before = numbered.select(F.pmod(F.col("n") + 1, F.lit(max(total, 1))).alias("n"), F.col("id").alias("before_id"),
                             F.col("hash").alias("before_hash"), F.col("n_chars").alias("before_chars"))
    after = numbered.select(F.pmod(F.col("n") - 1, F.lit(max(total, 1))).alias("n"), F.col("id").alias("after_id"), F.col("hash").alias("after_hash"))
    return stored(numbered.join(before, "n").join(after, "n").drop("n", "n_chars"), "neighbours")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likenesses.

    In the edited text the last half of the characters is replaced by as many first characters of the next
    document in descending id order.  NULL texts are empty.  NULL ids come last.  Rows with equal id are ordered by a
    hash of their text; rows that repeat id and text are one document in that order and get equal results.  An
    empty table gives an empty result.  The texts are shuffled once, by id and hash; of the next document only the
    characters that are used travel.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Both sides below read the same three columns, so their exchange of the texts is one and the same.
    base = base.withColumn("hash", F.xxhash64("text"))
    links = neighbours(base.select("id", "hash", F.char_length("text").cast("long").alias("n_chars")))
    same = F.col("base.id").eqNullSafe(F.col("links.id")) & (F.col("base.hash") == F.col("links.hash"))
    own = base.alias("base").join(links.alias("links"), same).select(
        "base.*", "copies", "before_id", "before_hash", "before_chars", "after_id", "after_hash")
    donors = own.select(
        F.col("before_id").alias("to_id"), F.col("before_hash").alias("to_hash"), "copies",
        F.left(F.col("text"), F.floor(F.col("before_chars") / 2).cast("int")).alias("prefix"))
    if not links.where("copies > 1").isEmpty():
        donors = donors.dropDuplicates(["to_id", "to_hash"])
    given = F.col("own.id").eqNullSafe(F.col("donors.to_id")) & (F.col("own.hash") == F.col("donors.to_hash"))
    n_chars = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = own.alias("own").join(donors.drop("copies").alias("donors"), given).select("own.*", "prefix").withColumn("n_chars", n_chars).withColumn(
        "edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.col("prefix")))
    marked = with_fingerprint(pairs, "text", "fingerprint").select(
        "id", "hash", "n_chars", "copies", "after_id", "after_hash", "edited", "fingerprint")
    marked = marked.withColumn("edited_sha256", F.sha2("edited", 256))
    marked = stored(with_fingerprint(marked, "edited", "edited_fingerprint").drop("edited"), "fingerprints")
    following = marked.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint"))
    following = following.dropDuplicates(["next_id", "next_hash"])
    met = F.col("after_id").eqNullSafe(F.col("next_id")) & (F.col("after_hash") == F.col("next_hash"))
    return marked.join(following, met).withColumns({
        "near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint"),
    }).select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and likenesses of all documents."""
    return edited_fingerprints(table(spark, folder, "documents"))
