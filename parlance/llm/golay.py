"""SimHash near-duplicate groups found with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last with 5 zero bits ahead).  The
perfect Golay code puts every 23-bit word within three bits of exactly one codeword.  A word and its
neighbours at one bit lie near at most six codewords, and two words that differ in at most two bits share one
of them: they have a common neighbour.  Of two errors, pigeonhole leaves at least one of three segments
without any, so a key is one exact segment with the codeword index of the next segment (35 bits or more).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, stored, table

# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, width)
SMALL_BUCKET = 32


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """For every syndrome the one error pattern of at most three bits."""
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), bits]
    pair = np.triu_indices(23, 1)
    errors.append(bits[pair[0]] | bits[pair[1]])
    triple = np.array([(a, b, c) for a in range(23) for b in range(a) for c in range(b)])
    errors.append(bits[triple[:, 0]] | bits[triple[:, 1]] | bits[triple[:, 2]])
    every = np.concatenate(errors)
    out = np.full(1 << 11, -1, np.int64)
    out[syndromes(every)] = every
    return out


_patterns: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords that decode a word and its 23 one-bit neighbours; one row of 24 each."""
    if not _patterns:
        _patterns.append(error_patterns())
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)[None, :]
    return (near ^ _patterns[0][syndromes(near)]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every different key of the fingerprints: at most 18 each."""
    rows, keys = [], []
    parts = [((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    for exact in range(3):
        found = np.sort(codeword_indices(parts[(exact + 1) % 3]), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        row, column = np.nonzero(fresh)
        rows.append(row)
        keys.append((exact << 40) | (parts[exact][row] << 12) | found[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def simhash_of(text: str | None) -> int:
    """Fingerprint of the 3-word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-3]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist())]
    total, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(np.array(hashes[k:k + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def add_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Keeps all columns and adds ``simhash`` (the 64 bits as a signed long)."""
    fields = [f for f in docs.schema.fields if f.name != "simhash"]
    names = [f.name for f in fields]
    schema = docs.select(*[f"`{n}`" for n in names]).withColumn("simhash", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash_of(t) for t in batch[text_col].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(prints)], names=[*names, "simhash"])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch["simhash"].to_numpy()
        for k in range(0, len(prints), 1 << 13):
            part = prints[k:k + (1 << 13)]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], names=["simhash", "key"])


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect all different fingerprints at two or fewer differing bits.

    Fingerprints that share a key meet in a bucket.  A small bucket is joined with itself and verified.  In a
    large one, members that share a one-bit neighbour (which means two or fewer bits) are linked to the smallest of
    them; this gives a row per member and bit instead of a row per pair, and loses no connection.
    """
    keyed = stored(prints.mapInArrow(_with_keys, "simhash long, key long"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "golay-shared")
    small = shared.where(F.col("n") <= SMALL_BUCKET).select("key", "simhash")
    a, b = small.select("key", F.col("simhash").alias("a")), small.select("key", F.col("simhash").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    around = shared.where(F.col("n") > SMALL_BUCKET).select("simhash").distinct().select(
        "simhash", F.explode(flips).alias("flip")).select("simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("near"))
    hubs = around.groupBy("near").agg(F.min("simhash").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
    stars = around.join(hubs, "near").where(F.col("a") < F.col("simhash")).select("a", F.col("simhash").alias("b"))
    return pairs.union(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node; the root is the smallest node of its component.

    Alternates large-star and small-star steps over the links until nothing changes.  A hub's links are
    reduced to its smallest neighbour by aggregation and joined back, so no list of neighbours is ever built.
    """
    links = stored(links.select("a", "b").where("a <> b"), "links")
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        large = stored(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
        small = down.join(low, F.col("a") == F.col("node")).select("low", "b").where("low <> b").union(
            low.select("low", F.col("node").alias("b"))).toDF("a", "b").distinct()
        small = stored(small, "links")
        # Done when every node hangs on one root and no root hangs on another node.
        roots = small.groupBy("b").agg(F.count("*").alias("n"))
        open_ = roots.where("n > 1").select("b").union(small.select(F.col("a").alias("b")).join(roots.select("b"), "b", "left_semi").select("b"))
        links = small
        if open_.isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``simhash``, ``fingerprint`` and ``component_id`` to every row.

    Fingerprints at two or fewer differing bits are linked; the component id is the smallest ``id_col``
    reachable, the row's own included.  ``keep_text=False`` leaves out the text column.  NULL texts and texts without words have fingerprint zero and are
    linked like any other.  A NULL id is kept and belongs to its fingerprint's component, and does not lend its id; a component of
    NULL ids only has component id NULL.  Repeated rows get equal results.  Added columns replace columns of
    the same name.
    """
    marked = add_fingerprint(docs, text_col).drop("component_id")
    marked = stored(marked if keep_text else marked.drop(text_col), "simhash")
    groups = stored(marked.groupBy("simhash").agg(F.min(id_col).alias("low")), "simhash-groups")
    linked = components(near_links(groups.select("simhash")))
    named = groups.join(linked, F.col("simhash") == F.col("node"), "left").select(
        "simhash", "low", F.coalesce("root", "simhash").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "root").select("simhash", "component_id")
    return marked.join(found, "simhash", "left").withColumn("fingerprint", F.lower(F.lpad(F.hex("simhash"), 16, "0")))


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, keep_text=False).select("doc_id", "fingerprint", "component_id")
