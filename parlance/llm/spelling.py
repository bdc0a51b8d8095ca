"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary fills blocked Bloom filters, a shard of blocks for each word length.  Every word then generates its
neighbours and asks the shard of their length.  Of an insertion and a deletion only the deletion is generated, of two replacements
only the one with the greater letter: the other direction is the same pair.  Edits that the filter lets pass are shuffled
to an exact join with the vocabulary, which removes what passed by chance.

The filters are sent to the tasks in rounds of at most ``max_bytes``; a larger vocabulary takes more rounds and loses nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, stored, table

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
SPOILT = 199  # a run whose hash this number divides loses a letter
BITS_PER_WORD, HASHES, BLOCK_WORDS = 16, 6, 8  # a block is eight 64-bit words
MAX_BYTES = 32 << 20
MAX_RUNS = 400_000  # different words that a counting task holds
WORDS_AT_ONCE, PROBES = 1 << 14, 1 << 20

# Latin-1 has one byte per code point and holds every letter of a run; all else becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of (doc_id, text): partial counts per task."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(word) < MIN_LENGTH:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode("utf-8"), start)
                    if h % SPOILT == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                        if len(word) < MIN_LENGTH:
                            continue
                    seen[word] += n
            if len(seen) > MAX_RUNS:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    return docs.mapInArrow(run, "word string, n long")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit moves every output bit."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(positions: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A random number for every letter at every position; a word's hash is their sum."""
    return _mix((positions.astype(np.uint64) << np.uint64(8)) | letters.astype(np.uint64))


class Shards:
    """Where the blocks of each word length lie in one row of blocks, and how to address a bit."""

    def __init__(self, sizes: dict[int, int], max_bytes: int):
        self.first, self.blocks, at = {}, {}, 0
        for length, n in sorted(sizes.items()):
            self.first[length] = at
            self.blocks[length] = max(1, -(-n * BITS_PER_WORD // (64 * BLOCK_WORDS)))
            at += self.blocks[length]
        self.total, self.per_round = at, max(1, max_bytes // (8 * BLOCK_WORDS))
        self.rounds = -(-at // self.per_round)

    def address(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, bits): the bits are ``HASHES`` numbers of nine bits each."""
        h = _mix(hashes)
        return (h % np.uint64(self.blocks[length])).astype(np.int64) + self.first[length], _mix(h)

    def passed(self, hashes: np.ndarray, length: int, filled: np.ndarray, start: int) -> np.ndarray:
        """Indices of the hashes that the blocks from ``start`` on may hold."""
        if length not in self.first or not len(hashes):
            return np.zeros(0, np.int64)
        left = np.arange(len(hashes))
        block, bits = self.address(hashes, length)
        block -= start
        inside = (block >= 0) & (block < len(filled))
        if not inside.all():
            left, block, bits = left[inside], block[inside], bits[inside]
        for k in range(HASHES):
            bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
            word = filled[block, (bit >> np.uint64(6)).astype(np.int64)]
            hit = (word >> (bit & np.uint64(63))) & np.uint64(1) != 0
            left, block, bits = left[hit], block[hit], bits[hit]
        return left


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions of the words, matrix of letters)."""
    coded = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in coded])
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        yield length, own, np.frombuffer(b"".join(coded[k] for k in own), np.uint8).reshape(len(own), length)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for batch in batches:
        more = batch["word"].to_pylist()
        held += more
        size += sum(map(len, more))
        if len(held) >= WORDS_AT_ONCE or size > PROBES:
            yield held
            held, size = [], 0
    if held:
        yield held


def filter_blocks(words: DataFrame, shards: Shards) -> DataFrame:
    """block, m0 ... m7 of every block that holds a word; a word's bits combine before the shuffle."""
    names = [f"m{k}" for k in range(BLOCK_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            for length, own, letters in _by_length(held):
                block, bits = shards.address(_places(np.arange(length)[None, :], letters).sum(axis=1, dtype=np.uint64), length)
                masks = np.zeros((len(own), BLOCK_WORDS), np.uint64)
                for k in range(HASHES):
                    bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
                    masks[np.arange(len(own)), (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(masks[:, k].view(np.int64)) for k in range(BLOCK_WORDS))],
                                                 names=["block", *names])

    made = words.select("word").mapInArrow(run, "block long, " + ", ".join(f"{n} long" for n in names))
    return made.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def edits(letters: np.ndarray, alphabet: np.ndarray, test) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row, edited word) for the deletions and the replacements by greater letters that pass ``test(hashes, length)``."""
    count, length = letters.shape
    places = _places(np.arange(length)[None, :], letters)
    moved = _places(np.arange(-1, length - 1)[None, :], letters)  # after a deletion before them
    before = np.cumsum(places, axis=1, dtype=np.uint64) - places
    after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    last_of_run = np.ones(letters.shape, bool)
    last_of_run[:, :-1] = letters[:, :-1] != letters[:, 1:]  # equal letters in a row give one result
    row, at = np.nonzero(last_of_run)
    good = test((before + after)[row, at], length - 1)
    row, at = row[good], at[good]
    yield row, [(w := letters[r].tobytes())[:k] + w[k + 1:] for r, k in zip(row.tolist(), at.tolist())]

    whole = places.sum(axis=1, dtype=np.uint64)
    step = max(1, PROBES // (max(count, 1) * max(len(alphabet), 1)))
    for start in range(0, length, step):
        here = slice(start, min(start + step, length))
        table = _places(np.arange(here.start, here.stop)[:, None], alphabet[None, :])
        row, at, letter = np.nonzero(alphabet[None, None, :] > letters[:, here, None])
        good = test(whole[row] - places[row, at + start] + table[at, letter], length)
        row, at, letter = row[good], at[good] + start, letter[good]
        yield row, [(w := letters[r].tobytes())[:k] + bytes([c]) + w[k + 1:] for r, k, c in zip(row.tolist(), at.tolist(), alphabet[letter].tolist())]


def near_pairs(words: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """a, n_a, b, n_b: every two words of (word, n) at one edit, once."""
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).toLocalIterator()}
    shards = Shards(sizes, max_bytes)
    # At most 90 letters exist.
    found = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in found), np.uint8)
    blocks = stored(filter_blocks(words, shards), "spelling-filters")

    def positives(round_: int) -> DataFrame:
        start = round_ * shards.per_round
        part = blocks.where(F.col("block").between(start, start + shards.per_round - 1)).toArrow()
        filled = np.zeros((min(shards.per_round, shards.total - start), BLOCK_WORDS), np.uint64)
        filled[part["block"].to_numpy() - start] = np.stack([part[f"m{k}"].to_numpy().view(np.uint64) for k in range(BLOCK_WORDS)], 1)
        sent = spark.sparkContext.broadcast(filled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = lambda hashes, length: shards.passed(hashes, length, sent.value, start)
            for held in _gathered(batches):
                for length, own, letters in _by_length(held):
                    step = max(1, PROBES // length)
                    for k in range(0, len(own), step):
                        for row, made in edits(letters[k:k + step], alphabet, test):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([held[p] for p in own[k + row].tolist()], pa.string()), pa.array([w.decode("latin-1") for w in made], pa.string())],
                                names=["a", "b"])

        return words.select("word").mapInArrow(run, "a string, b string")

    made = None
    for k in range(shards.rounds):
        made = positives(k) if made is None else made.union(positives(k))
    if made is None:
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))  # no words
    exact = made.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    return exact.join(words.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").select("a", "n_a", "b", "n_b")


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the last word that forms lead to.  Counts grow fivefold with each form, so chains are
    short and free of cycles; every round halves what is left of them."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "spelling-roots")
        open_ = not moved.where("moved").isEmpty()
        roots = moved.drop("moved")
        if not open_:
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least ``min_count`` occurrences.

    NULL texts have no words.  A NULL id reads as an empty string where a run is hashed.  Repeated rows count again.  Ties of
    the largest count go to the smallest word in code-point order.  Empty tables give no rows.  Other columns are ignored.
    Counts are summed in the tasks before the shuffle, so a word of a third of all rows costs a row per task.
    """
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    words = stored(count_words(texts).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "spelling-words")
    pairs = near_pairs(words, max_bytes)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    around = pairs.select(F.inline(ends)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    top = -F.col("best.minus_n")
    good = top >= RATIO * F.col("n")
    named = stored(words.join(around, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, top).alias("form_n")),
        "spelling-forms")
    roots = roots_of(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of the documents with its near words, form and root."""
    return spelling_variants(table(spark, folder, "documents"))
