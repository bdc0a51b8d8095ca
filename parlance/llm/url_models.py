"""URL verdicts: rules first, and for the rest the ratio of two character language models.

The URLs that rules accept and those that rules reject train one variable-order Markov model each: counts of every byte
after every context of up to four bytes, smoothed from order to order (Witten and Bell: a context with t
different successors leaves t of n + t parts to the next shorter context; below the empty one all bytes and the end are
alike).  A URL's score is the difference of its two log-likelihoods, divided by its length with the end.  A quarter of the ruled
URLs is kept out of the counts; their scores set the threshold, as many standard deviations below the mean of the accepted
as above that of the rejected.

Counts cover all ruled URLs and are never sent whole: URLs are cut into groups of bounded size, and every group
gets exactly those counts that its own URLs ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, stored, table
from parlance.sizing import small_side

ORDER = 4
SYMBOLS = 257  # bytes and the end
START, END = 1, 0  # bytes that a URL cannot hold
GROUP_BYTES = 1 << 20
MAX_KEYS = 1 << 20

# The rules of the query, as host, path and verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash; A-Z lower-cased; empty without ``://`` and for NULL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL if none does.  A list of rules is an argument of the caller and small."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, word in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, keys) of every byte of the texts and their ends.

    Row k of the keys is the byte with its k previous ones, packed into a number below a leading one, so that lengths differ; the last
    row's key without its last byte is the context.
    """
    coded = [bytes([START]) * ORDER + t.encode("utf-8") + bytes([END]) for t in texts]
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    lengths = np.array([len(c) for c in coded], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    real = np.flatnonzero(place >= ORDER)
    keys = np.empty((ORDER + 1, len(real)), np.int64)
    packed = np.zeros(len(real), np.int64)
    for k in range(ORDER + 1):
        packed = packed | (flat[real - k] << (8 * k))
        keys[k] = packed | (1 << (8 * (k + 1)))
    return owner[real], keys


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts, starts, axis=0) if len(starts) else counts


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of (text, n, label): (key, a, b) for every gram, and (key, a, b, ta, tb) for every context, where a and b are of allowed
    and blocked texts and ta, tb their different successors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
        for batch in batches:
            weight = np.zeros((batch.num_rows, 2), np.int64)
            weight[np.arange(batch.num_rows), [int(x == "block") for x in batch["label"].to_pylist()]] = batch["n"].to_numpy()
            owner, keys = grams(batch["text"].to_pylist())
            held = _summed(np.concatenate([held[0], keys.ravel()]), np.concatenate([held[1], np.tile(weight[owner], (ORDER + 1, 1))]))
            if len(held[0]) > MAX_KEYS:
                yield rows(held)
                held = (held[0][:0], held[1][:0])
        yield rows(held)

    def rows(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1][:, 0]), pa.array(held[1][:, 1])], names=["key", "a", "b"])

    counted = texts.select("text", "n", "label").mapInArrow(run, "key long, a long, b long")
    of_gram = stored(counted.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-grams")
    of_context = of_gram.groupBy(F.shiftright("key", 8).alias("key")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
    return of_gram, stored(of_context, "url-contexts")


def _found(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The rows of ``values`` for the wanted keys; zeros for those that are not there.  ``keys`` is ascending."""
    if not len(keys):
        return np.zeros((*wanted.shape, values.shape[1]), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[..., None], values[at], 0)


def likelihood_ratios(texts: list[str], of_gram: tuple[np.ndarray, np.ndarray], of_context: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean difference of the log-probabilities per byte, accepted minus rejected."""
    owner, keys = grams(texts)
    p = np.full((2, len(owner)), 1 / SYMBOLS)
    for k in range(ORDER + 1):
        counts, around = _found(of_gram[0], keys[k], of_gram[1]), _found(of_context[0], keys[k] >> 8, of_context[1])
        for side in (0, 1):
            n, t = around[:, side], around[:, 2 + side]
            p[side] = np.where(n > 0, (counts[:, side] + t * p[side]) / np.maximum(n + t, 1), p[side])
    return np.bincount(owner, np.log(p[0]) - np.log(p[1]), minlength=len(texts)) / np.bincount(owner, minlength=len(texts))


def score(texts: DataFrame, of_gram: DataFrame, of_context: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """text, score of different texts: each group of them meets the counts it asks for."""
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    placed = texts.select("text", F.pmod(F.xxhash64("text"), F.lit(max(1, -(-size // group_bytes)))).cast("int").alias("group"))

    def asked(part: pa.Table) -> pa.Table:
        _, keys = grams(part["text"].to_pylist())
        gram = np.unique(keys)
        context = np.unique(gram >> 8)
        return pa.table({"group": pa.array(np.full(len(gram) + len(context), part["group"][0].as_py(), np.int32)),
                         "key": pa.array(np.concatenate([gram, context])), "context": pa.array(np.arange(len(gram) + len(context)) >= len(gram))})

    zero = F.lit(0).cast("long")
    model = of_gram.select("key", F.lit(False).alias("context"), "a", "b", zero.alias("ta"), zero.alias("tb")).union(
        of_context.select("key", F.lit(True), "a", "b", "ta", "tb"))
    wanted = placed.groupBy("group").applyInArrow(asked, "group int, key long, context boolean").join(model, ["key", "context"])

    def judge(part: pa.Table, counts: pa.Table) -> pa.Table:
        texts = part["text"].to_pylist()
        if not texts:
            return pa.table({"text": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        context, sides = counts["context"].to_numpy(zero_copy_only=False), np.stack([counts[c].to_numpy() for c in ("a", "b", "ta", "tb")], 1)
        key = counts["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        models = [(key[order][which], sides[order][which]) for which in (~context[order], context[order])]
        return pa.table({"text": pa.array(texts, pa.string()), "score": pa.array(np.round(likelihood_ratios(texts, *models), 9) + 0.0)})

    return placed.groupBy("group").cogroup(wanted.groupBy("group")).applyInArrow(judge, "text string, score double")


def threshold(scored: DataFrame) -> float:
    """Between the means of the held-out accepted and rejected URLs (score, n, label), at the same number of standard deviations."""
    mean = F.sum(F.col("score") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("score") * F.col("score") * F.col("n")) / F.sum("n")
    found = {r["label"]: r for r in scored.groupBy("label").agg(mean.alias("mean"), square.alias("square")).collect()}
    if len(found) < 2:
        return 0.0
    allow, block = ((found[k]["mean"], max(found[k]["square"] - found[k]["mean"] ** 2, 0.0) ** 0.5) for k in ("allow", "block"))
    wide = allow[1] + block[1]
    middle = (allow[0] * block[1] + block[0] * allow[1]) / wide if wide > 0 else (allow[0] + block[0]) / 2
    return round(middle, 6)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Keeps all columns and adds host, path, rule, verdict and score (NULL where a rule decides); they replace columns of these names.

    The models read host and path.  NULL and malformed URLs have empty ones and are scored like any other.  Repeated URLs count as often as
    they occur and get one verdict.  A score at the threshold is accepted.  Without accepted or without rejected URLs to learn
    from the threshold is 0; with neither every score is 0, so all are accepted.  Empty tables pass.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"),
                        path_of(F.col(f"`{url_col}`")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("row", "host", "path", rule.alias("rule"), verdict.alias("label"), F.concat("host", "path").alias("text"))
    texts = stored(rows.groupBy("text", "host", "label").agg(F.count("*").alias("n")).groupBy("text").agg(
        F.sum("n").alias("n"), F.first("label").alias("label")), "url-texts")
    held = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4)) == 2
    counts = train(texts.where(F.col("label").isNotNull() & ~held))
    scored = stored(score(texts.where(F.col("label").isNull() | held).select("text"), *counts, group_bytes).join(texts, "text"), "url-scores")
    bound = threshold(scored.where("label is not null"))
    found = small_side(scored.where("label is null").select("text", F.col("score").alias("found")))
    decided = rows.join(found, "text", "left")
    learned = F.when(F.col("found") >= bound, "allow").otherwise("block")
    return decided.select("row.*", "host", "path", "rule", F.coalesce("label", learned).alias("verdict"), F.col("found").alias("score"))


@query("op12_url_models")
def op12_url_models(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's URL."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
