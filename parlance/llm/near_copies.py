"""Near-duplicate groups: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from two sides and are all verified on the whole sets:

* Golay keys of the SimHash of the shingles: fingerprints at two or fewer differing bits.
* A prefix filter, because a similarity of 0.8 mostly lies more than two bits apart.  Similar sets share most shingles, so in any
  common order they share one of their first few: with an overlap of t, one of the first n - ceil(t n) + 1 of n.  The order goes by
  document frequency, rarest first, so a passage that many texts quote gives no candidates among texts that
  also have enough words of their own; only texts made of little else meet on it.

Sets of up to 128 shingles are filtered whole, which is exact.  Of larger ones the filter sees the shingles whose hash ends in enough
zero bits to leave 64 to 128 of them, and asks for an overlap of 0.65 of the sample instead of 0.8 of the set; a text
near the bound of its level is sampled for the next level as well.  The overlap of two texts at 0.8 is 0.89 of equal sets and
never below 0.8, so a sample falls short by chance only in about one pair of ten thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, stored
from parlance.llm.golay import components, near_links

WHOLE = 128  # shingles that are filtered without sampling
SAMPLED_OVERLAP = 0.65


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Different 64-bit hashes of the shingles in ascending order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8").lower().split()  # as for the fingerprints of op7
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], np.uint64))


def simhash_of_set(hashes: np.ndarray) -> int:
    """Majority of each bit over a set of hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        total += np.unpackbits(hashes[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def samples(hashes: np.ndarray, threshold: float) -> list[tuple[float, np.ndarray]]:
    """(overlap, keys) of a set's own level, and of the next one if a similar set can belong to it.  Levels have different keys."""
    level = max(0, int(np.ceil(np.log2(len(hashes) / WHOLE))))
    levels = [level, level + 1] if len(hashes) > threshold * WHOLE * 2 ** level else [level]
    out = []
    for k in levels:
        own = hashes[hashes & np.uint64((1 << k) - 1) == 0]
        out.append((threshold if k == 0 else SAMPLED_OVERLAP, (own * np.uint64(2 * k + 1)) ^ np.uint64(k)))
    return out


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"])):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = both + 1e-9 >= threshold * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    first = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return stored(pairs.join(second, "b").join(first, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "near-links")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(node, key, centre) of the rarest shingles that a similar text has to share; only keys that two texts have.

    ``centre`` is the mean logarithm of the document frequencies of a text's shingles: edits make shingles that no other text
    has, so of a group of edited copies the original has the highest.
    """
    held = nodes.select("node", F.posexplode("samples").alias("which", "sample")).select(
        "node", "which", F.explode("sample.keys").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(common, "key").groupBy("node", "which").agg(
        F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ranked"))  # a sample is bounded
    ranked = stored(ranked.withColumn("total", F.aggregate("ranked", F.lit(0.0), lambda s, x: s + F.log(x["df"]))), "near-ranked")
    sizes = nodes.select("node", F.posexplode("samples").alias("which", "sample")).select(
        "node", "which", F.size("sample.keys").alias("n"), F.col("sample.overlap").alias("overlap"))
    # Shingles that no other text has are the rarest: they fill the prefix first.
    left = F.col("n") - F.ceil(F.col("overlap") * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("ranked"))
    chosen = ranked.join(sizes, ["node", "which"]).withColumn("left", left).where("left > 0").select(
        "node", F.explode(F.slice("ranked", F.lit(1), F.col("left"))).alias("first")).select("node", F.col("first.key").alias("key")).distinct()
    chosen = stored(chosen, "near-prefixes")
    centres = ranked.where("which = 0").join(sizes, ["node", "which"]).select("node", F.round(F.col("total") / F.col("n"), 6).alias("centre"))
    shared = chosen.join(chosen.groupBy("key").count().where("count > 1").select("key"), "key").join(centres, "node", "left")
    shared = stored(shared.select("node", "key", F.coalesce("centre", F.lit(0.0)).alias("centre")), "near-keys")
    discard(chosen)
    discard(ranked)
    return shared


def _beyond_hubs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different roots that may be similar, of ``members`` (hub, node, root) with the same hub.

    Let D be the symmetric difference of a text's set and its hub's set, and c = (1 - t) / (1 + t).  Sets x and y are similar if
    and only if their own symmetric difference, |Dx| + |Dy| - 2 |Dx and Dy|, is at most c (|x| + |y|).  So the overlap of Dx and Dy
    has a lower bound.  Where y is not similar to the hub it is more than (1 - c) / 2 of |Dx|; in any case it is at least
    |Dx| - |x| (1 - t) / t.  What all copies have from the hub is in no D, and edits that only one text has are in one D: the
    prefix filter over D, rarest first, leaves the pairs that share rare edits.  No pair above the threshold is lost.
    """
    c = (1 - threshold) / (1 + threshold)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, far, found = [], [], []
            for x, h in zip(batch["own_set"], batch["hub_set"]):
                x, h = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(h.as_buffer(), "<u8")
                diff = np.setxor1d(x, h, assume_unique=True)
                sizes.append(len(x))
                far.append(len(diff) > c * (len(x) + len(h)) + 1e-9)
                found.append(diff.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["hub"], batch["node"], batch["root"], pa.array(sizes, pa.int32()), pa.array(far), pa.array(found, pa.list_(pa.int64()))],
                names=["hub", "node", "root", "n", "far", "diff"])

    own, hub = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{s}_set")) for c, s in (("node", "own"), ("hub", "hub")))
    rows = members.where("hub <> node").distinct().join(own, "node").join(hub, "hub").select("hub", "node", "root", "own_set", "hub_set")
    rows = stored(rows.mapInArrow(differences, "hub long, node long, root long, n int, far boolean, diff array<bigint>"), "near-differences")
    held = rows.select("hub", "node", F.explode("diff").alias("key"))
    common = held.groupBy("hub", "key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(common, ["hub", "key"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ranked"))
    d, tiny = F.size("diff"), 1e-9
    least = F.greatest(F.lit(1), F.ceil(d - F.col("n") * ((1 - threshold) / threshold) - tiny).cast("int"))
    half = F.floor(d * ((1 - c) / 2) - tiny).cast("int") + 1
    # Ranks up to which a similar text shares something: one for partners far from the hub, one for partners near it.
    reach = rows.select("hub", "node", "root", "n", "far", d.alias("d"), (d - F.greatest(least, half) + 1).alias("to_far"),
                        F.when(F.col("far"), d - least + 1).otherwise(0).alias("to_near"))
    placed = reach.join(ranked, ["hub", "node"]).select("*", F.posexplode("ranked").alias("at", "first")).select(
        "hub", "node", "root", "n", "far", "d", "to_far", "to_near", F.col("first.key").alias("key"),
        (F.col("d") - F.size("ranked") + F.col("at") + 1).alias("rank")).where(F.col("rank") <= F.greatest("to_far", "to_near"))
    placed = stored(placed, "near-edits")
    a, b = placed.alias("a"), placed.alias("b")
    need = (F.col("a.d") + F.col("b.d") - c * (F.col("a.n") + F.col("b.n"))) / 2
    rest = F.least(F.col("a.d") - F.col("a.rank"), F.col("b.d") - F.col("b.rank")) + 1  # what can still be shared from here on
    within = F.when(F.col("b.far"), F.col("a.rank") <= F.col("a.to_far")).otherwise(F.col("a.rank") <= F.col("a.to_near")) & F.when(
        F.col("a.far"), F.col("b.rank") <= F.col("b.to_far")).otherwise(F.col("b.rank") <= F.col("b.to_near"))
    sizes = F.least("a.n", "b.n") + tiny >= threshold * F.greatest("a.n", "b.n")
    met = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (
        F.col("a.root") != F.col("b.root")) & within & sizes & (need <= rest + tiny)
    pairs = stored(a.join(b, met).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "near-pairs")
    discard(rows)
    discard(placed)
    return pairs


def similar_documents(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(own, component_id) for every different ``own`` of ``docs`` (doc_id, text, own), where own identifies the text.

    The component id is the smallest doc_id that links lead to.  Texts without words are alike.  NULL texts count as empty.  NULL ids
    lend no id; a component of NULL ids only has component id NULL.  Repeated rows change nothing; an empty table gives no rows.
    Other columns are ignored.

    Texts of a bucket are first compared with its most central text, which connects groups of copies with a row per text.  Buckets that
    are still in different components are then searched for pairs that share edits of that text, so that no link is missed.
    """
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, found = [], []
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(text, shingle)
                prints.append(simhash_of_set(hashes))
                found.append([{"overlap": o, "keys": k.view(np.int64)} for o, k in samples(hashes, threshold)])
            kind = pa.list_(pa.struct([("overlap", pa.float64()), ("keys", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["own"], pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(found, kind)],
                names=["doc_id", "own", "simhash", "samples"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, shingle).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], names=["node", "set"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "own")
    first = docs.groupBy("own").agg(F.min("doc_id").alias("low"))
    same = (F.col("docs.own") == F.col("first.own")) & F.col("doc_id").eqNullSafe(F.col("low"))
    sketched = docs.mapInArrow(
        sketch, "doc_id long, own string, simhash long, samples array<struct<overlap: double, keys: array<bigint>>>")
    sketched = sketched.alias("docs").join(first.alias("first"), same, "left_semi").dropDuplicates(["own"])
    # The numbers are fixed by writing them.
    nodes = stored(sketched.select(F.monotonically_increasing_id().alias("node"), "own", F.col("doc_id").alias("low"), "simhash", "samples"), "near-nodes")
    shared = _prefixes(nodes)
    plain = nodes.select("node", "simhash")
    prints = plain.groupBy("simhash").agg(F.min("node").alias("head"))
    stars = plain.join(prints, "simhash").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads_a, heads_b = (prints.select(F.col("simhash").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b"))
    golay = near_links(prints.select("simhash")).join(heads_a, "a").join(heads_b, "b").select(
        F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    golay = stored(stars.union(golay).distinct(), "near-golay")

    wanted = shared.select("node").union(golay.select("a")).union(golay.select("b")).distinct().join(nodes.select("node", "own", "low"), "node")
    same = (F.col("docs.own") == F.col("wanted.own")) & F.col("doc_id").eqNullSafe(F.col("low"))
    texts = docs.alias("docs").join(wanted.alias("wanted"), same).select("node", "text")
    sets = stored(texts.mapInArrow(hashes, "node long, set binary").dropDuplicates(["node"]), "near-sets")

    used = [golay, shared, sets]
    links, roots = None, nodes.select("node", F.col("node").alias("root"))
    for step in ("golay", "one", "hubs", "pairs"):
        placed = shared.join(roots, "node").select("key", "centre", "node", "root")
        hubs = placed.groupBy("key").agg(
            F.max(F.struct("centre", (-F.col("node")).alias("minus"), "node", "root")).alias("hub"),
            F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
        apart = placed.join(hubs.select("key", "hub"), "key")
        if step == "golay":
            tried = stored(golay, "near-pairs")
        elif step == "pairs":
            tried = _beyond_hubs(apart.select(F.col("hub.node").alias("hub"), "node", "root"), sets, threshold)
        else:
            others = apart.where("hub.root <> root").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub"))
            pairs = others.groupBy("b").agg(F.max("hub")["node"].alias("a")).select("a", "b") if step == "one" else others.select("a", "b").distinct()
            tried = stored(pairs, "near-pairs")
        found = _verified(tried, sets, threshold)
        links = found if links is None else links.union(found)
        joined = components(links)
        roots = stored(nodes.select(F.col("node").alias("own_node")).join(joined, F.col("own_node") == F.col("node"), "left").select(
            F.col("own_node").alias("node"), F.coalesce("root", "own_node").alias("root")), "near-roots")
        used += [tried, found, roots]
    named = nodes.select("own", "low", "node").join(roots, "node").select("own", "low", "root")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    out = stored(named.join(lowest, "root").select("own", "component_id"), "near-components")
    for table in [nodes, *used]:
        discard(table)
    return out
