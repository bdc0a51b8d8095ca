"""The near-duplicate stage links 5-word similarities of 0.8 or more, however far the fingerprints lie apart."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from parlance.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pair_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))})
    return out


def brute_heads(ids, texts):
    """Smallest id of each component of pairs at 0.8 or more."""
    sets, root = pair_sets(texts), {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(ids):
        for j in range(k):
            both = len(sets[k] & sets[j])
            if both >= 0.8 * (len(sets[k]) + len(sets[j]) - both):
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i)


def kept(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())


def test_documents(spark, data):
    docs = table(spark, data, "documents").select(corpus_pipeline.COLUMNS)
    rows = docs.orderBy("doc_id").collect()
    assert kept(spark, docs) == brute_heads([r.doc_id for r in rows], [r.text for r in rows])


def test_replaced_words(spark):
    draw = np.random.default_rng(8)
    rows, n = [], 0
    for size in (60, 100, 200, 500):
        for _ in range(10):
            words = [f"w{k}" for k in draw.integers(0, 5000, size)]
            rows.append((n, " ".join(words)))
            for changes in (1, size // 100, size // 20):  # the last ones fall below 0.8
                other = list(words)
                for p in draw.choice(size, changes, replace=False):
                    other[p] = "new"
                rows.append((n := n + 1, " ".join(other)))
            n += 1
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    want = brute_heads(*map(list, zip(*rows)))
    assert len(want) < len(rows) - 60 and kept(spark, docs) == want


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    from parlance.llm.near_copies import similar_documents

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, " \t\n"), (5, "A b  c d e f"), (None, "x y z"), (None, "x  y z"),
            (6, " ".join(f"w{k}" for k in range(40_000))), (7, " ".join(f"w{k}" for k in range(39_000))), (8, "solo text of some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.sha2(F.coalesce("text", F.lit("")), 256))
    for frame in (docs, docs.withColumns({c: F.lit("x") for c in ("node", "key", "a", "b", "low", "samples", "simhash", "root", "set")})):
        found = {r.own: r.component_id for r in similar_documents(frame).collect()}
        by_text = {r.text: found[r.own] for r in docs.collect()}
        assert len(found) == docs.select("own").distinct().count()
        assert by_text == {"a b c d e f": 1, None: 2, "": 2, " \t\n": 2, "A b  c d e f": 1, "x y z": None, "x  y z": None, rows[9][1]: 6, rows[10][1]: 6, rows[11][1]: 8}
    assert similar_documents(docs.where("false")).count() == 0


def test_a_common_passage_makes_few_candidates(spark):
    """Texts that quote one passage are no candidates of each other: the filter's keys grow with the copies only."""
    from pyspark.sql import functions as F

    from parlance.llm import near_copies

    draw = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(200))
    kinds = "doc_id long, own string, simhash long, node long, samples array<struct<overlap: double, keys: array<bigint>>>"

    def rows(n):
        out = []
        for i in range(n):
            hashes = near_copies.shingle_hashes(passage + " " + " ".join(f"w{k}" for k in draw.integers(0, 10 ** 9, 150)), 5)
            out.append((i, str(i), 0, i, [(o, k.view(np.int64).tolist()) for o, k in near_copies.samples(hashes, 0.8)]))
        return out

    assert near_copies._prefixes(spark.createDataFrame(rows(150), kinds)).where(F.col("key").isNotNull()).count() == 0


def test_recall_at_the_threshold(spark):
    """Long texts, whose filter is sampled: pairs between 0.8 and 0.85 are found."""
    draw = np.random.default_rng(6)
    rows, pairs = [], 0
    for n in range(150):
        words = [f"w{k}" for k in draw.integers(0, 10 ** 6, int(draw.integers(150, 1500)))]
        other = list(words)
        block = int(len(words) * 0.1 * draw.uniform(0.75, 1))  # one replaced block of about a tenth
        at = int(draw.integers(0, len(words) - block))
        other[at:at + block] = [f"v{k}" for k in draw.integers(0, 10 ** 6, block)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        a, b = pair_sets([rows[-2][1], rows[-1][1]])
        pairs += len(a & b) / len(a | b) >= 0.8
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert pairs > 100 and len(rows) - len(kept(spark, docs)) >= 0.99 * pairs


def test_edited_copies_of_one_text(spark, monkeypatch):
    """Copies with many edits meet in every bucket; only those that share edits are compared, and no link is lost."""
    from parlance.llm import near_copies

    draw = np.random.default_rng(11)
    words = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(words))]
    for n in range(1, 400):
        other = list(words)
        for p in draw.choice(150, int(draw.integers(1, 14)), replace=False):
            other[p] = f"e{n}x{p}" if draw.random() < 0.7 else ""
        if n % 5 == 0:  # a copy of a copy with a few more edits
            other = rows[-1][1].split()
            for p in draw.choice(len(other), 2, replace=False):
                other[p] = f"f{n}x{p}"
        rows.append((n, " ".join(other)))
    draw.shuffle(rows)
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    tried, beyond = [], near_copies._beyond_hubs
    monkeypatch.setattr(near_copies, "_beyond_hubs", lambda *given: tried.append(beyond(*given)) or tried[-1].cache())
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert kept(spark, docs) == brute_heads(*map(list, zip(*rows)))
    assert 0 < tried[0].count() < len(rows) * 10  # of 79,800 pairs
