"""The registered queries against plain Python on the smallest table."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from parlance.llm import golay, suffixes
from parlance.llm.bpe import default_path, encoder
from parlance.llm.common import ORACLES, QUERIES
from parlance.llm.hash_tree import assign_shards, topology

sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))
import check  # noqa: E402

sys.path.insert(0, str(Path(__file__).parent))
from test_near_copies import brute_heads  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(data):
    return duckdb.sql(f"SELECT * FROM '{data}/documents.parquet' ORDER BY doc_id").df()


def rows(spark, data, name):
    return QUERIES[name](spark, data).toPandas()


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, name):
    con = check.connect(data)
    got = QUERIES[name](spark, data)
    left = check.rows_of(got.columns, got.collect())
    found = con.execute(ORACLES[name])
    assert left == check.rows_of([c[0] for c in found.description], found.fetchall())


def brute_cut(texts, ids):
    first = {}
    for i, b in zip(ids, texts):
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    out = []
    for i, b in zip(ids, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        before = np.concatenate([[False], gone[:-1]]) if len(b) else gone
        out.append((i, len(b), int(gone.sum()), int((gone & ~before).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(spark, data, docs, monkeypatch):
    want = brute_cut([t.encode() for t in docs.text], docs.doc_id.tolist())
    for size in (suffixes.PART_BYTES, 20_000):  # one part, and many
        monkeypatch.setattr(suffixes, "PART_BYTES", size)
        got = rows(spark, data, "op3_suffix_dedup").sort_values("doc_id")
        assert [tuple(r) for r in got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].values.tolist()] == [tuple(w) for w in want]


def test_suffix_order():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 5, 6, 7, 50, 301, 1000):
        for letters in (1, 2, 3, 300):
            text = draw.integers(1, letters + 1, n)
            place = suffixes.suffix_places(text)
            order = sorted(range(n), key=lambda p: text[p:].tolist())
            assert np.argsort(place).tolist() == order


def test_hot_anchors_are_dealt_string_by_string():
    draw = np.random.default_rng(1)
    common = bytes(draw.integers(97, 123, 120, np.uint8))
    texts = [bytes(draw.integers(97, 123, 40, np.uint8)) + common + bytes(draw.integers(97, 123, 40, np.uint8)) for _ in range(6)]
    strings = suffixes.Strings(texts)
    hashes, counts = strings.anchor_counts(np.arange(6))
    again = hashes[counts % 2 == 1]
    for hot in (again[:0], again, again[:1]):
        lo, count, where = strings.runs(again, hot)
        length = count + 49
        body = np.concatenate([strings.data[a:a + n] for a, n in zip(lo, length)])
        ids = strings.doc[lo]
        masks = np.zeros(len(lo), np.int64)
        for w in set(where.tolist()):
            take = np.flatnonzero(where == w)
            begin = np.cumsum(length) - length
            rows_ = suffixes._padded(np.concatenate([body[begin[k]:begin[k] + length[k]] for k in take]), length[take])
            masks[take] = suffixes.earlier_strings(rows_, length[take], ids[take])
        found = {int(a) + bit for a, m in zip(lo, masks) for bit in range(35) if m >> bit & 1}
        first = {}
        for d, t in enumerate(texts):
            for p in range(len(t) - 49):
                first.setdefault(t[p:p + 50], d)
        want = {int(strings.starts[d]) + p for d, t in enumerate(texts) for p in range(len(t) - 49) if first[t[p:p + 50]] < d}
        assert found == want


def test_language(spark, data, docs):
    got = rows(spark, data, "op5_language_id").merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    assert len(got) == len(docs)
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.97
    assert got.rejected.mean() < 0.01


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def test_fingerprints(spark, data, docs):
    texts = docs.text.tolist()[::-1]
    edited = [a[:len(a) - len(a) // 2] + b[:len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
    got = rows(spark, data, "op6_fingerprints").sort_values("doc_id", ascending=False)
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    true = np.array([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts, edited)])
    assert np.abs(true - got.near_edited).mean() < 0.05 and abs(true.mean() - got.near_edited.mean()) < 0.02
    same = docs.assign(f=got.sort_values("doc_id").fingerprint.values).groupby("text").f.nunique()
    assert same.max() == 1


def brute_simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, data, docs):
    got = rows(spark, data, "op7_simhash_dedup").set_index("doc_id")
    prints = {i: brute_simhash(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {i: int(f, 16) for i, f in got.fingerprint.items()} == prints
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got.component_id.to_dict() == {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [golay.SMALL_BUCKET, 1])
def test_links_of_crowded_fingerprints(spark, bucket, monkeypatch):
    monkeypatch.setattr(golay, "SMALL_BUCKET", bucket)  # 1: every shared bucket goes by common neighbours
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, 8, np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in draw.integers(0, 64, k)) for c in centres for k in (0, 1, 2, 3, 4, 5) for _ in range(12)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    links = golay.near_links(spark.createDataFrame([(s,) for s in signed], "simhash long"))
    got = {r.node: r.root for r in golay.components(links).collect()}
    root = {s: s for s in signed}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {s: got.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_golay_keys_meet_at_two_bits():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << draw.integers(0, 23, len(words))
        a, b = golay.codeword_indices(words), golay.codeword_indices(other)
        assert all(set(x) & set(y) for x, y in zip(a, b)) and max(len(set(x)) for x in a) <= 6


def targets_of(sizes):
    names = sorted(sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and out[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return out
        full |= more


def test_mix(spark, data, docs):
    got = rows(spark, data, "op8_entropy_mix").merge(docs[["doc_id", "text", "source"]], on="doc_id")
    assert got["size"].tolist() == [len(WORD.findall(t)) for t in got.text]
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = targets_of(by["size"].to_dict())
    assert by.target.to_dict() == pytest.approx(want)
    assert ((by.taken - by.target).abs() <= 0.05 * by.target + 5).all()
    again = rows(spark, data, "op8_entropy_mix").sort_values("doc_id")
    assert again.taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_targets_with_capped_sources(spark):
    from parlance.llm.entropy_mix import source_targets

    sizes = {"a": 1000, "b": 3, "c": 5, "d": 40, "e": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in source_targets(frame).collect()} == pytest.approx(targets_of(sizes))


def test_sharding(spark, data, docs):
    got = rows(spark, data, "op9_sharding").merge(docs[["doc_id", "text"]], on="doc_id")
    assert [zlib.crc32(t.encode()) for t in got.text] == got.text_crc32.tolist()
    assert [len(t.encode()) + 1 for t in got.text] == got["size"].tolist()
    moved = got[got["shard"] != got.grown_shard]
    assert len(moved) and set(moved.grown_shard) == {8}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_only_the_changed_subtree_moves(spark):
    keys = spark.range(4000).select("id").withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' as text")
    heavier = [leaf.__class__(leaf.region, leaf.rack, leaf.shard, 3.0 if leaf.shard == 5 else 1.0) for leaf in topology(8)]
    out = assign_shards(keys, topology(8), heavier).toPandas()
    moved = out[out["shard"] != out.grown_shard]
    assert len(moved)
    # Shards 4 and 5 are one rack of the second region: whatever moves ends inside that region.
    assert set(moved.grown_shard) <= {4, 5, 6, 7}
    share = out.grown_shard.value_counts(normalize=True)
    assert share[5] == pytest.approx(0.3, abs=0.05)


def test_packing(spark, data, docs):
    got = rows(spark, data, "op10_packing")
    bpe = Tokenizer.from_file(default_path())
    for d, text in zip(docs.doc_id, docs.text):
        ids = np.array(bpe.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in got[got.doc_id == d].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 1024)


def test_bpe_equals_the_library(docs):
    bpe, own = Tokenizer.from_file(default_path()), encoder(default_path())
    odd = ["  a  b ", "a\n \nb  \n c", "x<|endoftext|>y <|endoftext|>", "don't  we'll", "", "\n\n a\t b", " ", "a b  c", "é日本 $$ 3.4"]
    for text in [*odd, *docs.text.tolist()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == bpe.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, data, docs):
    bpe = Tokenizer.from_file(default_path())
    left = docs.drop_duplicates("text").copy()
    left["n"] = [len(bpe.encode("\n".join(dict.fromkeys(t.split("\n"))), add_special_tokens=False).ids) for t in left.text]
    want = left.groupby(["source", "lang"]).n.agg(["size", "sum"])
    got = rows(spark, data, "op1_token_counts").set_index(["source", "lang"])
    assert len(got) == len(want)
    assert got.n_docs.to_dict() == want["size"].to_dict() and got.n_tokens.to_dict() == want["sum"].to_dict()


def test_pipeline(spark, data, docs):
    from parlance.llm.common import prepare, stored, table

    prepare(spark)
    now, seen = table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, data), "test-stage")
        seen[name] = now.toPandas()
    assert len(seen["language_id"]) >= 0.99 * len(docs)
    left = seen["language_id"].sort_values("doc_id")
    assert sorted(seen["simhash_dedup"].doc_id) == brute_heads(left.doc_id.tolist(), left.text.tolist())
    left = seen["simhash_dedup"].sort_values("doc_id")
    cut = {i: n for i, _, n, _, _ in brute_cut([t.encode() for t in left.text], left.doc_id.tolist())}
    after = seen["suffix_dedup"].set_index("doc_id")
    for i, text in zip(left.doc_id, left.text):
        rest = len(text.encode()) - cut[i]
        assert (i in after.index) == (rest > 0)
        if rest:
            assert len(after.text[i].encode()) == pytest.approx(rest, abs=6)
    mixed = seen["source_mix"].groupby("doc_id").size()
    assert mixed.max() <= 3 and set(mixed.index) <= set(after.index)
    assert set(seen["packing"].doc_id) == set(mixed.index)
    assert seen["packing"].drop_duplicates(["doc_id", "doc_tokens"]).shape[0] >= len(mixed)
    assert len(seen["packing"]) == corpus_pipeline.run(spark, data).count()
