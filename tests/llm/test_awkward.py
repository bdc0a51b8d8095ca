"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm.bpe import default_path
from parlance.llm.centroid_lang import CentroidModel, fit, identify
from parlance.llm.cost_packing import pack
from parlance.llm.entropy_mix import mix
from parlance.llm.golay import near_duplicates
from parlance.llm.hash_tree import assign_shards, topology
from parlance.llm.line_quality import clean_lines
from parlance.llm.oph import edited_fingerprints
from parlance.llm.quotes import build_conversations, link_quotes
from parlance.llm.suffixes import cut_repeats
from parlance.llm.token_counts import TokenRollup
from parlance.session import run_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["__w", "__h", "key", "simhash", "rank", "id", "hash", "group", "class", "draw", "own", "kept", "rejected", "part"]
PLAIN = "The quick brown fox jumps over the lazy dog near the old mill by the river bank today."
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000)) + "."
ROWS = [
    (1, PLAIN, "en", "a", 86), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n", "en", None, 3),
    (None, PLAIN, "en", "b", 86), (5, PLAIN, "en", "b", 86), (5, PLAIN, "en", "b", 86), (6, LONG, "en", "b", len(LONG)),
    (7, "12 34 !!", "en", "c", 8), (8, "Ünïcödé ÀÉ 日本語 text\n\n\nline", "de", "c", 27), (None, None, None, None, None), (9, "a", "en", "c", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_quality(awkward, empty):
    rows = clean_lines(awkward).collect()
    assert len(rows) == len(ROWS) and clean_lines(empty).count() == 0
    blank = [r for r in rows if r.text is None or not r.text.strip()]
    assert blank and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) == (0, 0, 0, 0, 0, False) for r in blank)
    assert {r.kept for r in rows if r.text == PLAIN} == {True}


def test_suffixes(awkward, empty):
    rows = cut_repeats(awkward, with_text=True).collect()
    assert len(rows) == len(ROWS) and cut_repeats(empty).count() == 0
    size = len(PLAIN.encode())
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].n_removed == 0 and [r.n_removed for r in by_id[5]] == [size, size]
    assert sorted((r.n_bytes, r.n_removed) for r in by_id[None]) == [(0, 0), (size, size)]  # NULL ids count as the largest
    assert by_id[2][0].kept_sha256 == hashlib.sha256(b"").hexdigest() and by_id[6][0].n_removed == 0


def test_language(spark, awkward, empty):
    model = fit(awkward.where("doc_id < 9"))
    rows = identify(awkward, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {"en", "de"} and 0 <= r.score <= 1
    nothing = fit(empty)
    assert isinstance(nothing, CentroidModel) and {r.lang_pred for r in identify(awkward, nothing).collect()} == {"und"}
    assert identify(empty, model).count() == 0


def test_fingerprints(awkward, empty):
    rows = edited_fingerprints(awkward).collect()
    assert len(rows) == len(ROWS) and edited_fingerprints(empty).count() == 0
    assert len({r.fingerprint for r in rows if r.n_chars == len(PLAIN)}) == 1
    assert all(r.fingerprint == "" for r in rows if r.n_chars in (0, 3))
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_simhash(awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == len(ROWS) and near_duplicates(empty).count() == 0
    assert {r.component_id for r in rows if r.text == PLAIN} == {1}
    assert {(r.fingerprint, r.component_id) for r in rows if r.text is None or not r.text.strip()} == {("0" * 16, 2)}


def test_mix(awkward, empty):
    rows = mix(awkward).collect()
    assert len(rows) == len(ROWS) and mix(empty).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_sharding(awkward, empty):
    rows = assign_shards(awkward, topology(8), topology(9)).collect()
    assert len(rows) == len(ROWS) and assign_shards(empty, topology(8), topology(9)).count() == 0
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_packing(awkward, empty):
    rows = pack(awkward, default_path()).collect()
    assert pack(empty, default_path()).count() == 0
    assert sum(r.length for r in rows if r.doc_id is None) == sum({r.doc_tokens for r in rows if r.doc_id is None})
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 2] == [(1, 1)]
    assert sum(r.start == 0 for r in rows) == len(ROWS)


def test_rollup(spark, awkward, empty):
    rollup = TokenRollup(spark, run_dir(spark, "t"), default_path(), "v")
    assert rollup.totals().count() == 0
    assert rollup.commit("none") and rollup.commit("zero", empty) and rollup.commit("all", awkward)
    assert not rollup.commit("all", awkward)
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == len(ROWS)
    rollup.commit("gone", deletes=awkward.where("doc_id = 5").unionByName(awkward.where("doc_id = 5")).select("doc_id"))
    rollup.commit("unknown", deletes=spark.createDataFrame([(77,), (None,)], "doc_id long"))
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == len(ROWS) - 2


def test_quotes(spark, empty):
    rows = [(1, "Hello there"), (2, "Yes\n> Hello there"), (3, None), (4, ""), (5, "> gone\nwhat"), (6, "no\n> Yes\n>> Hello there"),
            (None, "x\n> Hello there"), (7, "> \n>\nempty"), (2, "Yes\n> Hello there"), (8, LONG)]
    frame = spark.createDataFrame(rows, "message_id long, text string").withColumn("level", F.lit("x")).withColumn("parent_id", F.lit(9))
    extra = ["__id", "__up", "__depth", "__moving", "__lines", "__levels", "__body", "__by_own", "conversation_id", "position", "mine"]
    linked = link_quotes(frame.withColumns({c: F.lit("x") for c in extra}))
    out = build_conversations(linked).collect()
    assert {r[c] for r in out for c in ("__id", "__up", "__depth", "__moving", "__lines", "__levels", "__body", "__by_own", "mine", "level")} == {"x"}
    assert len(out) == len(rows)
    got = {(r.message_id, r.parent_id, r.conversation_id, r.depth) for r in out}
    assert {(1, None, 1, 0), (2, 1, 1, 1), (6, 2, 1, 2), (5, None, 5, 0), (None, None, None, 0)} <= got
    assert build_conversations(link_quotes(spark.createDataFrame([], "message_id long, text string"))).count() == 0


def test_pipeline_stages(spark, awkward, empty):
    for given in (awkward, empty):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").checkpoint()
            assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
        if given is empty:
            assert docs.count() == 0
        else:
            assert docs.where("doc_id = 1").count() > 0 and docs.where("text is null" if "text" in docs.columns else "doc_id = 2").count() == 0
