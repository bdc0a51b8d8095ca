"""Rows of one key, NULL or repeated, are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.llm import suffixes
from parlance.llm.bpe import default_path
from parlance.llm.cost_packing import pack
from parlance.llm.suffixes import cut_repeats


def test_packing_bounds_groups_of_one_key(spark):
    rows = [(None, f"text {k} " + "word " * 40) for k in range(400)] + [(7, "equal " * 40)] * 400
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), default_path(), group_bytes=10_000).collect()
    assert sum(r.start == 0 for r in out) == 800
    assert sum(r.length for r in out if r.start == 0 and r.doc_id == 7) <= sum(r.doc_tokens for r in out if r.start == 0 and r.doc_id == 7)
    for key in (None, 7):
        sizes = {}
        for r in out:
            if r.doc_id == key:
                sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + (r.start == 0)
        assert len(sizes) > 10 and max(sizes.values()) < 100


def test_suffixes_fold_repeated_rows(spark, monkeypatch):
    seen, made = [], suffixes._Texts
    monkeypatch.setattr(suffixes, "_Texts", lambda texts, parts: (seen.append(texts.count()), made(texts, parts))[1])
    rows = [(3, "one passage that is longer than fifty bytes in all " * 2)] * 50 + [(4, "something else of more than fifty bytes, kept whole")]
    out = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [2] and len(out) == 51 and {r.n_removed for r in out} == {0}
