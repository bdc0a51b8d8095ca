from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions.text import clean_name
from parlance.operators.names import best_entries, correct_names, similarity_ratio, union_names
from parlance.operators.trie import Trie

CITIES = ["New York", "Amsterdam", "Barcelona", "Berlin", "Prague"]


def dictionary(spark, entries):
    return spark.createDataFrame(list(enumerate(entries)), "position bigint, entry string")


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    total = len(a) + len(b)
    return int(200 * row[-1] / total + 0.5) if total else 100


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcde", max_size=12))
def test_ratio_is_the_common_subsequence_ratio(a, b):
    assert similarity_ratio(a, b) == plain_ratio(a, b)


def test_spelling_example(spark):
    words = spark.createDataFrame([("bercelona",), ("emstrdam",), ("Praga",), ("Zzz",), (None,)], "word string")
    got = {r.word: r.corrected for r in correct_names(words, "word", dictionary(spark, CITIES)).collect()}
    assert got == {"bercelona": "Barcelona", "emstrdam": "Amsterdam", "Praga": "Prague", "Zzz": None, None: None}


@pytest.mark.parametrize("bounds", [{}, {"max_entries": 3}])
def test_best_entry_equals_brute_force(spark, bounds):
    names = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    entries = sorted(names)
    words = sorted({n.replace("e", "a") for n in names} | {n[1:] for n in names} | {n[:4] for n in names} | {""})
    frame = spark.createDataFrame([(w,) for w in words * 3], "word string")
    got = {r.word: (r.entry, r.ratio) for r in best_entries(frame, dictionary(spark, entries), 70, **bounds).collect()}
    want = {}
    for word in words:
        scores = [plain_ratio(word, e) for e in entries]
        if max(scores) > 70:
            want[word] = (entries[scores.index(max(scores))], max(scores))
    assert got == want


def test_threshold_is_strict(spark):
    words = spark.createDataFrame([("ab",)], "word string")
    assert best_entries(words, dictionary(spark, ["ac"]), 50).count() == 0
    assert best_entries(words, dictionary(spark, ["ac"]), 49).count() == 1


@pytest.mark.parametrize("dirty, clean", [
    ('""Acme" Inc"" "', 'Acme" Inc'), ('A " " ""', 'A "'), (' "A"', ' "A'), ("plain", "plain"), ("end   ", "end"), ('"', ""),
])
def test_clean_name(spark, dirty, clean):
    assert spark.range(1).select(clean_name(F.lit(dirty))).first()[0] == clean


def test_union_keeps_duplicates(spark):
    a = spark.createDataFrame([("x",), ("x",)], "n string")
    assert union_names((a, "n"), (a, "n"), (a, "n")).count() == 6


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=7), max_size=14), st.text("abcd", max_size=7), st.integers(0, 99))
def test_trie_finds_the_best_entry(entries, word, threshold):
    numbered = [(e, n) for n, e in enumerate(entries)]
    found = Trie(numbered).best(word, threshold)
    scores = [(plain_ratio(word, e), -n) for e, n in numbered if plain_ratio(word, e) > threshold]
    assert (found[:2] if found else None) == ((max(scores)[0], -max(scores)[1]) if scores else None)


def test_trie_opens_few_nodes():
    """Misspelled words open a small part of a large dictionary, and a smaller part of a larger one."""
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(2, 5))) for _ in range(300)]
    share = []
    for size in (2_000, 20_000):
        entries = sorted({" ".join(rng.choice(parts, 3)) for _ in range(size)})
        trie = Trie([(e, n) for n, e in enumerate(entries)])
        opened = []
        for e in rng.choice(entries, 60):
            k = rng.integers(1, len(e) - 1)
            found = trie.best(e[:k] + "x" + e[k + 1:], 70)
            opened.append(found[2])
        share.append(np.mean(opened) / len(entries))
    assert share[1] < 0.04 and share[1] < share[0] / 4
