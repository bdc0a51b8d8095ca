"""Spelling variants, URL models and level products against plain Python, and on awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import level_products, spelling, url_models
from parlance.llm.common import ORACLES, QUERIES

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least=5):
    seen = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least and len(w) >= 6}


def brute_variants(words):
    holes = defaultdict(list)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1:]].append(w)
    near = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            near[w] |= {v for v in holes[w[:k] + "\0" + w[k + 1:]] if v != w}
            shorter = w[:k] + w[k + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_variants(frame):
    rows = frame.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_of_all_documents(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    assert as_variants(QUERIES["op11_spelling_variants"](spark, data)) == brute_variants(brute_words(rows))


SPELLED = [
    (1, "colour " * 200 + "color colors"), (2, "coluor " * 5 + "colouur " * 6 + "Colouür " * 9), (None, "colouur colour" * 7), (3, None), (4, ""),
    (5, "COLOUÜR×÷ naïvely naively " * 40), (5, "COLOUÜR×÷ naïvely naively " * 40), (6, "日本語 " + "aaaaaaa aaaaaab " * 9), (7, "aaaaaaaa " * 60),
    (8, ("z" * 3000 + " ") * 5 + ("z" * 2999 + "y ") * 30 + ("z" * 3001 + " ") * 160), (9, "abcdef abcdeg abcdeh " * 30), (10, "abcdéf " * 6),
]


def test_spelling_rounds_and_awkward_rows(spark):
    frame = spark.createDataFrame(SPELLED, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "form", "a", "b", "near")})
    expected = brute_variants(brute_words(SPELLED))
    assert expected["z" * 2999 + "y"][1] != expected["z" * 3000][1] or expected["z" * 3000][0]
    assert any(form for form, *_ in expected.values()) and any(n > 1 for *_, n, _ in expected.values())
    for bound in (spelling.MAX_BYTES, 64):  # one round, and a round for every block
        assert as_variants(spelling.spelling_variants(frame, max_bytes=bound)) == expected
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_hold_every_word_and_few_others(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdefgh"), 9)) for _ in range(4000)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    shards = spelling.Shards({9: len(words)}, spelling.MAX_BYTES)
    part = spelling.filter_blocks(frame, shards).toArrow()
    filled = np.zeros((shards.total, 8), np.uint64)
    filled[part["block"].to_numpy()] = np.stack([part[f"m{k}"].to_numpy().view(np.uint64) for k in range(8)], 1)

    def passed(many):
        letters = np.frombuffer("".join(many).encode(), np.uint8).reshape(len(many), 9)
        return len(shards.passed(spelling._places(np.arange(9)[None, :], letters).sum(axis=1, dtype=np.uint64), 9, filled, 0))

    assert passed(words) == len(words)
    others = sorted({"".join(rng.choice(list("abcdefgh"), 9)) for _ in range(4000)} - set(words))
    assert passed(others) < 0.02 * len(others)


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_models.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_verdicts(urls):
    """The models with plain dictionaries."""
    labelled = []
    for url in urls:
        host, path = brute_host_path(url)
        labelled.append((host, path, *brute_rule(host, path)))
    counts = {side: Counter() for side in ("allow", "block")}
    successors = {side: defaultdict(set) for side in counts}
    totals = {side: Counter() for side in counts}

    def steps(text):
        s = bytes([1] * 4) + text.encode() + b"\0"
        for i in range(4, len(s)):
            yield [(s[i - k:i], s[i]) for k in range(5)]

    held = lambda text: zlib.crc32(text.encode()) % 4 == 2
    for host, path, _, verdict in labelled:
        if verdict and not held(host + path):
            for orders in steps(host + path):
                for context, c in orders:
                    counts[verdict][context, c] += 1
                    totals[verdict][context] += 1
                    successors[verdict][context].add(c)

    def score(text):
        total, n = 0.0, 0
        for orders in steps(text):
            p = dict.fromkeys(counts, 1 / 257)
            for side in counts:
                for context, c in orders:
                    seen, t = totals[side][context], len(successors[side][context])
                    if seen:
                        p[side] = (counts[side][context, c] + t * p[side]) / (seen + t)
            total += math.log(p["allow"]) - math.log(p["block"])
            n += 1
        return round(total / n, 9)

    sides = {"allow": [], "block": []}
    for host, path, _, verdict in labelled:
        if verdict and held(host + path):
            sides[verdict].append(score(host + path))
    if all(sides.values()):
        (ma, sa), (mb, sb) = ((np.mean(x), np.std(x)) for x in (sides["allow"], sides["block"]))
        bound = round((ma * sb + mb * sa) / (sa + sb) if sa + sb else (ma + mb) / 2, 6)
    else:
        bound = 0.0
    out = []
    for host, path, rule, verdict in labelled:
        s = None if verdict else score(host + path)
        out.append((host, path, rule, verdict or ("allow" if s >= bound else "block"), s))
    return out


def check_verdicts(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and abs((a[4] or 0) - (b[4] or 0)) < 1e-8


def test_verdicts_of_all_pages(spark, data):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{data}/pages.parquet' ORDER BY page_id").fetchall()
    got = QUERIES["op12_url_models"](spark, data).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [p[0] for p in pages]
    expected = brute_verdicts([p[1] for p in pages])
    check_verdicts([(r.host, r.path, r.rule, r.verdict, r.score) for r in got], expected)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/1", "http://a.www.example.com/en/1", "http://notexample.com/en/",
    "http://com/", "http://x.net/es", "http://x.net/es/?q=://", "a://b://c/d", "http://x.net?/es/", "http://Ünï.org/ß", "http://x.org/" + "long/" * 5000,
    "line\nbreak://h.net/fr/\nx", "http://dup.org/1", "http://dup.org/1", "http://x.net/fr/a", "http://y.net/fr/b", "http://z.com/p/q", "http://q.com/w",
]


def test_urls_on_awkward_rows(spark):
    schema = "page_id long, url string"
    frame = spark.createDataFrame(list(enumerate(URLS)), schema).withColumns({c: F.lit("x") for c in ("text", "label", "row", "n", "found", "host", "path", "rule", "verdict", "score", "key", "group")})
    expected = brute_verdicts(URLS)
    for size in (url_models.GROUP_BYTES, 100):
        got = url_models.judge_urls(frame, group_bytes=size).orderBy("page_id").collect()
        check_verdicts([(r.host, r.path, r.rule, r.verdict, r.score) for r in got], expected)
        assert got[0].text == "x" and got[0].found == "x"
    assert url_models.judge_urls(spark.createDataFrame([], schema)).count() == 0
    nothing = url_models.judge_urls(frame, rules=[]).collect()
    assert {(r.verdict, r.score) for r in nothing} == {("allow", 0.0)}


def test_level_products_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    rows, columns = [], []
    for row in range(300):
        own = np.sort(rng.choice(400, rng.integers(1, 60), replace=False))
        rows += [row] * len(own)
        columns += own.tolist()
    expected = Counter()
    by_row = defaultdict(list)
    for r, c in zip(rows, columns):
        by_row[r].append(c)
    for own in by_row.values():
        expected.update((a, b) for a in own for b in own if a < b)
    for size in (7, 64, 1024):
        monkeypatch.setattr(level_products, "COLUMNS", size)
        got = Counter()
        for i, j, n in level_products.indicator_products(np.array(rows), np.array(columns)):
            for a, b, k in zip(i.tolist(), j.tolist(), n.tolist()):
                got[a, b] += k
        assert got == expected


SCHEMA = "doc_id long, text string, lang string, source string"
MIXED = [
    (1, "Apple apple ÄPFEL äpfel x1y2", "en", "a"), (2, "apple pear ÄPFEL x", "en", "b"), (3, "apple pear pear x y", "en", "b"), (4, "pear apple", "en", None),
    (5, None, "en", "c"), (6, "", None, None), (7, "1 2 3 \n\t", "de", "a"), (7, "1 2 3 \n\t", "de", "a"), (None, "日本 日本 日本", "ja", "a"), (8, "日本", "ja", "b"),
    (9, "日本 " * 5000 + "tail " * 3, "ja", "b"), (10, "x y", "ja", ""), (11, "solo", "fr", "z"), (12, "äpfel z", "en", "a"),
]


def test_divergences_on_awkward_rows(spark, tmp_path):
    frame = spark.createDataFrame(MIXED, SCHEMA).withColumns({c: F.lit("x") for c in ("term", "n", "docs", "item", "value", "rank", "part", "p", "zero", "block", "row")})
    con = duckdb.connect()
    con.register("given", frame.select("doc_id", "text", "lang", "source").toPandas())
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    expected = sorted(con.execute(ORACLES["op13_level_products"]).fetchall())
    for size in (level_products.BLOCK_ENTRIES, 2):
        got = level_products.divergences(frame, block_entries=size).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(tuple(r) for r in got.collect()) == expected
    assert ("de", "a", "pair") not in {r[:3] for r in expected}  # one source has no pair
    assert level_products.divergences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prices_are_exact_for_large_counts(spark):
    row = spark.range(1).select(level_products.price(F.lit(9_300_000_000_000), F.lit(9_400_000_000_001), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * 9_300_000_000_001 // 9_400_000_000_008


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_url_models", "op13_level_products"])
def test_columns(spark, data, name):
    columns = dict(QUERIES[name](spark, data).dtypes)
    assert columns == {
        "op11_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
        "op12_url_models": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string", "score": "double"},
        "op13_level_products": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    }[name]
