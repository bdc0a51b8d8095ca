from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.functions.text import html_text, html_title

PAGES = [
    ('<p>one <a title="a>b" href=x>two</a> three</p>', "one two three"),
    ("<a title='x > \"y\"'>in</a>out", "in out"),
    ("<a title=don't>text</a> it's", "text it's"),
    ('<a title="open>text', "text"),
    ("before <!-- <script> --> after", "before after"),
    ("before <!-- never closed <p>gone</p>", "before"),
    ("<script>if (a < b) { '<!--' }</script>seen<!-- x -->", "seen"),
    ("<style>p > a { }</style >seen", "seen"),
    ("seen<script src=x>never closed", "seen"),
    ("<head><title>T</title></head><header>H</header><body>B</body>", "H B"),
    ("<head><p>no end of the head</p>", "no end of the head"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("&#65;&#x42;&#X1F600;&#8364;&#39;", "AB\U0001f600€'"),
    ("&#0;&#xD800;&#9999999;&#xFFFFFF;", "�" * 4),
    ("&amp;lt; &#38;#60; &#38;lt; &lt;p&gt; &quot;&apos;&nbsp;x&unknown; &", "&lt; &#60; &lt; <p> \"' x&unknown; &"),
    ("&lt;", "<"),
    ("", ""),
    (None, None),
]


def test_visible_text(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", html_text(F.col("html")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}


@pytest.mark.parametrize("page, want", [
    ("<script>" + "a < b;\n" * 200_000 + "</script>end", "end"),
    ("<p " + "a='>' b " * 50_000 + ">end", "end"),
    ("<!--" + "-" * 500_000 + "-->end", "end"),
    ("<b>x</b>" * 100_000, " ".join(["x"] * 100_000)),
    ("&#65;&amp;" * 50_000, "A&" * 50_000),
])
def test_long_pages(spark, page, want):
    assert spark.createDataFrame([(page,)], "html string").select(html_text(F.col("html"))).first()[0] == want


def test_title(spark):
    pages = [("<TITLE lang=en>\n A &amp; &#66; </TITLE>",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(pages, "html string").coalesce(1).select(html_title(F.col("html"))).collect()]
    assert got == ["\n A & B", "", None]
