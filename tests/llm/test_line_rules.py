"""Line rules judge what a reader would: whole words, short lines, characters outside white space, stops of other scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.llm.line_quality import clean_lines

SENTENCE = "The committee met in the old hall and talked about the harvest of the year."
SECOND = "Several farmers from the valley asked for better roads before another winter arrives with heavy snow."
HINDI = "यह एक साफ वाक्य है जो एक पंक्ति में लिखा गया है।\nदूसरा वाक्य भी साफ है और यहाँ समाप्त होता है।"
ONE_LINE = " ".join(f"word{k % 997}x{k}" for k in range(20_000))


def judged(spark, *texts):
    rows = clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id")
    return rows.select("kept", "clean_text").collect()


def test_clean_texts_stay(spark):
    texts = [ONE_LINE, ONE_LINE + " design in", f"{SENTENCE}\nA catalog in Berlin lists every one of the old maps.",
             SENTENCE + "\n" * 200 + SECOND, HINDI, SENTENCE + "   " * 400 + SECOND,
             "She had to read the privacy policy of the insurer twice before she understood what the long second part of it meant."]
    for text, row in zip(texts, judged(spark, *texts)):
        assert row.kept and row.clean_text.split() == text.split()


def test_short_lines_of_phrases_go(spark):
    lines = ["Sign in.", "Log in, sign in, read more.", "(C) 2020 Example. All rights reserved.", "Click here!", "Home | News | Shop | Contact us."]
    texts = [f"{SENTENCE}\n{line}\n{SECOND}" for line in lines]
    for text, row in zip(texts, judged(spark, *texts)):
        assert row.kept and row.clean_text.split("\n") == [text.split("\n")[0], text.split("\n")[2]]
    (menu,) = judged(spark, "\n".join(["Sign in now.", "Read more here.", "Main menu below.", "Next page follows."]))
    assert not menu.kept and menu.clean_text == ""


def test_own_columns_survive(spark):
    rows = spark.createDataFrame([(1, SENTENCE)], "doc_id long, text string").withColumn("solid", F.lit("x")).withColumn("plain", F.lit("y"))
    assert clean_lines(rows).select("solid", "plain").first() == ("x", "y")
