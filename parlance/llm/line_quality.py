"""Line-first cleaning: rules per line, failing lines go, documents that lose too much text are rejected.

Everything is a column expression on the scan; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import BLANKS, WORD, has_word, query, table

# Phrases of navigation and of boilerplate.
NAVIGATION = ["click here", "read more", "next page", "previous page", "back to top", "skip to content", "sign in", "log in", "main menu"]
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
               "enable javascript", "lorem ipsum", "powered by"]
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
ENDS = ".!?:;…。！？।॥؟۔።"
CLOSERS = ")]}\"'’”»" + BLANKS + " "


@dataclass(frozen=True)
class LineRules:
    """Bounds of the rules; all shares are of characters outside white space, those of phrases of letters and digits."""

    max_symbol_share: float = 0.1
    max_separators: int = 2
    max_shout_share: float = 0.05
    max_phrase_share: float = 0.2
    long_line_chars: int = 200
    min_kept_share: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


def count_of(text: Column, characters: str) -> Column:
    """How many of these characters a text holds."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.char_length(text) - F.char_length(rest)


def solid(text: Column) -> Column:
    """Number of characters outside white space."""
    return F.char_length(F.translate(text, BLANKS + " ", ""))


def phrase_pattern() -> str:
    """Phrases as they stand in plain words: two blanks between words, so that neighbours do not share one."""
    return "|".join(f" {phrase.replace(' ', '  ')} " for phrase in NAVIGATION + BOILERPLATE)


def line_passes(line: Column, plain: Column, rules: LineRules) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word.

    ``plain`` is the line in lower case with two blanks for all that is no letter or digit.  A line passes if it holds few symbols
    and few ``!``, ends a sentence or is long, is no list of separated entries, and phrases that stand in it as whole words make up
    little of it: a phrase fails a short line, not a paragraph that mentions it.
    """
    size, written = solid(line), F.concat(F.lit(" "), plain, F.lit(" "))
    last = F.substring(F.rtrim(line, F.lit(CLOSERS)), -1, 1)
    punctuated = last.isin(*ENDS) | (size >= rules.long_line_chars)
    calm = (count_of(line, SYMBOLS) <= rules.max_symbol_share * size) & (count_of(line, "!") <= rules.max_shout_share * size)
    listed = count_of(line, SEPARATORS) > rules.max_separators
    letters = F.char_length(F.replace(written, F.lit(" "), F.lit("")))
    left = F.char_length(F.replace(F.regexp_replace(written, phrase_pattern(), ""), F.lit(" "), F.lit("")))
    return punctuated & calm & ~listed & (letters - left <= rules.max_phrase_share * letters)


def repeat_starts() -> Column:
    """Starts of the 5-word windows that occur twice or more; ``__p`` holds (hash, start) in order."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    around = F.arrays_zip(F.concat(none, "__p").alias("before"), F.col("__p").alias("own"), F.slice("__p", 2, F.size("__p")).alias("after"))
    marked = F.transform(around, lambda z: F.when((z["own"]["h"] == z["before"]["h"]) | (z["own"]["h"] == z["after"]["h"]), z["own"]["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered_words() -> Column:
    """Number of words in the windows that begin at ``__s``; each word counts once."""
    steps = F.zip_with("__s", F.slice("__s", 2, F.size("__s")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: n + step)


def clean_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds the base counts, ``clean_text``, ``base_failed`` and ``kept`` to every row.

    NULL and empty texts have no words: all counts 0, ``clean_text`` empty, ``base_failed`` true and ``kept``
    false.  Every row is judged alone, so repeated rows get equal results.  Windows are compared by
    64-bit hashes within one text.  The added columns replace columns of the same name; those beginning with
    ``__`` are internal.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"__t": text}).withColumns({
        "__w": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)), "__l": F.split("__t", "\n"),
        "__plain": F.split(F.regexp_replace(F.lower("__t"), r"[^\p{L}\p{N}\n]+", "  "), "\n")})
    n = F.size("__w")
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(5)]))
    out = out.withColumns({
        "__lw": F.filter("__l", has_word),
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long"),
        "__h": F.when(n >= 5, hashes).otherwise(F.array().cast("array<bigint>")),
        "clean_text": F.array_join(F.filter(
            "__l", lambda line, i: has_word(line) & line_passes(line, F.get("__plain", i), rules)), "\n"),
    })
    out = out.withColumn("n_dup_lines", (F.size("__lw") - F.size(F.array_distinct("__lw"))).cast("long"))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    out = out.withColumn("__s", F.when(F.col("__p").isNotNull(), repeat_starts()))
    out = out.withColumn("n_repeat_words", F.when(F.col("__s").isNotNull(), covered_words()).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (solid(F.col("clean_text")) >= rules.min_kept_share * solid(F.col("__t")))
    ).drop("__t", "__w", "__l", "__plain", "__lw", "__h", "__p", "__s")


_BLANK = r"[\x20\x09-\x0D]"


def _sql(rules: LineRules = LineRules()) -> str:
    def solid_sql(x: str) -> str:
        return f"length(regexp_replace({x}, '{_BLANK}', '', 'g'))"

    def of(x: str, chars: str) -> str:
        return f"(length({x}) - length(translate({x}, '{chars}', '')))"

    tail = "".join("\\" + c if c in ")]}" else c for c in CLOSERS.strip()).replace("'", "''")
    written = "concat(' ', regexp_replace(lower(l), '[^\\p{L}\\p{N}]+', '  ', 'g'), ' ')"
    letters = f"length(replace({written}, ' ', ''))"
    left = f"length(replace(regexp_replace({written}, '{phrase_pattern()}', '', 'g'), ' ', ''))"
    passes = f"""({of('l', SYMBOLS)} <= {rules.max_symbol_share}::DOUBLE * {solid_sql('l')}
        AND (regexp_matches(l, '[{ENDS}][{tail}\\x20\\x09-\\x0D]*$') OR {solid_sql('l')} >= {rules.long_line_chars})
        AND {of('l', '!')} <= {rules.max_shout_share}::DOUBLE * {solid_sql('l')}
        AND {of('l', SEPARATORS)} <= {rules.max_separators}
        AND {letters} - {left} <= {rules.max_phrase_share}::DOUBLE * {letters})"""
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        g AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS s FROM (
            SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
        rep AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM (
            SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
        n AS (SELECT r, sum(least(5, coalesce(q - p, 5)))::BIGINT AS n FROM rep GROUP BY r),
        m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, {solid_sql('t')}::BIGINT AS word_chars, {of('t', SYMBOLS)}::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
            array_to_string(list_filter(ls, lambda l: {passes}), chr(10)) AS clean
            FROM w LEFT JOIN n USING (r)),
        f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND {solid_sql('clean')} >= {rules.min_kept_share}::DOUBLE * word_chars AS kept,
            length(clean)::BIGINT AS clean_chars FROM f"""


@query("op4_quality_rules", _sql())
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.char_length("clean_text").cast("long").alias("clean_chars"))
