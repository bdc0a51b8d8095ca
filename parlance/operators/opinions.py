"""Opinion mining: prompts, structured answers, parsing, refreshable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import count_in, has_any, words
from parlance.operators.index import content_hashes, text_hash
from parlance.session import shared_dir
from parlance.sizing import is_small, small_side
from parlance.sources.tables import quoted, table_or_none

# The allowed classifications and the shape of an answer.
CLASSIFICATIONS = [
    "QUALITY", "SERVICE", "EFFICIENCY", "DURABILITY", "BATTERY LIFE", "DESIGN", "SAFETY", "USABILITY", "PRICE",
    "COMFORT", "OTHER",
]
OPINION_SCHEMA = "array<struct<classification:string, comment:string, sentiment:string>>"

_OPINION_KEYS = ["classification", "comment", "sentiment"]


def opinion_prompt(text: Column, instructions: str, suffix: str = "\n\nRESULT\n") -> Column:
    return F.concat(F.lit(instructions), text, F.lit(suffix))


def mine_opinions(text: Column, topics: list[tuple[str, list[str]]], positive: list[str], negative: list[str],
                  default: str = "OTHER") -> Column:
    """A rule-based stand-in for the model: one opinion per sentence, as JSON text.

    The first topic with a word in the sentence classifies it; word lists give the sentiment.
    """
    listed = sorted({word for _, members in topics for word in members} | set(positive) | set(negative))

    def counted(part: Column) -> Column:
        sentence, tokens = part["sentence"], part["tokens"]
        label = F.lit(default)
        for name, members in reversed(topics):
            label = F.when(has_any(tokens, members), name).otherwise(label)
        return F.struct(label.alias("classification"), sentence.alias("comment"),
                        count_in(tokens, positive).alias("up"), count_in(tokens, negative).alias("down"))

    def opinion(part: Column) -> Column:
        up, down = part["up"], part["down"]
        sentiment = (F.when((up > 0) & (up == down), "Mixed").when(up > down, "Positive")
                     .when(down > up, "Negative").otherwise("Neutral"))
        return F.struct(part["classification"].alias("classification"), part["comment"].alias("comment"), sentiment.alias("sentiment"))

    # Each transform binds what the next one uses more than once; only listed words are looked up again.
    split = F.transform(sentences(text), lambda s: F.struct(
        s.alias("sentence"), F.filter(words(s), lambda w: w.isin(*listed)).alias("tokens")))
    return F.to_json(F.transform(F.transform(split, counted), opinion))


def sentences(text: Column) -> Column:
    """Trimmed parts between full stops, exclamation marks, question marks and line ends; empty ones left out."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def parse_opinions(answer: Column) -> Column:
    """The answer as an array of structs.  Keys match in any case; unreadable text gives NULL."""
    keys, plain = "|".join(_OPINION_KEYS), answer
    for key in _OPINION_KEYS:
        plain = F.regexp_replace(plain, rf'(?i)"{key}"\s*:', f'"{key}":')
    # Answers are rewritten only where a key is not written plainly.
    odd = answer.rlike(rf'"(?!(?:{keys})":)(?i:{keys})"\s*:')
    return F.from_json(F.when(odd, plain).otherwise(answer), OPINION_SCHEMA)


def explode_opinions(df: DataFrame, answer_col: str = "extracted_opinions", allowed: list[str] = CLASSIFICATIONS) -> DataFrame:
    """One row per opinion of an allowed class, next to the source columns.

    Unreadable and empty answers yield no row; ``opinion_rejects`` counts what is lost on the way.
    """
    exploded = df.withColumn("__opinion", F.explode(parse_opinions(F.col(answer_col))))
    return exploded.select(
        F.col("__opinion.classification").alias("classification"),
        F.col("__opinion.comment").alias("comment"),
        F.col("__opinion.sentiment").alias("sentiment"),
        *df.columns,
    ).where(F.col("classification").isin(*allowed))


def opinion_rejects(df: DataFrame, answer_col: str = "extracted_opinions", allowed: list[str] = CLASSIFICATIONS) -> DataFrame:
    """How many answers were unreadable or empty, and how many opinions were of no allowed class."""
    opinion = F.explode_outer(F.coalesce(F.col("__parsed"), F.array()))
    parsed = df.select(F.col(answer_col).alias("__answer"), parse_opinions(F.col(answer_col)).alias("__parsed"))
    rows = parsed.select("__answer", "__parsed", opinion.alias("__o"))
    off_list = F.col("__o").isNotNull() & ~F.coalesce(F.col("__o.classification").isin(*allowed), F.lit(False))
    return rows.agg(
        F.count_if(F.col("__answer").isNotNull() & F.col("__parsed").isNull()).alias("unreadable"),
        F.count_if(F.col("__parsed").isNotNull() & (F.size("__parsed") == 0)).alias("empty"),
        F.count_if(off_list).alias("off_list"),
    )


def opinion_summary(opinions: DataFrame, count: Column | None = None) -> DataFrame:
    """Counts by class and sentiment with subtotals; ``ALL`` marks a total, ``UNKNOWN`` a missing value.

    ``count`` is the aggregate to show, by default the number of rows.
    """
    def label(column: str) -> Column:
        return F.when(F.col(f"__{column}") == 1, "ALL").otherwise(F.coalesce(column, F.lit("UNKNOWN"))).alias(column)

    counted = opinions.rollup("classification", "sentiment").agg(
        (F.count("*") if count is None else count).alias("n_opinions"), F.grouping("classification").alias("__classification"),
        F.grouping("sentiment").alias("__sentiment"))
    return counted.select(label("classification"), label("sentiment"), "n_opinions")


def refresh_answers(
    source: DataFrame, answers_table: str, key: str, text_col: str, answer: Column, partial: bool = False
) -> None:
    """Adds answers for new and changed texts only; texts answered before are never asked again.

    Answers are stored by key and text hash, before any parsing, so a change in parsing costs no model
    call.  A run that is repeated after a failure finds what was written and adds nothing twice.
    With ``partial`` the source is a delivery: if its keys are few, stored answers are narrowed to them
    where they lie, instead of being shuffled.
    """
    spark = source.sparkSession
    wanted = source.withColumn("content_hash", text_hash(F.col(text_col)))
    known = table_or_none(spark, answers_table)
    if known is not None:
        # Keys and hashes are compared first, read from the texts once; whole texts are shuffled only if much is new.
        shared_dir(spark)
        hashes = content_hashes(source, key, text_col).checkpoint()
        known = known.select(key, "content_hash")
        if partial and is_small(hashes.select(key)):
            known = known.join(F.broadcast(hashes.select(key)), key, "left_semi")
        new = hashes.join(known, [key, "content_hash"], "left_anti").select(key)
        wanted = wanted.join(small_side(new), key, "left_semi")
    answered = wanted.select(key, "content_hash", answer.alias("extracted_opinions"))
    answered.write.format("parquet").mode("append").saveAsTable(quoted(answers_table))


def current_opinions(source: DataFrame, answers_table: str, key: str, text_col: str) -> DataFrame:
    """Opinions of the source as it is now: answers to replaced or deleted texts are left out."""
    hashes = content_hashes(source, key, text_col)
    live = source.sparkSession.table(quoted(answers_table)).join(hashes, [key, "content_hash"], "left_semi")
    return explode_opinions(live)
