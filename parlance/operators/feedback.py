"""Reactions to answers: polarity, sentiment per message, summary, review queue, alerts, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import contains_any

# The reactions that count, and the markers of agent messages.
NEGATIVE = ["👎", "❌", "😞", "😡", "😢", "😠", "dislike", "angry", "sad"]
POSITIVE = ["👍", "✅", "😊", "🎉", "❤️", "like", "love", "heart"]
AGENT_MARKERS = ["🤖 AI Agent", "AI Response"]


def polarity_counts(reactions: DataFrame, keys: list, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE,
                    reaction_col: str = "reaction") -> DataFrame:
    """negative_count, positive_count, total_reactions per message; other reactions are ignored."""
    reaction = F.col(reaction_col)
    return reactions.groupBy(*keys).agg(
        F.count_if(reaction.isin(*negative)).alias("negative_count"),
        F.count_if(reaction.isin(*positive) & ~reaction.isin(*negative)).alias("positive_count"),
    ).withColumn("total_reactions", F.col("negative_count") + F.col("positive_count"))


def sentiment(ties: str = "neutral") -> Column:
    """More wins.  A tie is ``neutral``, or with ``ties="positive"`` positive; no reaction is always neutral."""
    up, down = F.col("positive_count"), F.col("negative_count")
    tie = F.when(up + down > 0, ties).otherwise("neutral")
    return F.when(down > up, "negative").when(up > down, "positive").otherwise(tie)


def message_sentiment(reactions: DataFrame, keys: list, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE,
                      reaction_col: str = "reaction", ties: str = "neutral") -> DataFrame:
    """Counts and sentiment per message.  Counting combines before the shuffle, so hot messages stay cheap."""
    return polarity_counts(reactions, keys, positive, negative, reaction_col).withColumn("sentiment", sentiment(ties))


def from_reaction_lists(messages: DataFrame, reactions_col: str = "reactions", ties: str = "neutral",
                        positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """The same for messages that hold their reactions as an array of structs with ``reactionType``; no shuffle."""
    kinds = F.transform(F.coalesce(F.col(reactions_col), F.array()), lambda r: r["reactionType"])
    down = F.size(F.filter(kinds, lambda k: k.isin(*negative)))
    up = F.size(F.filter(kinds, lambda k: k.isin(*positive) & ~k.isin(*negative)))
    return (
        messages.withColumn("negative_count", down.cast("long")).withColumn("positive_count", up.cast("long"))
        .withColumn("total_reactions", F.col("negative_count") + F.col("positive_count"))
        .withColumn("sentiment", sentiment(ties))
    )


def with_reactions(messages: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with their counts and sentiment; those without any reaction are neutral, with counts of 0."""
    counts = ["negative_count", "positive_count", "total_reactions"]
    return messages.join(judged, keys, "left").withColumns({
        **{c: F.coalesce(c, F.lit(0)).cast("long") for c in counts}, "sentiment": F.coalesce("sentiment", F.lit("neutral"))})


def agent_messages(messages: DataFrame, body_col: str = "body", markers: list[str] = AGENT_MARKERS) -> DataFrame:
    return messages.where(contains_any(F.col(body_col), markers))


def summary(judged: DataFrame, keys: list | None = None) -> DataFrame:
    """Messages checked and how many were negative, positive and neutral."""
    def counted(kind: str) -> Column:
        return F.count_if(F.col("sentiment") == kind).alias(f"{kind}_feedback")

    grouped = judged.groupBy(*keys) if keys else judged
    return grouped.agg(F.count("*").alias("total_checked"), counted("negative"), counted("positive"), counted("neutral"))


def review_queue(judged: DataFrame, tracked: DataFrame, key: str, body_col: str, at: Column) -> DataFrame:
    """Every message that is not neutral, with its question and answer.

    Untracked messages have the question ``Unknown`` and their own body as the answer.
    """
    known = tracked.select(key, F.col("query").alias("__q"), F.col("response").alias("__r"), F.lit(True).alias("__t"))
    joined = judged.where(F.col("sentiment") != "neutral").join(known, key, "left")
    return joined.withColumns({
        "query": F.when(F.col("__t"), F.col("__q")).otherwise("Unknown"),
        "response": F.when(F.col("__t"), F.col("__r")).otherwise(F.col(body_col)),
        "requires_review": F.col("sentiment") == "negative",
        "recorded_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
    }).drop("__q", "__r", "__t")


RECORD_SCHEMA = (
    "{}, query string, response string, sentiment struct<sentiment: string, negative_count: bigint, positive_count: bigint, "
    "total_reactions: bigint>, timestamp string, {}"
)


def as_record(key: str, *more: str) -> Column:
    """The nested feedback record as JSON text, with further columns behind it."""
    counts = ["sentiment", "negative_count", "positive_count", "total_reactions"]
    return F.to_json(F.struct(key, "query", "response", F.struct(*counts).alias("sentiment"),
                              F.col("recorded_at").alias("timestamp"), *more))


def alerts(summaries: DataFrame, threshold: int = 0) -> DataFrame:
    """Summaries with more negative messages than the threshold."""
    return summaries.where(F.col("negative_feedback") > threshold)


def trend(judged: DataFrame, ts_col: str, width: str = "1 day") -> DataFrame:
    """The summary per time window."""
    return summary(judged, [F.window(ts_col, width).alias("w")]).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total_checked", "negative_feedback", "positive_feedback",
        "neutral_feedback")
