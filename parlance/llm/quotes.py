"""Quotation linking: which message answers which, told from the passages it quotes.

Lines that begin with ``>`` are quotes; the number of marks is the level.  Taking one level off all quoted
lines gives the message that was answered, with the quotes that it had itself.  Its normalised hash is looked
up among the bodies of all messages, and the hash of the passage alone among their own texts.  Both look-ups
go to one original per hash, so a passage that many messages share is joined many to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, stored, table
from parlance.sizing import number_rows

MARKS = r"^[\x20\t]*((?:>[\x20\t]?)+)"
FIRST_MARK = r"^[\x20\t]*>[\x20\t]?"


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of our own that ``df`` does not have."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        names.append(stem)
    return names


def level_of(line: Column) -> Column:
    """Number of quote marks that begin a line."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def hash_of(within: list[str], *texts: Column) -> Column:
    """Hash of normalised passages, apart for each value of ``within``; NULL if the first is empty."""
    clean = [normalised(F.coalesce(t, F.lit(""))) for t in texts]
    named = [F.col(c).cast("string").alias(c) for c in within] + [c.alias(f"t{k}") for k, c in enumerate(clean)]
    return F.when(clean[0] != "", F.sha2(F.to_json(F.struct(*named)), 256))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``own_text`` (without quotes), ``quotes`` (level, passage; nearest first), ``answered`` and ``n_levels``.

    ``answered`` is all that is quoted with one mark taken off each line: the message that was answered as it
    was sent.  A passage joins the lines of one level.  NULL texts have no quotes and an empty own text.  Added
    columns replace columns of the same name.
    """
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.struct(level_of(x).alias("level"), x.alias("line")))
    line, depth = fresh(messages, "__lines", "__levels")
    out = messages.withColumn(line, lines)
    out = out.withColumn(depth, F.array_sort(F.array_distinct(F.filter(F.col(f"{line}.level"), lambda n: n > 0))))

    def joined(level: Column) -> Column:
        rows = F.filter(line, lambda x: x["level"] == level)
        return F.array_join(F.transform(rows, lambda x: F.regexp_replace(x["line"], MARKS, "")), "\n")

    one_less = F.transform(F.filter(line, lambda x: x["level"] > 0), lambda x: F.regexp_replace(x["line"], FIRST_MARK, ""))
    return out.withColumns({
        "own_text": F.trim(F.array_join(F.transform(F.filter(line, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \n\r\t")),
        "quotes": F.transform(depth, lambda n: F.struct(n.alias("level"), joined(n).alias("passage"))),
        "answered": F.array_join(one_less, "\n"),
        "n_levels": F.coalesce(F.array_max(depth), F.lit(0)).cast("long"),
    }).drop(line, depth)


def link_quotes(messages: DataFrame, id_col: str = "message_id", text_col: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``parent_id``: the message that a message quotes at the first level, or NULL.

    The parent is the smallest id whose whole body is what was answered; failing that, the smallest id that has
    the passage of the first level as its own text and quotes the passage of the second; failing that, the
    smallest with the first alone.  Only smaller ids with equal values in ``within`` (a mailbox, a list)
    qualify, so links cannot form a circle.  NULL ids are kept and neither link nor are linked to.  Rows
    that repeat an id all get the smallest link.  An empty table gives no rows.  A column of the name of an added one is replaced.
    """
    messages = messages.drop("parent_id")
    keys, own = list(within), F.col("own_text")
    first, second = (F.get(F.col("quotes"), k)["passage"] for k in (0, 1))
    parsed = parse_quotes(messages, text_col)
    forms = {"body": (F.col(text_col),), "pair": (own, first), "own": (own,)}
    wanted = {"body": (F.col("answered"),), "pair": (first, second), "own": (first,)}
    # Texts are parsed once for the look-ups; only ids and hashes are written and shuffled.
    hashes = stored(parsed.select(
        id_col, "n_levels", *[hash_of(keys, *texts).alias(f"__{k}") for k, texts in forms.items()],
        *[hash_of(keys, *texts).alias(f"__to_{k}") for k, texts in wanted.items()]), "quote-hashes")
    asked = hashes.where((F.col("n_levels") > 0) & F.col(id_col).isNotNull()).select(
        id_col, *[F.col(f"__to_{k}").alias(f"__{k}") for k in forms])
    for k in forms:
        known = hashes.where(F.col(f"__{k}").isNotNull()).groupBy(f"__{k}").agg(F.min(id_col).alias(f"__by_{k}"))
        asked = asked.join(known, f"__{k}", "left")
    links = asked.groupBy(id_col).agg(F.min(F.coalesce(*[
        F.when(F.col(f"__by_{k}") < F.col(id_col), F.col(f"__by_{k}")) for k in forms])).alias("parent_id"))
    return parsed.drop("answered").join(links, id_col, "left")


def build_conversations(linked: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Adds ``conversation_id`` (the root's id), ``depth`` and ``position`` in reply order.

    Pointers to ancestors are doubled until all end at a root, so the number of rounds grows with the logarithm
    of the longest chain; messages whose pointer has arrived take no part in further rounds.  Messages are ordered by
    depth, then by id.  A NULL id is a conversation of its own at depth 0.  Rows that repeat an id take a position each.  Added columns
    replace columns of the same name; all others are kept.
    """
    linked = linked.drop("conversation_id", "depth", "position")
    own_id, own_up, own_depth = fresh(linked, "__id", "__up", "__depth")
    at = linked.select(F.col(id_col).alias("__id"), F.coalesce("parent_id", id_col).alias("__up")).where("__id is not null").distinct()
    moving = F.col("__id") != F.col("__up")
    at = stored(at.withColumns({"__depth": moving.cast("long"), "__moving": moving}), "quote-links")
    while not at.where("__moving").isEmpty():
        upper = at.select(F.col("__id").alias("__up"), F.col("__up").alias("__top"), F.col("__depth").alias("__more"))
        more = F.coalesce("__more", F.lit(0))
        moved = at.where("__moving").join(upper, "__up", "left").select(
            "__id", F.coalesce("__top", "__up").alias("__up"), (F.col("__depth") + more).alias("__depth"), (more > 0).alias("__moving"))
        at = stored(at.where("not __moving").unionByName(moved), "quote-links")
    at = at.select(F.col("__id").alias(own_id), F.col("__up").alias(own_up), F.col("__depth").alias(own_depth))
    placed = linked.join(at, F.col(id_col) == F.col(own_id), "left").withColumns({
        "conversation_id": F.coalesce(own_up, id_col), "depth": F.coalesce(own_depth, F.lit(0)).cast("long")})
    return number_rows(placed.drop(own_id, own_up, own_depth), [F.col("depth"), F.col(id_col)], ["conversation_id"], "position")


def as_mail(conversations: DataFrame, levels: int = 3) -> DataFrame:
    """Turns as messages that quote the turns before them, the nearest at level 1 and older ones deeper.

    ``message_id`` is the pair (conv_id, n), so a conversation may have any number of turns and any id.
    Turns are numbered by (turn, text), NULLs first; rows without a conv_id are one conversation.  A turn that repeats is a message of its
    own, a NULL text an empty message.  An empty table gives no rows.
    """
    numbered = number_rows(conversations.select("conv_id", "turn", "role", "text"), [F.col("turn"), F.col("text")], ["conv_id"], "n")
    sent = numbered.withColumn("k", F.explode(F.array(*map(F.lit, range(levels + 1))))).withColumn("n", F.col("n") + F.col("k"))
    mails = sent.groupBy("conv_id", "n").agg(*[
        F.max(F.when(F.col("k") == k, F.struct("role", "text", "turn"))).alias(f"m{k}") for k in range(levels + 1)])
    quoted = [F.concat(F.lit(">" * k + " "), F.regexp_replace(F.col(f"m{k}.text"), "\n", "\n" + ">" * k + " ")) for k in range(1, levels + 1)]
    return mails.where("m0 is not null").select(
        F.struct("conv_id", (F.col("n") + 1).alias("n")).alias("message_id"), "conv_id", F.col("m0.turn").alias("turn"),
        F.col("m0.role").alias("role"), F.concat_ws("\n", F.col("m0.text"), *quoted).alias("text"))


SQL = """
    WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations)
    SELECT concat_ws(':', conv_id, n) AS message_id, role, sha256(coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '')) AS own_sha256,
        least(n - 1, 3)::BIGINT AS n_levels, CASE WHEN n > 1 THEN concat_ws(':', conv_id, n - 1) END AS parent_id,
        concat_ws(':', conv_id, 1) AS conversation_id, n - 1 AS depth, n - 1 AS position FROM m"""


def printed_id(column: str) -> Column:
    """A pair (conv_id, n) as text, NULL without a message: no bound on either number, and no two pairs print alike."""
    return F.when(F.col(f"{column}.n").isNotNull(), F.concat_ws(":", f"{column}.conv_id", f"{column}.n")).alias(column)


@query("op2_chat_formatting", SQL)
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All turns, sent as messages that quote what they answer, put back into conversations."""
    mails = stored(as_mail(table(spark, folder, "conversations")), "mails")
    linked = link_quotes(mails, within=("conv_id",)).select(
        "message_id", "role", F.sha2("own_text", 256).alias("own_sha256"), "n_levels", "parent_id")
    return build_conversations(stored(linked, "quotes")).select(
        printed_id("message_id"), "role", "own_sha256", "n_levels", printed_id("parent_id"), printed_id("conversation_id"), "depth", "position")
