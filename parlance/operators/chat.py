"""Chat histories as tables: one row per message, all conversations at once.

Input messages have ``conv_id``, ``turn``, ``type`` and the fields of that type: ``role``,
``content``, ``parts`` (list content), ``name``, ``call_id``, ``arguments``, ``output``, ``tool_calls``,
``tool_call_id``.  ``part`` orders the rows that one message becomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sizing import top_n

# Type names of the chat protocol.
FUNCTION_CALL, FUNCTION_OUTPUT, MESSAGE = "function_call", "function_call_output", "message"
FUNCTION, TOOL_CALL, ITEM_DONE = "function", "tool_call", "response.output_item.done"

CALL = "struct<id:string, type:string, function:struct<arguments:string, name:string>>"
ROW = f"struct<role:string, content:string, name:string, tool_calls:array<{CALL}>, tool_call_id:string>"
MESSAGES = (
    "conv_id bigint, turn bigint, type string, role string, content string, parts array<string>, name string, "
    f"call_id string, arguments string, output string, tool_calls array<{CALL}>, tool_call_id string"
)


def _row(role: Column, content: Column, name: Column | None = None, calls: Column | None = None,
         call_id: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        role.alias("role"), content.alias("content"), (none if name is None else name).alias("name"),
        (none if calls is None else calls).alias("tool_calls"), (none if call_id is None else call_id).alias("tool_call_id"),
    ).cast(ROW)


def normalize(messages: DataFrame) -> DataFrame:
    """Chat rows: conv_id, turn, part, role, content, name, tool_calls, tool_call_id.

    A function call becomes an assistant row with one tool call, a function output a tool row, list
    content one row per part; other messages keep their five chat fields, and nothing is left of
    a message that has none of them.
    """
    call = F.struct(
        F.col("call_id").alias("id"), F.lit(FUNCTION).alias("type"),
        F.struct(F.col("arguments").alias("arguments"), F.col("name").alias("name")).alias("function"),
    )
    fields = ["role", "content", "name", "tool_calls", "tool_call_id"]
    nothing = F.expr(" AND ".join(f"{f} IS NULL" for f in fields))
    rows = (
        F.when(F.col("type") == FUNCTION_CALL,
               F.array(_row(F.lit("assistant"), F.lit(TOOL_CALL), calls=F.array(call))))
        .when((F.col("type") == MESSAGE) & F.col("parts").isNotNull(),
              F.transform("parts", lambda text: _row(F.col("role"), text)))
        .when(F.col("type") == FUNCTION_OUTPUT,
              F.array(_row(F.lit("tool"), F.col("output"), call_id=F.col("call_id"))))
        .when(~nothing, F.array(_row(*[F.col(f) for f in fields])))
    )
    return messages.select("conv_id", "turn", F.posexplode(rows).alias("part", "row")).select(
        "conv_id", "turn", F.col("part").cast("long").alias("part"), "row.*")


def last_n(rows: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` rows of each conversation; each is cut down before the shuffle."""
    return top_n(rows, ["conv_id"], [F.col("turn").desc(), F.col("part").desc()], n, "__back").drop("__back")


def with_system_prompt(rows: DataFrame, prompt: str | None) -> DataFrame:
    """Puts the default prompt first unless the first row of the conversation is a system row.

    Meant for rows after ``last_n``: that shuffle is reused, and the window is at most n rows wide.
    """
    if not prompt:
        return rows
    order = Window.partitionBy("conv_id").orderBy("turn", "part")
    own = F.struct("turn", "part", "role", "content", "name", "tool_calls", "tool_call_id")
    added = F.struct(F.col("turn"), F.lit(-1).cast("long").alias("part"), _row(F.lit("system"), F.lit(prompt)).alias("r"))
    added = F.struct("turn", added["part"].alias("part"), *[added["r"][f].alias(f) for f in
                                                        ["role", "content", "name", "tool_calls", "tool_call_id"]])
    first = (F.col("__n") == 1) & ~F.coalesce(F.col("role") == "system", F.lit(False))
    out = F.when(first, F.array(added, own)).otherwise(F.array(own))
    return rows.withColumn("__n", F.row_number().over(order)).select("conv_id", F.explode(out).alias("m")).select(
        "conv_id", "m.*")


def with_overrides(messages: DataFrame, overrides: DataFrame) -> DataFrame:
    """A system message in front of each conversation that has a prompt of its own (conv_id, prompt)."""
    system = overrides.where(F.col("prompt").isNotNull()).select(
        "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(MESSAGE).alias("type"), F.lit("system").alias("role"),
        F.col("prompt").alias("content"))
    return messages.unionByName(system, allowMissingColumns=True)


def output_items(updates: DataFrame) -> DataFrame:
    """What each update (conv_id, step) puts out: conv_id, step, item, type, text, name, call_id, arguments.

    Within an update only the first convertible message counts: an assistant message with tool
    calls (one item per call), an assistant message with text, or a tool result.
    """
    has_calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    text = F.coalesce(F.col("content"), F.element_at(F.when(F.size("parts") > 0, F.col("parts")), 1))
    is_ai, is_tool = F.col("type") == "ai", F.col("type") == "tool"
    usable = (is_ai & (has_calls | (F.coalesce(text, F.lit("")) != ""))) | is_tool
    first = top_n(updates.where(usable), ["conv_id", "step"], [F.col("turn")], 1, "__first")

    item = "struct<type:string, text:string, name:string, call_id:string, arguments:string>"
    none = F.lit(None)
    calls = F.transform("tool_calls", lambda c: F.struct(
        F.lit(FUNCTION_CALL), none, c["function"]["name"], c["id"], c["function"]["arguments"]).cast(item))
    items = (
        F.when(is_ai & has_calls, calls)
        .when(is_ai, F.array(F.struct(F.lit(MESSAGE), text, none, none, none).cast(item)))
        .otherwise(F.array(F.struct(F.lit(FUNCTION_OUTPUT), F.col("content"), none, F.col("tool_call_id"), none)
                           .cast(item)))
    )
    return first.select("conv_id", "step", F.posexplode(items).alias("item", "o")).select(
        "conv_id", "step", F.col("item").cast("long").alias("item"), "o.*")


def final_text(events: DataFrame, done: str = ITEM_DONE, order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """conv_id and the text of the last finished item: its content, or for list content its last part.

    ``order`` names the columns that order the events, for instance turn and item; equal ones are ordered by text.
    """
    text = F.coalesce(F.element_at(F.when(F.size("parts") > 0, F.col("parts")), -1), F.col("content"))
    return events.where(F.col("event") == done).groupBy("conv_id").agg(F.max_by(text, F.struct(*order, text)).alias("final_text"))
