"""Chat histories.  The plain turns are recast so that every message type occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import chat
from parlance.plans.registry import Tables, query

PROMPT = "You help customers. Use only what the tools return."
LAST = 4

_KIND = """CASE WHEN role = 'assistant' AND contains(text, chr(10)) THEN 'parts'
    WHEN role = 'assistant' AND contains(text, 'ing') THEN 'call'
    WHEN role = 'user' AND contains(text, 'ion') THEN 'output' ELSE 'plain' END"""
_CALL_ID = "concat('call_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING))"


def _messages(t: Tables) -> DataFrame:
    kind, text = F.col("kind"), F.col("text")
    turns = t.conversations.withColumn("kind", F.expr(_KIND)).withColumn("id", F.expr(_CALL_ID))
    is_tool = kind.isin("call", "output")
    return turns.select(
        "conv_id", "turn",
        F.when(kind == "call", "function_call").when(kind == "output", "function_call_output").otherwise("message").alias("type"),
        F.when(~is_tool, F.col("role")).alias("role"),
        F.when(kind == "plain", text).alias("content"),
        F.when(kind == "parts", F.split(text, "\n")).alias("parts"),
        F.when(kind == "call", "lookup").alias("name"),
        F.when(is_tool, F.col("id")).alias("call_id"),
        F.when(kind == "call", F.to_json(F.struct(F.length(text).alias("n")))).alias("arguments"),
        F.when(kind == "output", text).alias("output"),
        F.lit(None).cast(f"array<{chat.CALL}>").alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"),
    )


def _flat(rows: DataFrame) -> DataFrame:
    call = F.element_at(F.when(F.size("tool_calls") > 0, F.col("tool_calls")), 1)
    return rows.select("conv_id", "turn", "part", "role", "content", call["function"]["name"].alias("tool"),
                       call["function"]["arguments"].alias("arguments"), F.coalesce(call["id"], "tool_call_id").alias("call_id"))


_NORMAL = f"""
    k AS (SELECT *, {_KIND} AS kind, {_CALL_ID} AS id FROM conversations),
    n AS (
        SELECT conv_id, turn, 0 AS part, 'assistant' AS role, 'tool_call' AS content, 'lookup' AS tool,
               '{{"n":' || length(text) || '}}' AS arguments, id AS call_id FROM k WHERE kind = 'call'
        UNION ALL SELECT conv_id, turn, 0, 'tool', text, NULL, NULL, id FROM k WHERE kind = 'output'
        UNION ALL SELECT conv_id, turn, 0, role, text, NULL, NULL, NULL FROM k WHERE kind = 'plain'
        UNION ALL SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1, role,
                         unnest(string_split(text, chr(10))), NULL, NULL, NULL FROM k WHERE kind = 'parts')"""


@query(f"WITH {_NORMAL} SELECT * FROM n")
def chat_normalize(t: Tables) -> DataFrame:
    return _flat(chat.normalize(_messages(t)))


@query(f"""WITH {_NORMAL}
    SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, part DESC) <= {LAST}""")
def chat_last_n(t: Tables) -> DataFrame:
    return _flat(chat.last_n(chat.normalize(_messages(t)), LAST))


@query(f"""
    WITH {_NORMAL},
    o AS (SELECT * FROM n UNION ALL
          SELECT item_id, -1, 0, 'system', text, NULL, NULL, NULL FROM benchmark WHERE item_id IN (SELECT conv_id FROM conversations)),
    l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, part DESC) <= {LAST}),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) = 1)
    SELECT * FROM l UNION ALL
    SELECT conv_id, turn, -1, 'system', '{PROMPT}', NULL, NULL, NULL FROM f WHERE role <> 'system'""")
def chat_system_prompt(t: Tables) -> DataFrame:
    """Some conversations bring a prompt of their own; history is cut first, then the default is put in front."""
    overrides = t.benchmark.select(F.col("item_id").alias("conv_id"), F.col("text").alias("prompt"))
    overrides = overrides.join(t.conversations.select("conv_id"), "conv_id", "left_semi")
    rows = chat.last_n(chat.normalize(chat.with_overrides(_messages(t), overrides)), LAST)
    return _flat(chat.with_system_prompt(rows, PROMPT))


@query(f"""
    WITH k AS (SELECT *, {_KIND} AS kind, turn // 2 AS step FROM conversations),
    f AS (SELECT * FROM k WHERE (role = 'assistant' AND text <> '') OR kind = 'output'
          QUALIFY row_number() OVER (PARTITION BY conv_id, step ORDER BY turn) = 1),
    c AS (SELECT conv_id, step, generate_subscripts(s, 1) - 1 AS item, 'function_call' AS type, NULL AS text, 'lookup' AS name,
                 'call_' || unnest(s) AS call_id, '{{"n":' || length(text) || '}}' AS arguments
          FROM (SELECT *, string_split(text, 'ing') AS s FROM f WHERE kind = 'call'))
    SELECT * FROM c UNION ALL
    SELECT conv_id, step, 0, 'message', string_split(text, chr(10))[1], NULL, NULL, NULL FROM f WHERE kind = 'parts' UNION ALL
    SELECT conv_id, step, 0, 'message', text, NULL, NULL, NULL FROM f WHERE kind = 'plain' UNION ALL
    SELECT conv_id, step, 0, 'function_call_output', text, NULL, 'call_' || conv_id, NULL FROM f WHERE kind = 'output'""")
def chat_outputs(t: Tables) -> DataFrame:
    """Each question with its answer is one update; an answer may hold several tool calls."""
    turns = t.conversations.withColumn("kind", F.expr(_KIND))
    kind, text = F.col("kind"), F.col("text")
    arguments = F.to_json(F.struct(F.length(text).alias("n")))
    calls = F.transform(F.split(text, "ing"), lambda piece: F.struct(
        F.concat(F.lit("call_"), piece), F.lit("function"), F.struct(arguments, F.lit("lookup"))).cast(chat.CALL))
    updates = turns.select(
        "conv_id", F.floor(F.col("turn") / 2).alias("step"), "turn",
        F.when(F.col("role") == "assistant", "ai").when(kind == "output", "tool").otherwise("human").alias("type"),
        F.when(kind != "parts", text).alias("content"), F.when(kind == "parts", F.split(text, "\n")).alias("parts"),
        F.when(kind == "call", calls).alias("tool_calls"),
        F.when(kind == "output", F.concat(F.lit("call_"), F.col("conv_id").cast("string"))).alias("tool_call_id"))
    return chat.output_items(updates)


@query("""
    SELECT conv_id, list_extract(string_split(text, chr(10)), -1) AS final_text FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def chat_final_text(t: Tables) -> DataFrame:
    events = t.conversations.select(
        "conv_id", "turn", F.split("text", "\n").alias("parts"), F.lit(None).cast("string").alias("content"),
        F.when(F.col("role") == "assistant", "response.output_item.done").otherwise("response.created").alias("event"))
    return chat.final_text(events)
