from __future__ import annotations

import pytest

from parlance.operators import chat

FIELDS = ["conv_id", "turn", "type", "role", "content", "parts", "name", "call_id", "arguments", "output", "tool_calls", "tool_call_id"]


def messages(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], chat.MESSAGES)


def text(conv, turn, role, content):
    return {"conv_id": conv, "turn": turn, "type": "message", "role": role, "content": content}


def shown(df):
    return [(r.conv_id, r.role, r.content) for r in df.orderBy("conv_id", "turn", "part").collect()]


def test_normalize(spark):
    got = chat.normalize(messages(
        spark, text(1, 0, "user", "hi"),
        {"conv_id": 1, "turn": 1, "type": "function_call", "name": "f", "call_id": "c1", "arguments": "{}"},
        {"conv_id": 1, "turn": 2, "type": "function_call_output", "call_id": "c1", "output": "out"},
        {"conv_id": 1, "turn": 3, "type": "message", "role": "assistant", "parts": ["x", "y"]},
        {"conv_id": 1, "turn": 4, "type": "message", "role": "assistant", "parts": []},
        {"conv_id": 1, "turn": 5, "type": "reasoning"},
    ))
    rows = got.orderBy("turn", "part").collect()
    assert [(r.turn, r.part, r.role, r.content, r.tool_call_id) for r in rows] == [
        (0, 0, "user", "hi", None), (1, 0, "assistant", "tool_call", None), (2, 0, "tool", "out", "c1"),
        (3, 0, "assistant", "x", None), (3, 1, "assistant", "y", None)]
    call = rows[1].tool_calls[0]
    assert (call.id, call.type, call.function.name, call.function.arguments) == ("c1", "function", "f", "{}")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_last_n_never_exceeds(spark, n):
    rows = chat.normalize(messages(spark, *[text(c, t, "user", str(t)) for c in (1, 2) for t in range(3 * c)]))
    got = shown(chat.last_n(rows, n))
    assert got == [(c, "user", str(t)) for c in (1, 2) for t in range(3 * c) if t >= 3 * c - n]


def test_default_prompt_only_where_no_system_row_leads(spark):
    rows = messages(spark, text(1, 0, "system", "own"), text(1, 1, "user", "a"), text(2, 0, "user", "b"), text(2, 1, "system", "late"))
    normal = chat.normalize(rows)
    assert shown(chat.with_system_prompt(normal, "P")) == [
        (1, "system", "own"), (1, "user", "a"), (2, "system", "P"), (2, "user", "b"), (2, "system", "late")]
    assert shown(chat.with_system_prompt(normal, "")) == shown(normal)
    # Cutting the history can drop the own prompt; then the default leads.
    assert shown(chat.with_system_prompt(chat.last_n(normal, 1), "P"))[:2] == [(1, "system", "P"), (1, "user", "a")]


def test_override_leads_and_replaces_the_default(spark):
    overrides = spark.createDataFrame([(1, "mine"), (2, None)], "conv_id bigint, prompt string")
    rows = chat.normalize(chat.with_overrides(messages(spark, text(1, 0, "user", "a"), text(2, 0, "user", "b")), overrides))
    assert shown(chat.with_system_prompt(rows, "P")) == [
        (1, "system", "mine"), (1, "user", "a"), (2, "system", "P"), (2, "user", "b")]


def test_outputs_take_the_first_convertible_message(spark):
    call = lambda i: (i, "function", ("{}", "f"))
    schema = (f"conv_id bigint, step bigint, turn bigint, type string, content string, parts array<string>, "
              f"tool_calls array<{chat.CALL}>, tool_call_id string")
    updates = spark.createDataFrame([
        (1, 0, 0, "human", "q", None, None, None), (1, 0, 1, "ai", "", None, [call("a"), call("b")], None),
        (1, 0, 2, "ai", "later", None, None, None),
        (1, 1, 0, "ai", "", None, [], None), (1, 1, 1, "tool", "result", None, None, "a"),
        (1, 2, 0, "ai", None, ["first", "second"], None, None),
        (1, 3, 0, "human", "q", None, None, None),
    ], schema)
    got = chat.output_items(updates).orderBy("step", "item").collect()
    assert [(r.step, r.type, r.text, r.name, r.call_id) for r in got] == [
        (0, "function_call", None, "f", "a"), (0, "function_call", None, "f", "b"),
        (1, "function_call_output", "result", None, "a"), (2, "message", "first", None, None)]


def test_final_text(spark):
    done = "response.output_item.done"
    events = spark.createDataFrame([
        (1, 0, done, "early", None), (1, 1, done, None, ["p", "last part"]), (1, 2, "response.created", "no", None),
        (2, 0, "response.created", "x", None)], "conv_id bigint, turn bigint, event string, content string, parts array<string>")
    assert [tuple(r) for r in chat.final_text(events).collect()] == [(1, "last part")]


def test_final_text_of_a_turn_with_several_items(spark):
    rows = [(1, 1, 2, "b"), (1, 1, 1, "z"), (1, 0, 9, "y")]
    events = spark.createDataFrame(rows, "conv_id bigint, turn bigint, item bigint, content string").selectExpr(
        "*", "cast(null as array<string>) parts", f"'{chat.ITEM_DONE}' event")
    assert chat.final_text(events, order=("turn", "item")).first().final_text == "b"
