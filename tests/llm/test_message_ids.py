"""Message ids of the chat query are pairs, so no conversation reaches into the ids of another."""

from __future__ import annotations

from parlance.llm.quotes import as_mail, build_conversations, link_quotes, printed_id


def test_large_conversation_ids(spark):
    big = 9_000_000_000_000  # times 1048576 this exceeds a long
    rows = [(c, t, "user", f"turn {t} of {c}") for c in (1, 2, big) for t in range(5)]
    mails = as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = build_conversations(link_quotes(mails, within=("conv_id",))).collect()
    assert {(r.conv_id, r.turn, tuple(r.message_id), r.parent_id and tuple(r.parent_id), tuple(r.conversation_id), r.depth, r.position) for r in out} == {
        (c, t, (c, t + 1), (c, t) if t else None, (c, 1), t, t) for c in (1, 2, big) for t in range(5)}


def test_printed_ids_differ(spark):
    pairs = [(1, 1048577), (2, 1), (None, 1), (9_000_000_000_000, 2_000_000), (11, 1), (1, 11)]
    rows = spark.createDataFrame([(p,) for p in pairs] + [(None,)], "id struct<conv_id: long, n: long>")
    assert [r.id for r in rows.select(printed_id("id")).collect()] == ["1:1048577", "2:1", "1", "9000000000000:2000000", "11:1", "1:11", None]
