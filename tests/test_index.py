from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.functions.models import embed_batch
from parlance.operators.index import build_index, compact_index, content_hashes, read_index, snapshot_changes, sync_index
from parlance.sources.tables import overwrite_table
from parlance.streaming.jobs import index_stream, read_stream


def docs(spark, pairs):
    return spark.createDataFrame(list(pairs), "id bigint, text string")


def state(df):
    return {r.id: (r.content_hash, [round(x, 9) for x in r.embedding] if r.embedding else None) for r in df.collect()}


def test_changes(spark):
    old, new = docs(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)]), docs(spark, [(2, "b"), (3, "C"), (4, None), (5, "e")])
    changes = snapshot_changes(*(content_hashes(d, "id", "text") for d in (old, new)), "id")
    assert {r.id: r.change for r in changes.collect()} == {1: "delete", 3: "update", 5: "insert"}


def test_sync_embeds_only_what_changed(spark, schema_name):
    table, calls = f"{schema_name}.idx", spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return embed_batch(texts)

    first = docs(spark, [(i, f"text {i}") for i in range(50)])
    assert sync_index(first, table, "id", "text", embed)
    assert calls.value == 50
    assert not sync_index(first, table, "id", "text", embed)
    assert calls.value == 50
    second = docs(spark, [(i, f"text {i}" if i != 7 else "other") for i in range(5, 52)])
    assert sync_index(second, table, "id", "text", embed)
    assert calls.value == 53
    assert state(read_index(spark, table)) == state(build_index(second, "id", "text"))
    assert not sync_index(second, table, "id", "text", embed)


def test_small_changes_leave_the_base_alone(spark, schema_name):
    table = f"{schema_name}.idx"
    rows = {i: f"text {i}" for i in range(100)}
    sync_index(docs(spark, rows.items()), table, "id", "text")
    for n in range(4):  # one key changes again and again, one goes and comes back
        rows[7] = f"version {n}"
        rows.pop(9) if 9 in rows else rows.update({9: "back"})
        assert sync_index(docs(spark, rows.items()), table, "id", "text")
        assert state(read_index(spark, table)) == state(build_index(docs(spark, rows.items()), "id", "text"))
    assert spark.table(table).where("id = 7").first().content_hash != read_index(spark, table).where("id = 7").first().content_hash
    compact_index(spark, table)
    assert not spark.catalog.tableExists(f"{table}__changes")
    assert state(spark.table(table)) == state(build_index(docs(spark, rows.items()), "id", "text"))


def test_partial_sync_keeps_other_keys(spark, schema_name):
    table = f"{schema_name}.idx"
    sync_index(docs(spark, [(1, "a"), (2, "b")]), table, "id", "text")
    sync_index(docs(spark, [(2, "B"), (3, "c")]), table, "id", "text", partial=True)
    assert state(read_index(spark, table)) == state(build_index(docs(spark, [(1, "a"), (2, "B"), (3, "c")]), "id", "text"))


def test_an_overwrite_cut_short_is_completed(spark, schema_name):
    table = f"{schema_name}.idx"
    overwrite_table(docs(spark, [(1, "a")]), table)
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}__old")  # where a lost driver may leave it
    overwrite_table(docs(spark, [(2, "b")]), table)
    assert [r.id for r in spark.table(table).collect()] == [2]


def test_stream_reaches_the_batch_state(spark, schema_name, tmp_path):
    table, folder, checkpoint = f"{schema_name}.idx", str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id bigint, text string, v bigint"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = read_stream(spark, folder, schema)
        query = index_stream(stream, table, "id", "text", checkpoint, order=F.col("v"))
        query.awaitTermination()
        assert query.exception() is None

    deliver([(1, "a", 1), (2, "b", 1), (2, "newer", 2)])
    deliver([(1, "again", 3), (3, "c", 3)])
    deliver([(3, "c", 4)])
    want = docs(spark, [(1, "again"), (2, "newer"), (3, "c")])
    assert state(read_index(spark, table)) == state(build_index(want, "id", "text"))


def test_missing_database_is_an_error(spark):
    with pytest.raises(Exception):
        sync_index(docs(spark, [(1, "a")]), "no_such_schema.idx", "id", "text")


def test_null_and_empty_text_differ(spark, schema_name):
    table = f"{schema_name}.idx"
    sync_index(docs(spark, [(1, None), (2, "")]), table, "id", "text")
    assert sync_index(docs(spark, [(1, ""), (2, None)]), table, "id", "text")
    assert state(read_index(spark, table)) == state(build_index(docs(spark, [(1, ""), (2, None)]), "id", "text"))


def test_stream_deletes(spark, schema_name, tmp_path):
    table, folder, checkpoint = f"{schema_name}.idx", str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id bigint, text string, v bigint, gone boolean"
    for rows in ([(1, "a", 1, False), (2, "b", 1, None), (3, "c", 1, False)], [(1, None, 2, True), (3, "x", 2, True), (3, "c", 3, False), (9, "", 2, True)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        index_stream(read_stream(spark, folder, schema), table, "id", "text", checkpoint, F.col("v"), deleted=F.col("gone")).awaitTermination()
    assert sorted(r.id for r in read_index(spark, table).collect()) == [2, 3]
