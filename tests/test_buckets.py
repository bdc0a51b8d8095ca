from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.operators.cells import CellIndex
from parlance.plans import ORACLES, QUERIES
from parlance.session import run_dir
from parlance.sources.buckets import BucketTable, bucket_of, merge

SCHEMA = "k string, v long"


def state(table, version=None):
    return sorted(((r.k, r.v) for r in table.read(version).collect()), key=repr)


def test_merge_keeps_untouched_files(spark):
    table = BucketTable(spark, run_dir(spark, "merge"))
    rows = [(f"key{n}", n) for n in range(60)] + [(None, 7)]
    merge(table, spark.createDataFrame(rows, SCHEMA), "k", [F.col("v")], buckets=12)
    before = set(table._glob("data/version__=*/bucket=*/part-*"))
    incoming = spark.createDataFrame([("key3", 300), ("key3", 200), (None, 8), (None, 9), ("new", 1)], SCHEMA)
    merge(table, incoming, "k", [F.col("v")], buckets=12)
    touched = {r[0] for r in incoming.select(bucket_of(F.col("k"), 12)).collect()}
    after = {r["bucket"]: r["v"] for r in table.manifest()}
    assert {b for b, v in after.items() if v == 2} == touched and len(touched) < len(after)
    assert before <= set(table._glob("data/version__=*/bucket=*/part-*"))  # no file was moved or renamed
    expected = dict(rows) | {"key3": 200, None: 8, "new": 1}
    assert state(table) == sorted(expected.items(), key=repr) and state(table, 1) == sorted(rows, key=repr)
    merge(table, incoming, "k", [F.col("v")], buckets=12)
    assert state(table) == sorted(expected.items(), key=repr)


def test_unfinished_version_is_ignored(spark):
    table = BucketTable(spark, run_dir(spark, "merge"))
    first = spark.createDataFrame([("a", 1)], SCHEMA)
    merge(table, first, "k", [F.col("v")], buckets=4)
    # A run that ended before its manifest was complete.
    first.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.folder}/data/version__=2")
    assert table.versions() == [1] and state(table) == [("a", 1)]
    merge(table, spark.createDataFrame([("b", 2)], SCHEMA), "k", [F.col("v")], buckets=4)
    assert state(table) == [("a", 1), ("b", 2)]


def test_emptied_bucket_and_vacuum(spark):
    table = BucketTable(spark, run_dir(spark, "merge"))
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], SCHEMA + ", bucket int")
    table.replace(rows)
    table.replace(rows.where("false"), touched=[1])
    assert state(table) == [("a", 1), ("c", 3)] and table.changed_buckets(1, 2) == [1]
    assert any("version__=1/bucket=1" in p for p in table.vacuum())
    assert table.versions() == [2] and state(table) == [("a", 1), ("c", 3)]


def test_feed_replays_to_the_current_index(spark):
    index = CellIndex(spark, run_dir(spark, "feed"), "k")
    states = [{n: f"text {n % 7}" for n in range(40)}]
    states.append({n: t for n, t in states[0].items() if n % 9} | {100: "new", 3: "changed"})
    states.append(states[1] | {0: "back", 100: "again"})
    for s in states:
        index.sync(spark.createDataFrame(list(s.items()), "k long, t string"), text_col="t")
    versions = index.rows.versions()
    assert len(versions) == 3
    at = {v: {r.k: r.content_hash for r in index.rows.read(v).collect()} for v in versions}
    for old, new in zip(versions, versions[1:]):
        replayed = dict(at[old])
        for r in index.rows.changes_between(old, new, "k").collect():
            if r.change == "delete":
                del replayed[r.k]
            else:
                assert (r.change == "insert") == (r.k not in replayed)
                replayed[r.k] = at[new][r.k]
        assert replayed == at[new]
    assert set(at[versions[-1]]) == set(states[-1])


@pytest.mark.parametrize("name", ["eval_scores", "run_compare"])
def test_repeated_turns_meet_every_neighbour(spark, tmp_path, name):
    rows = [(1, 0, "user", "what is that bill"), (1, 0, "user", "what is the other bill"), (1, 1, "assistant", "that bill is late"), (1, 1, "assistant", "no bill"),
            (1, 2, "user", "thanks http"), (2, 0, "system", "be kind"), (2, 1, "user", "hello you"), (2, 2, "assistant", "hello http you"), (3, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    expected = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found.fetchall()), key=repr)
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got), key=repr) == expected
    assert len(expected) == (4 if name == "run_compare" else 10)
