from __future__ import annotations

import pytest

from parlance.session import build_session, run_dir, shared_dir
from parlance.sizing import is_small, small_side, split_hot, spread
from parlance.sources import tables


def test_copy_skips_prefix_and_existing(spark):
    source, target = tables.scratch_schema(spark, "src"), tables.scratch_schema(spark, "tgt")
    for name, n in (("a", 3), ("b", 4), ("t2t_x", 5)):
        tables.overwrite_table(spark.range(n), f"{source}.{name}")
    tables.overwrite_table(spark.range(1), f"{target}.b")
    assert tables.copy_tables(spark, source, target) == [("a", "copied"), ("b", "exists"), ("t2t_x", "skipped")]
    assert spark.table(f"{target}.a").count() == 3 and spark.table(f"{target}.b").count() == 1
    assert not spark.catalog.tableExists(f"{target}.t2t_x")
    assert tables.copy_tables(spark, source, target)[0] == ("a", "exists")


def test_overwrite_reads_itself_and_changes_schema(spark, schema_name):
    name = f"{schema_name}.t"
    tables.overwrite_table(spark.range(5), name)
    tables.overwrite_table(spark.table(name).selectExpr("id", "id * 2 AS twice"), name)
    tables.overwrite_table(spark.table(name).where("id > 1"), name)
    assert sorted(map(tuple, spark.table(name).collect())) == [(2, 4), (3, 6), (4, 8)]


def test_typed_table_and_inline_rows(spark, schema_name):
    name = f"{schema_name}.docs"
    tables.create_table(spark, name, "id BIGINT, title STRING, tags ARRAY<STRING>, at TIMESTAMP")
    tables.insert_rows(spark, name, [(1, "x", ["a", "b"], None)])
    tables.insert_rows(spark, name, [(2, None, [], None)])
    assert [(r.id, r.title, r.tags) for r in spark.table(name).orderBy("id").collect()] == [(1, "x", ["a", "b"]), (2, None, [])]
    tables.create_table(spark, name, "id BIGINT")
    assert spark.table(name).count() == 0


def test_table_property(spark, schema_name):
    name = f"{schema_name}.p"
    spark.sql(f"CREATE TABLE {name} (id INT) USING parquet TBLPROPERTIES ('feed' = 'true')")
    assert tables.table_property(spark, name, "feed") == "true" and tables.table_property(spark, name, "x") is None


@pytest.mark.parametrize("value", ['say "hi"', ' lead', 'a,b', '""', "line\\"])
def test_csv_round_trip(spark, tmp_path, value):
    df = spark.createDataFrame([(1, value)], "id bigint, name string")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "id bigint, name string").first().name == value


def test_quoted_names():
    assert tables.quoted("a.b-c") == "`a`.`b-c`"


def test_size_checks(spark):
    df = spark.range(100).selectExpr("repeat('x', 1000) AS s")
    assert is_small(df, 100, 100_000) and not is_small(df, 99, 10**9) and not is_small(df, 100, 99_999)
    assert small_side(df, 10).count() == 100
    arrays = spark.range(10).selectExpr("array_repeat(1.5D, 1000) AS v")
    assert not is_small(arrays, 10, 10_000)


def test_split_hot(spark):
    df = spark.range(100).selectExpr("IF(id < 40, 0, id) AS k", "id")
    cold, hot = split_hot(df, "k", 30)
    assert cold.count() == 60 and hot.count() == 40
    assert split_hot(df, "k", 40)[1] is None


def test_spread_only_when_splits_are_few(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    wide = spark.range(100).repartition(20)
    assert spread(wide) is wide


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and run_dir(spark, "x").startswith(named)
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + named) or named in spark.sparkContext.getCheckpointDir()
    assert build_session().sparkContext is spark.sparkContext


def test_rewrites_keep_properties(spark, schema_name):
    from parlance.sources.tables import overwrite_table, own_properties

    name = f"{schema_name}.noted"
    spark.range(6).write.format("parquet").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('owner_note' = 'x')")
    overwrite_table(spark.table(name).where("id > 1"), name)
    assert own_properties(spark, name)["owner_note"] == "x" and spark.table(name).count() == 4
