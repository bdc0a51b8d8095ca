"""Name lists: union, cleaning, correction, copying of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.names import clean_names, correct_names, union_names
from parlance.plans.registry import Tables, query
from parlance.session import run_dir
from parlance.sizing import number_rows
from parlance.sources import tables as sources

_DIRTY = """CASE p_type WHEN 'ECONOMY' THEN concat('""', p_name, '"" "') WHEN 'SMALL' THEN concat('"', p_name, '" ')
    WHEN 'PROMO' THEN concat(' "', p_name, '"') ELSE concat(p_name, '  "') END"""
_DAMAGED = """CASE p_type WHEN 'ECONOMY' THEN substr(p_name, 2) WHEN 'SMALL' THEN replace(p_name, 'e', 'a')
    WHEN 'PROMO' THEN concat(upper(substr(p_name, 1, 4)), substr(p_name, 5)) WHEN 'STANDARD' THEN 'qqq'
    ELSE replace(replace(p_name, ' ', ''), 'i', 'yy') END"""


@query("SELECT c_name AS cust_name FROM customer UNION ALL SELECT s_name FROM supplier")
def name_union(t: Tables) -> DataFrame:
    return union_names((t.customer, "c_name"), (t.supplier, "s_name"))


@query(f"""
    SELECT p_partkey AS id, rtrim(regexp_replace(regexp_replace(d, '^"*', ''), '"* *"*$', '')) AS cust_name
    FROM (SELECT p_partkey, {_DIRTY} AS d FROM part)""")
def csv_clean_names(t: Tables) -> DataFrame:
    """Names with stray quotes go through a CSV file and come back clean and sorted."""
    path = run_dir(t.spark, "csv_clean_names")
    sources.write_csv(t.part.select(F.col("p_partkey").alias("id"), F.expr(_DIRTY).alias("cust_name")), path)
    return clean_names(sources.read_csv(t.spark, path, "id bigint, cust_name string"))


@query(f"""
    WITH RECURSIVE w AS (SELECT p_partkey, {_DAMAGED} AS word FROM part),
    n AS (SELECT DISTINCT p_name AS entry FROM part),
    dp AS (
        SELECT word, entry, 0 AS j, list_transform(range(length(word)), lambda x: 0::BIGINT) AS r
        FROM (SELECT DISTINCT word FROM w) CROSS JOIN n
        UNION ALL
        SELECT word, entry, j + 1, list_transform(range(1, length(word) + 1), lambda i:
            list_max(list_transform(range(1, i + 1), lambda h: greatest(r[h],
                CASE WHEN substr(word, h, 1) = substr(entry, j + 1, 1) THEN coalesce(r[h - 1], 0) + 1 ELSE 0 END))))
        FROM dp WHERE j < length(entry)),
    best AS (
        SELECT word, entry, ratio, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, entry) AS rn FROM (
            SELECT word, entry, (400 * list_max(r) + length(word) + length(entry)) // (2 * (length(word) + length(entry))) AS ratio
            FROM dp WHERE j = length(entry)) WHERE ratio > 70)
    SELECT p_partkey, w.word, entry AS corrected, coalesce(ratio, 0) AS ratio FROM w LEFT JOIN best ON best.word = w.word AND rn = 1""")
def fuzzy_correct(t: Tables) -> DataFrame:
    damaged = t.part.select("p_partkey", F.expr(_DAMAGED).alias("word"))
    dictionary = number_rows(t.part.select(F.col("p_name").alias("entry")).distinct(), [F.col("entry")], number_col="position")
    return correct_names(damaged, "word", dictionary).select(
        "p_partkey", "word", "corrected", F.coalesce("ratio", F.lit(0)).cast("long").alias("ratio"))


@query("""
    SELECT 'customer' AS table_name, 'copied' AS state, count(*) AS n_rows FROM customer UNION ALL
    SELECT 'nation', 'copied', count(*) FROM nation UNION ALL
    SELECT 'region', 'exists', count(*) FROM region UNION ALL
    SELECT 't2t_supplier', 'skipped', 0""")
def copy_tables(t: Tables) -> DataFrame:
    """A schema is copied without the excluded prefix; a table that is there already is left alone."""
    source, target = (sources.scratch_schema(t.spark, name) for name in ("copy_source", "copy_target"))
    for name, df in (("customer", t.customer), ("nation", t.nation), ("region", t.region), ("t2t_supplier", t.supplier)):
        sources.overwrite_table(df, f"{source}.{name}")
    sources.overwrite_table(t.region, f"{target}.region")
    states = dict(sources.copy_tables(t.spark, source, target))
    counts = [
        (t.spark.table(f"{target}.{name}") if state != "skipped" else t.supplier.limit(0))
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("table_name"), F.lit(state).alias("state"), "n_rows")
        for name, state in states.items()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result
