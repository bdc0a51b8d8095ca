"""Reading, writing and copying tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parlance.session import run_dir

# Quotes inside a value are doubled, and outer spaces belong to the value, both ways.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def quoted(name: str) -> str:
    """Every part of a dotted name in its own backticks."""
    return ".".join(f"`{part.strip('`')}`" for part in name.split("."))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema: no inference pass over the data."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(quoteAll=True, **_CSV).mode("overwrite").csv(path)


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> str:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name)}{where}")
    return name


def scratch_schema(spark: SparkSession, name: str) -> str:
    """A new schema whose tables lie in the shared folder."""
    folder = run_dir(spark, name)
    return create_schema(spark, folder.rsplit("/", 1)[1].replace("-", "_"), folder)


def create_table(spark: SparkSession, name: str, ddl: str, replace: bool = True) -> None:
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({ddl}) USING parquet")


def insert_rows(spark: SparkSession, name: str, rows: list[tuple]) -> None:
    """Appends inline rows with the table's own types."""
    spark.createDataFrame(rows, spark.table(quoted(name)).schema).write.mode("append").insertInto(quoted(name))


def own_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Properties that users set on a table; nothing for a table that does not exist."""
    if not spark.catalog.tableExists(quoted(name)):
        return {}
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()
    return {r["key"]: r["value"] for r in rows if not r["key"].startswith(("spark.sql.", "transient_", "option."))}


def overwrite_table(df: DataFrame, name: str, like: str | None = None) -> None:
    """Replaces a table, its schema included, also when ``df`` reads the table itself.

    Properties are those the table had, or those of the table ``like``.

    The result is written next to the table first and then swapped in by renames.  A run that
    was cut short between the renames is completed by the next one.
    """
    spark = df.sparkSession
    stage, old = f"{name}__stage", f"{name}__old"
    recover_table(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {quoted(stage)}")
    properties = own_properties(spark, like or name)
    df.write.format("parquet").saveAsTable(quoted(stage))
    if properties:
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {quoted(stage)} SET TBLPROPERTIES ({listed})")
    if spark.catalog.tableExists(quoted(name)):
        spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
    spark.sql(f"ALTER TABLE {quoted(stage)} RENAME TO {quoted(name)}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted(old)}")


def recover_table(spark: SparkSession, name: str) -> None:
    old = f"{name}__old"
    if spark.catalog.tableExists(quoted(old)):
        if spark.catalog.tableExists(quoted(name)):
            spark.sql(f"DROP TABLE {quoted(old)}")
        else:
            spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(name)}")


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").where(F.col("key") == key).select("value").first()
    return found[0] if found else None


def copy_tables(spark: SparkSession, source: str, target: str, skip_prefix: str = "t2t") -> list[tuple[str, str]]:
    """Copies each table of a schema unless its name has the prefix or the target has it already.

    Only names pass through the driver; each copy is a distributed write, finished under another
    name first, so a copy that was cut short is not taken for a finished one.
    """
    done = []
    for table in sorted(t.name for t in spark.catalog.listTables(quoted(source)) if not t.isTemporary):
        if table.startswith(skip_prefix):
            done.append((table, "skipped"))
        elif spark.catalog.tableExists(quoted(f"{target}.{table}")):
            done.append((table, "exists"))
        else:
            overwrite_table(spark.table(quoted(f"{source}.{table}")), f"{target}.{table}", f"{source}.{table}")
            done.append((table, "copied"))
    return done


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None when it does not exist; every other error is raised."""
    try:
        return spark.table(quoted(name)) if spark.catalog.tableExists(quoted(name)) else None
    except AnalysisException as problem:
        if "TABLE_OR_VIEW_NOT_FOUND" in str(problem):
            return None
        raise
