"""Sinks: files, keyed upserts as whole rewrites, event logs, models and table bootstrap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table into a folder of its own, replacing what was there."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).option("escape", '"').csv(f"{folder}/{name}") if kind == "csv" else writer.format(kind).save(f"{folder}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept and NaN as null."""
    clean = [F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``current`` with rows of ``changes`` inserted or put in place of those with equal keys; the newest ``version`` of a key wins.

    Ties go to ``changes``. The result is a new table: plain files know no update in place.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "_new")


def replace_table(df: DataFrame, path: str) -> None:
    """Delete all rows and write the new ones as one commit."""
    df.write.mode("overwrite").parquet(path)


def create_tables(spark: SparkSession, schemas: Mapping[str, str], seed: Mapping[str, DataFrame] | None = None) -> None:
    """Create missing tables of the catalog; seed rows go into tables that are empty, so that a second run changes nothing."""
    for name, ddl in schemas.items():
        spark.sql(f"create table if not exists {name} ({ddl}) using parquet")
    for name, rows in (seed or {}).items():
        if spark.table(name).isEmpty():
            rows.select(*spark.table(name).columns).write.mode("append").insertInto(name)


def save_model(model: object, path: str) -> None:
    model.write().overwrite().save(path)
