"""Sources: delimited text, JSON documents, alias-resolved records, parameterised SQL, streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Tab-separated text without header and without quoting."""
    return spark.read.csv(path, sep="\t", quote="", schema=schema)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with header; quoted fields may hold line ends. The schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_history(df: DataFrame, time: str, message: str, limit: int | None = None) -> DataFrame:
    """Rows with a time and a message that is not blank; the ``limit`` earliest of them (ties by message)."""
    rows = df.where(F.col(time).isNotNull() & (F.trim(F.coalesce(message, F.lit(""))) != ""))
    return rows.orderBy(time, message).limit(limit) if limit else rows


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column for each key: the first of its aliases (compared without case) that holds a value; null if none exists."""
    have = {c.lower(): c for c in df.columns}

    def column(names: Sequence[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[column(names).alias(key) for key, names in aliases.items()])


def clean_cells(df: DataFrame) -> DataFrame:
    """Text cells without outer blanks, blank ones null; whole numbers read as doubles lose their ``.0``."""
    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            return F.nullif(F.regexp_replace(F.trim(c), r"^(-?\d+)\.0$", "$1"), F.lit("")).alias(name)
        return c.alias(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """SQL with named parameters, bound and never pasted into the text."""
    return spark.sql(sql, args=args)


def catalog_sizes(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Bytes of the files behind each table, from the optimizer's statistics."""
    return {name: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) for name, df in tables.items()}


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
