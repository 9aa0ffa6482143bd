"""Cleaning, conditional columns, de-duplication, sampling and ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import hot_aware_left_join
from millrace.session import materialize


def full_name(full: Column, *parts: Column) -> Column:
    """The full name, else the distinct parts joined by blanks; null if there is none."""
    return F.coalesce(F.nullif(F.trim(full), F.lit("")), F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), " "), F.lit("")))


def joined_lines(*parts: Column) -> Column:
    """Present parts joined by line ends; null if all are null."""
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def any_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the first edge that is not below the value; null outside and for null."""
    out = F.when(value.isNull() | (value <= edges[0]), None)
    for hi, label in zip(edges[1:], labels):
        out = out.when(value <= hi, label)
    return out


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns ``column_value`` for each value, none left out."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def rare_to_other(df: DataFrame, column: str, least: int = 5, other: str = "other", none: str = "none") -> DataFrame:
    """Values of fewer than ``least`` rows become ``other``, nulls ``none``; counts come by partial aggregation and a join."""
    often = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    joined = hot_aware_left_join(df, often.withColumnRenamed("_v", column), [column])
    return joined.withColumn(column, F.when(F.col(column).isNull(), none).when(F.col("_n").isNull(), other).otherwise(F.col(column))).drop("_n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_n(df: DataFrame, key: str, order: str, value: str, n: int = 10) -> DataFrame:
    """``key, items``: the last ``n`` values of each key by ``order``, oldest first."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(value))
    rows = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable random order by the hash of a key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same on every run."""
    return shuffled(df, key, seed).limit(n)


def split_by_hash(df: DataFrame, key: str, share: float, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """``in_test``: a repeatable split by the hash of the key; a stratum enters the hash, so its values are split independently.

    Shares are met in expectation; no rank within a stratum is needed, so large strata cost nothing extra.
    """
    cols = [F.lit(seed), F.col(key)] + ([F.col(stratum)] if stratum else [])
    return df.withColumn("in_test", F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < int(share * 1_000_000))


def null_counts(df: DataFrame) -> DataFrame:
    """``column_name, nulls``: one pass over all columns."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(f"`{c}`") for c in df.columns]))).alias("column_name", "nulls"))


def shared_values(left: DataFrame, right: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of either side whose value occurs on both."""
    both = left.select(column).intersect(right.select(column)).dropna()
    return left.join(both, column, "left_semi"), right.join(both, column, "left_semi")


def rank_of(column: Column, order: Sequence[str]) -> Column:
    """Position in a declared order, 0 for other values: sorts labels by declaration instead of alphabet."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0))


def zero_filled(df: DataFrame, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """One row for each of ``values``, with 0 where ``df`` has none."""
    fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return fixed.join(df, column, "left").select(column, F.coalesce(measure, F.lit(0)).alias(measure))


def translate(column: Column, labels: Mapping[str, str], default: str) -> Column:
    """Value to label by a small dictionary."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, column), F.lit(default))


def running_sums(df: DataFrame, order: Sequence[str | Column], names: Sequence[str]) -> DataFrame:
    """``running_name`` for each of ``names`` (columns without nulls): the sum over all rows up to the row in a global order.

    Rows are cut into ranges of the order and summed by range; the sums of earlier ranges are added (as many rows as there are
    ranges), and only within a range is a running sum taken, so no task sees all rows. Ties need a further order column.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "running")
    totals = rows.groupBy("_p").agg(*[F.sum(n).cast("double").alias(n) for n in names]).collect()  # one row a range
    before, seen = [], [0.0] * len(names)
    for r in sorted(totals, key=lambda r: r["_p"]):
        before.append((r["_p"], *seen))
        seen = [a + r[n] for a, n in zip(seen, names)]
    base = F.broadcast(spark.createDataFrame(before, "_p int, " + ", ".join(f"_b{i} double" for i in range(len(names)))))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(base, "_p")
    return joined.select(*df.columns, *[(F.col(f"_b{i}") + F.sum(n).over(w)).alias(f"running_{n}") for i, n in enumerate(names)])


def runs(df: DataFrame, order: Sequence[str], hit: Column) -> DataFrame:
    """Stretches of consecutive rows without a hit: ``run, rows, start_at, end_at`` by the first order column."""
    marked = running_sums(df.select(*order, hit.cast("int").alias("_hit")), order, ["_hit"]).withColumn("run", F.col("running__hit").cast("long"))
    return marked.where("_hit = 0").groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.min(order[0]).alias("start_at"), F.max(order[0]).alias("end_at"))
