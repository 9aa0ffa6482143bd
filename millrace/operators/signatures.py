"""Template signatures of texts and what is reported about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import signature_hash, template_v2
from millrace.operators.relational import last_n
from millrace.session import materialize


def extract(df: DataFrame, key: str, text: str, ts: str, least: int = 1, samples: int = 10) -> DataFrame:
    """``signature_hash, pattern, occurrence, first_seen, last_seen, sample_ids``: one row for each template, by event time.

    A second run over the same rows gives the same table. Null texts have no signature.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, ts, template_v2(F.col(text)).alias("pattern"))
    rows = materialize(rows.where("pattern <> ''").withColumn("signature_hash", signature_hash(F.col("pattern"))), "patterns")
    base = rows.groupBy("signature_hash", "pattern").agg(F.count(F.lit(1)).alias("occurrence"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")).where(F.col("occurrence") >= least)
    return base.join(last_n(rows, "signature_hash", ts, key, samples).withColumnRenamed("items", "sample_ids"), "signature_hash")


def coverage(signatures: DataFrame, submissions: int, least: int = 3) -> DataFrame:
    """Share of all rows that repeated patterns account for, in percent; it can pass 100 when counters were added twice."""
    return signatures.agg(F.coalesce(F.sum(F.when(F.col("occurrence") >= least, F.col("occurrence"))), F.lit(0)).alias("covered")).select(
        "covered", F.round(F.col("covered") * 100.0 / F.lit(max(submissions, 1)), 2).alias("coverage")
    )


def members(clusters: DataFrame, signatures: DataFrame) -> DataFrame:
    """``cluster_id, signature_id, occurrence``: the nested lists of clusters as a join table."""
    return clusters.select(F.col("id").alias("cluster_id"), F.explode("signature_ids").alias("signature_id")).join(signatures.select(F.col("id").alias("signature_id"), "occurrence"), "signature_id")


def compression(signatures: DataFrame) -> DataFrame:
    """Rows, distinct templates, and rows for each template."""
    return signatures.agg(F.sum("occurrence").alias("total"), F.count(F.lit(1)).alias("patterns")).select("total", "patterns", F.try_divide(F.col("total").cast("double"), F.col("patterns")).alias("ratio"))
