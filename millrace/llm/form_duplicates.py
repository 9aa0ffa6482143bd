"""Problem 3: records that differ only in form (white space, case, punctuation, order of the fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import reduced
from millrace.operators.skew import digest, hot_aware_join, members_of_groups
from millrace.session import materialize


def encode_fields(df: DataFrame, group: str, id_col: str, text_col: str, separator: str = r"\|") -> DataFrame:
    """``group, id, fields``: each row as the sorted tuple of integer ids of its canonical field values.

    The column of field values is dictionary-encoded: each distinct value is canonicalised once (reduced text) and gets a
    128-bit integer drawn from the canonical value, so that ids need no counter shared by tasks and come out the same when a
    task is run again. Records then carry integers only. Values that occur in many records are joined hot-aware.
    Null texts have no row; fields that reduce to nothing (blank, only punctuation) don't count, so such texts have an empty tuple.
    """
    base = df.select(F.col(group), F.col(id_col).alias("id"), F.col(text_col).alias("_t")).where("_t is not null").withColumn("_row", F.monotonically_increasing_id())
    parts = base.select(group, "id", "_row", F.explode(F.split("_t", separator)).alias("_p"))
    values = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    dictionary = values.withColumn("_c", reduced(F.col("_p"))).select(
        *digest(F.col("_p")), F.when(F.col("_c") != "", F.struct(*digest(F.col("_c")))).alias("value_id"), "n"
    )
    dictionary = materialize(dictionary, "dictionary")
    coded = parts.select(group, "id", "_row", *digest(F.col("_p")))
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    joined = hot_aware_join(coded, dictionary, ["k1", "k2"], "n", total)
    return joined.groupBy(group, "id", "_row").agg(F.sort_array(F.collect_list("value_id")).alias("fields")).drop("_row")


def collapse(df: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """``group, id, rep_id, copies`` for every record of a set of at least two that consist of the same parts within ``group``.

    ``rep_id`` is the smallest id of the set and ``copies`` its size; the representative has a row too. Repeated rows of one
    id count once each. Null texts take no part; texts without any letter, mark or digit form one set.
    """
    keyed = encode_fields(df, group, id_col, text_col).select(group, "id", *digest(F.col("fields")))
    return members_of_groups(keyed, [group, "k1", "k2"], "id").select(group, "id", "rep_id", "copies")
