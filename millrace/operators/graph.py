"""Connected components by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import hot_aware_join
from millrace.session import materialize, release


def minimum_labels(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of the undirected ``links`` (columns ``a``, ``b``): label is the component's smallest node.

    Each round lets every node hand the smallest label it knows to its larger neighbours, then to its smaller ones (large-star
    and small-star), which needs a logarithmic number of rounds even on long chains. Hubs are joined hot-aware. Nulls and
    self-links are ignored; nodes without a link to another have no row. Works on any ordered type.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    n = edges.count()
    seen = None
    for _ in range(max_rounds):
        if n == 0:
            break
        # large star: larger neighbours of u are linked to the smallest node next to u
        both = edges.union(edges.select("v", "u"))
        small = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "smallest")
        large = hot_aware_join(both, small, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        # small star: smaller neighbours of u, and u, are linked to the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        joined = hot_aware_join(large, low, ["u"], "n", max(n, 1))
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, materialize(new, "edges")
        release(old, small, large, low)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        n = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
