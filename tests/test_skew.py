import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import graph, skew


def hot(spark):
    r = random.Random(3)
    return [("hot" if i % 3 == 0 else f"k{i % 400}", r.randrange(-(2**40), 2**40)) for i in range(9000)]


def test_exact_quantiles_of_hot_and_cold_keys(spark):
    rows = hot(spark)
    df = spark.createDataFrame(rows + [(None, 5), ("hot", None)], "k string, v long")
    got = {(r["k"], r["prob"]): r["value"] for r in skew.exact_quantiles(df, "k", "v", [0.0, 0.5, 1.0], bins=16).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        vs.sort()
        assert got[k, 0.0] == vs[0] and got[k, 1.0] == vs[-1]
        assert got[k, 0.5] == vs[max(1, -int(-(0.5 * len(vs)) // 1)) - 1]
    assert len(got) == 3 * len(by)


def test_quantiles_of_an_empty_table(spark):
    assert skew.exact_quantiles(spark.createDataFrame([], "k string, v long"), "k", "v", [0.5]).count() == 0


def test_heavy_keys_by_rows_and_weight(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, 1)] * 30 + [(f"x{i}", 1) for i in range(19)] + [("w", 900)], "k string, n long")
    rows = {r["k"]: r["weight"] for r in skew.heavy_keys(df, "k", share=0.02, bins=4).collect()}
    assert rows == {"a": 50}  # 100 rows, the null key counts in the total only
    weighted = {r["k"]: r["weight"] for r in skew.heavy_keys(df, "k", "n", share=0.5).collect()}
    assert weighted == {"w": 900}
    assert skew.heavy_keys(df.limit(0), "k").count() == 0


def test_key_profile_counts_forms_and_nulls(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 5), ("a", None, 3), (None, "y", 4)], "k string, f string, t long")
    r = skew.key_profile(df, "k", distinct="f", time="t").collect()
    assert [(x["k"], x["rows"], x["first"], x["last"], x["forms"], x["share"]) for x in r] == [("a", 3, 1, 5, 1, 0.75)]


def test_hot_aware_join_equals_a_plain_join(spark):
    rows = spark.createDataFrame(hot(spark), "k string, v long")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
    joined = skew.hot_aware_join(rows, lookup, ["k"], "n", 9000)
    assert joined.count() == 9000 and joined.where("v < low").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, links):
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, min(y for y in range(31) if find(y) == find(x))) for a, b in links if a != b for x in (a, b)}
    got = {(r["node"], r["label"]) for r in graph.minimum_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = graph.minimum_labels(df)
    assert labels.count() == 201 and labels.where("label <> 0").count() == 0
