"""Association rules over transactions (arrays of items)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent_itemsets(tx: DataFrame, items: str, min_support: float) -> DataFrame:
    """``itemset`` (sorted), ``n``, ``support`` of all sets with at least the given support, by FP-growth."""
    baskets = tx.select(F.array_distinct(items).alias("items"))
    total = baskets.count()
    if not total:
        return tx.sparkSession.createDataFrame([], "itemset array<string>, n long, support double")
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets).freqItemsets
    return found.select(F.sort_array("items").alias("itemset"), F.col("freq").alias("n"), (F.col("freq") / total).alias("support")).where(F.col("support") >= min_support - 1e-12)


def rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """``antecedent, consequent, support, confidence, lift`` for every split of every frequent set, consequents of any size.

    Subsets are listed within the row of their set (2^k for a set of k items); supports are joined by the sorted set.
    """
    bits = F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("itemset")) - 2).cast("long")), lambda b: b)
    pick = lambda keep: F.filter("itemset", lambda x, i: F.pmod(F.floor(F.col("b") / F.pow(F.lit(2), i)), F.lit(2)) == keep)
    splits = itemsets.where(F.size("itemset") > 1).select("itemset", "support", F.explode(bits).alias("b")).select(pick(1).alias("antecedent"), pick(0).alias("consequent"), "support")
    ante = itemsets.select(F.col("itemset").alias("antecedent"), F.col("support").alias("a"))
    cons = itemsets.select(F.col("itemset").alias("consequent"), F.col("support").alias("c"))
    joined = splits.join(ante, "antecedent").join(cons, "consequent")
    out = joined.select("antecedent", "consequent", "support", (F.col("support") / F.col("a")).alias("confidence"), (F.col("support") / F.col("a") / F.col("c")).alias("lift"))
    return out.where(F.col("confidence") >= min_confidence - 1e-12)


def prune_redundant(found: DataFrame, margin: float = 0.02, top: int | None = None) -> DataFrame:
    """Rules that no kept rule with a smaller antecedent and nearly the confidence makes redundant, by consequent.

    Kept greedily: shorter antecedents first, then higher confidence and support. One consequent's rules are one ordered group,
    bounded by the number of frequent sets.
    """
    fields = "antecedent array<string>, consequent array<string>, support double, confidence double, lift double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf["antecedent"].map(len), _a=pdf["antecedent"].map(lambda a: ",".join(sorted(a))))
        pdf = pdf.sort_values(["_n", "confidence", "support", "_a"], ascending=[True, False, False, True])
        kept: list[tuple[frozenset, float]] = []
        keep = []
        for ante, conf in zip(pdf["antecedent"], pdf["confidence"]):
            a = frozenset(ante)
            redundant = any(b < a and c >= conf - margin for b, c in kept)
            keep.append(not redundant)
            if not redundant:
                kept.append((a, conf))
        out = pdf[keep].sort_values(["lift", "support", "_a"], ascending=[False, False, True])
        return (out.head(top) if top else out)[["antecedent", "consequent", "support", "confidence", "lift"]]

    return found.select("antecedent", "consequent", "support", "confidence", "lift").groupBy("consequent").applyInPandas(lambda pdf: fold(pdf), fields)


def target_rules(found: DataFrame, consequent: str, barred: Sequence[str], margin: float = 0.02, top: int = 6) -> DataFrame:
    """Rules for one consequent whose antecedent has no barred item, pruned, the ``top`` by lift and support."""
    bar = F.array(*map(F.lit, barred)) if barred else F.array().cast("array<string>")
    mine = found.where((F.size("consequent") == 1) & F.array_contains("consequent", consequent) & ~F.arrays_overlap("antecedent", bar))
    return prune_redundant(mine, margin, top)


def sensitivity(itemsets: DataFrame, supports: Sequence[float], confidences: Sequence[float]) -> DataFrame:
    """Sets and rules at each pair of thresholds, 0 where there is none; mined once at the lowest support, then filtered."""
    spark = itemsets.sparkSession
    s = F.broadcast(spark.createDataFrame([(float(x),) for x in supports], "min_support double"))
    c = F.broadcast(spark.createDataFrame([(float(x),) for x in confidences], "min_confidence double"))
    found = rules(itemsets, min(confidences))
    sets = itemsets.join(s, itemsets["support"] >= s["min_support"] - 1e-12).groupBy("min_support").agg(F.count(F.lit(1)).alias("itemsets"))
    cells = found.join(s, found["support"] >= s["min_support"] - 1e-12).join(c, F.col("confidence") >= c["min_confidence"] - 1e-12).groupBy("min_support", "min_confidence").agg(F.count(F.lit(1)).alias("rules"))
    grid = s.join(c, F.lit(True)).join(cells, ["min_support", "min_confidence"], "left").join(sets, "min_support", "left")
    return grid.select("min_support", "min_confidence", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("itemsets", F.lit(0)).alias("itemsets"))


def verify_rule(tx: DataFrame, items: str, antecedent: Sequence[str], consequent: Sequence[str]) -> DataFrame:
    """Support, confidence and lift of one rule by direct counts."""
    has = lambda xs: F.forall(F.array(*map(F.lit, xs)), lambda x: F.array_contains(items, x))
    a, c = has(antecedent), has(consequent)
    one = tx.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("a"), F.count_if(c).alias("c"), F.count_if(a & c).alias("b"))
    return one.select((F.col("b") / F.col("n")).alias("support"), F.try_divide("b", "a").alias("confidence"), F.try_divide(F.col("b") * F.col("n"), F.col("a") * F.col("c")).alias("lift"))


def match_rules(tx: DataFrame, key: str, items: str, found: DataFrame) -> DataFrame:
    """``key, antecedent, consequent`` where all of a rule's antecedent is among a row's items.

    Both sides are joined by item and the matches of each rule counted, so no row meets every rule.
    """
    numbered = found.select(F.xxhash64("antecedent", "consequent").alias("rule"), "antecedent", "consequent")
    wanted = numbered.select("rule", F.explode("antecedent").alias("item"), F.size("antecedent").alias("need"))
    have = tx.select(key, F.explode(F.array_distinct(items)).alias("item"))
    hits = have.join(wanted, "item").groupBy(key, "rule", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return hits.join(numbered, "rule").select(key, "antecedent", "consequent")


def items_of(parts: dict[str, Column]) -> Column:
    """An array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in parts.items()]))


