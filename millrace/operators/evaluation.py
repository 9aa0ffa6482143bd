"""Metrics, folds, thresholds and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import running_sums


def confusion(label: Column, prediction: Column) -> dict[str, Column]:
    return {"tp": F.count_if((label == 1) & (prediction == 1)), "fn": F.count_if((label == 1) & (prediction == 0)), "fp": F.count_if((label == 0) & (prediction == 1)), "tn": F.count_if((label == 0) & (prediction == 0))}


def metrics(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    """0 where a denominator is 0."""
    q = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall, specificity = q(tp, tp + fp), q(tp, tp + fn), q(tn, tn + fp)
    return {
        "accuracy": q(tp + tn, tp + fn + fp + tn), "precision": precision, "recall": recall, "specificity": specificity,
        "f1": q(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + specificity) / 2,
    }


def scored_metrics(df: DataFrame, group: Sequence[str], label: str, prediction: str) -> DataFrame:
    c = df.where(F.col(label).isNotNull()).groupBy(*group).agg(*[v.alias(k) for k, v in confusion(F.col(label), F.col(prediction)).items()])
    return c.select("*", *[v.alias(k) for k, v in metrics(*[F.col(k) for k in ("tp", "fn", "fp", "tn")]).items()])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``auc`` by rank sums with average ranks for ties: rows are first counted by distinct score, then ranked over ranges of it."""
    by_score = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    ranked = running_sums(by_score, [score], ["n"]).withColumn("rank", F.col("running_n") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * q).cast("double")).alias("auc"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, tpr, fpr`` at each distinct score, from the highest down."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by_score = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = by_score.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).first()  # one row
    summed = running_sums(by_score, [F.desc("threshold")], ["p", "q"])
    return summed.select("threshold", F.try_divide("running_p", F.lit(float(total["tp"] or 0))).alias("tpr"), F.try_divide("running_q", F.lit(float(total["tq"] or 0))).alias("fpr"))


def grouped_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` by the hash of a group, so that equal groups share a fold."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` by the hash of label and key: each label spreads evenly over the folds, without ranking its rows."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(k)).cast("int"))


def grouped_stratified_folds(df: DataFrame, group: str, label: str, k: int = 5, share: int = 1000) -> DataFrame:
    """``fold`` such that rows of a group share one and every fold has about the same rows of each label.

    Groups are counted by label. The ``share`` largest at most are placed one after the other, where the label shares stay closest to
    even; all others, each less than one share-th of the rows, go by the hash of the group, which is even in expectation.
    """
    known = df.where(F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))).alias("q"))
    total = sizes.agg(F.sum(F.col("p") + F.col("q")).alias("n")).first()["n"] or 0
    large = sizes.where((F.col("p") + F.col("q")) * share > total).orderBy(F.desc(F.col("p") + F.col("q")), group).collect()
    load = [[0, 0] for _ in range(k)]
    placed = {}
    for r in large:
        at = min(range(k), key=lambda f: ((load[f][0] + r["p"]) ** 2 + (load[f][1] + r["q"]) ** 2 - load[f][0] ** 2 - load[f][1] ** 2, f))
        load[at][0] += r["p"]
        load[at][1] += r["q"]
        placed[r[group]] = at
    fold = F.pmod(F.xxhash64(F.lit(42), F.col(group)), F.lit(k)).cast("int")
    if placed:
        fold = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in placed.items() for x in kv]), F.col(group)), fold)
    return df.withColumn("fold", F.when(F.col(group).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")).otherwise(fold))


def time_split(df: DataFrame, ts: str, first_test_year: int) -> DataFrame:
    """``in_test``; rows without a time are in neither part and left out."""
    return df.where(F.col(ts).isNotNull()).withColumn("in_test", F.year(ts) >= first_test_year)


def cross_validate(df: DataFrame, fit, features: str, label: str, folds: int = 5) -> DataFrame:
    """``fold`` and its metrics, for an ML estimator ``fit(train) -> model``; rows need a ``fold`` column."""
    parts = []
    for f in range(folds):
        model = fit(df.where(F.col("fold") != f))
        parts.append(model.transform(df.where(F.col("fold") == f)).select(F.lit(f).alias("fold"), label, F.col("prediction").cast("int").alias("prediction")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return scored_metrics(whole, ["fold"], label, "prediction")


def fold_summary(folds: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    return folds.agg(*[f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("std", F.stddev_samp))])


def threshold_table(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and metrics at each threshold (score at or above it is 1), in one pass."""
    named = {f"{k}_{i}": v for i, t in enumerate(thresholds) for k, v in confusion(F.col(label), (F.col(score) >= t).cast("int")).items()}
    one = df.where(F.col(label).isNotNull()).agg(*[v.alias(k) for k, v in named.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}_{i}").alias(k) for k in ("tp", "fn", "fp", "tn")]) for i, t in enumerate(thresholds)])).alias("r")
    wide = one.select(rows).select("r.*")
    return wide.select("*", *[v.alias(k) for k, v in metrics(*[F.col(k) for k in ("tp", "fn", "fp", "tn")]).items()])


def select_model(table: DataFrame, max_bytes: float, max_ms: float, margin: float = 0.01) -> DataFrame:
    """Of the models within size and latency, those with an F1 within ``margin`` of the best; fewest false positives, then highest AUC, then name."""
    fit = table.where((F.col("bytes") < max_bytes) & (F.col("ms") < max_ms))
    best = fit.agg(F.max("f1").alias("best"))
    return fit.join(best, F.lit(True)).where(F.col("f1") >= F.col("best") - margin).orderBy("false_positives", F.desc("auc"), "model").limit(1).drop("best")


def align(tables: Sequence[DataFrame], on: str = "model") -> DataFrame:
    """Metric tables side by side, matched by model name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on, "full")
    return out


def outcome(label: Column, prediction: Column) -> Column:
    """TP, TN, FP or FN of a row; null without a label."""
    return F.when((label == 1) & (prediction == 1), "TP").when((label == 0) & (prediction == 0), "TN").when((label == 0) & (prediction == 1), "FP").when((label == 1) & (prediction == 0), "FN")
