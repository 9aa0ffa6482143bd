"""Comparison of models on the feature matrix: scans, controls, ablations, error analysis, and the scoring service."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import classification, evaluation

Fit = Callable[[DataFrame], object]


def vectors(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="keep").transform(df)


def scaled_logistic(train: DataFrame, label: str = "label", c: float = 1.0, components: int | None = None):
    """Standardised features, reduced to ``components`` directions if asked, then L2 logistic regression."""
    from pyspark.ml.classification import LogisticRegression

    n = max(train.count(), 1)
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="scaled", outputCol="reduced"))
    stages.append(LogisticRegression(featuresCol="reduced" if components else "scaled", labelCol=label, regParam=1.0 / (c * n), standardization=False, maxIter=100))
    return Pipeline(stages=stages).fit(train)


def candidates(label: str = "label") -> dict[str, Fit]:
    """The learned models that are compared."""
    return {
        "logistic regression": lambda t: scaled_logistic(t, label), "decision tree": lambda t: classification.tree(t, "features", label, 5),
        "naive bayes": lambda t: classification.gaussian_nb(t, "features", label),
    }


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").cast("int").alias("prediction"))


def held_out(models: dict[str, Fit], train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """``model`` and its metrics on ``test``, after fitting on ``train``."""
    parts = [predict(fit(train), test, [label]).withColumn("model", F.lit(name)) for name, fit in models.items()]
    return evaluation.scored_metrics(reduce(DataFrame.unionByName, parts), ["model"], label, "prediction")


def cross_validated(models: dict[str, Fit], df: DataFrame, label: str = "label", folds: int = 5) -> DataFrame:
    """``model, balanced_accuracy_mean, balanced_accuracy_std`` over the folds of ``df`` (column ``fold``)."""
    parts = []
    for name, fit in models.items():
        for f in range(folds):
            parts.append(predict(fit(df.where(F.col("fold") != f)), df.where(F.col("fold") == f), [label]).select("*", F.lit(name).alias("model"), F.lit(f).alias("fold")))
    per_fold = evaluation.scored_metrics(reduce(DataFrame.unionByName, parts), ["model", "fold"], label, "prediction")
    return per_fold.groupBy("model").agg(F.avg("balanced_accuracy").alias("balanced_accuracy_mean"), F.stddev_samp("balanced_accuracy").alias("balanced_accuracy_std"))


def depth_scan(train: DataFrame, validation: DataFrame, depths: Sequence[int], label: str = "label") -> DataFrame:
    """``depth, train, validation``: balanced accuracy of a decision tree of each depth on both parts."""
    parts = []
    for depth in depths:
        model = classification.tree(train, "features", label, depth)
        parts += [predict(model, part, [label]).select("*", F.lit(depth).alias("depth"), F.lit(name).alias("part")) for name, part in (("train", train), ("validation", validation))]
    m = evaluation.scored_metrics(reduce(DataFrame.unionByName, parts), ["depth", "part"], label, "prediction")
    return m.groupBy("depth").agg(*[F.max(F.when(F.col("part") == p, F.col("balanced_accuracy"))).alias(p) for p in ("train", "validation")])


def importances(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """``feature, importance`` of a tree, those that count."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray()) if v > 0]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def error_analysis(df: DataFrame, year: Column, length: Column, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``year, outcome, n, median_length`` of true and false decisions."""
    d = df.select(year.alias("year"), evaluation.outcome(F.col(label), F.col(prediction)).alias("outcome"), length.alias("_l")).where("outcome is not null")
    return d.groupBy("year", "outcome").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_l", 0.5, 10_000).alias("median_length"))


def campaign_of(messages: DataFrame, key: str, text: str, reduced: DataFrame, clusters: DataFrame) -> DataFrame:
    """``key, campaign``: the cluster of a message; -1 if it shares no word with the mined ones, null if there is no message.

    ``reduced`` has the rows with a vocabulary, ``clusters`` (``key, cluster``) their clusters.
    """
    found = messages.select(key, (tx.stripped(F.col(text)) != "").alias("_has")).join(clusters, key, "left")
    return found.select(key, F.when(F.col("_has"), F.coalesce("cluster", F.lit(-1))).alias("campaign"))


def nearest_member(reduced: DataFrame, clusters: DataFrame, key: str, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """``cluster, member``: the row of each cluster nearest to its centroid; ties go to the smaller key."""
    from millrace.operators.clustering import nearest

    d = reduced.join(clusters, key).withColumn("_d", F.round(nearest(F.col(vector), centroids)["d"], 9))
    return d.groupBy("cluster").agg(F.min(F.struct("_d", key)).alias("m")).select("cluster", F.col(f"m.{key}").alias("member"))


def soft_membership(scored: DataFrame, key: str, probability: str, least: float = 0.9) -> DataFrame:
    """``rows, soft, share``: how many rows belong to no component with ``least`` or more."""
    top = scored.select(F.array_max(probability).alias("p"))
    return top.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") < least).alias("soft")).withColumn("share", F.try_divide(F.col("soft").cast("double"), F.col("rows")))


def service(rows: DataFrame, weights: DataFrame, bias: float, campaigns: DataFrame, found: DataFrame, items: Column, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """``id, probability, label, campaign, terms, rules``: what is said about each message, as one plan.

    ``rows`` has ``id, name, message``; ``weights`` (``term, weight``) and ``bias`` are a linear model, ``campaigns`` has ``id, campaign``,
    ``found`` has the mined rules, ``items`` is the array of a row's items. Messages empty after masking have no row.
    """
    from millrace.operators.association import match_rules
    from millrace.operators.similarity import term_counts

    r = rows.withColumn("_items", items).select("id", tx.mask_pii(F.col("message"), F.col("name")).alias("_m"), "_items").where("_m <> ''")
    terms = term_counts(r, "id", "_m").join(weights, "term").select("id", "term", (F.col("tf") * F.col("weight")).alias("contribution"))
    z = terms.groupBy("id").agg(F.sum("contribution").alias("z"))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("contribution", 9)), "term")
    best = terms.where("contribution > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    best = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("terms"))
    fits = match_rules(r, "id", "_items", found).groupBy("id").agg(F.count(F.lit(1)).alias("rules"))
    out = r.select("id").join(z, "id", "left").join(best, "id", "left").join(campaigns.select("id", "campaign"), "id", "left").join(fits, "id", "left")
    p = classification.sigmoid(F.coalesce("z", F.lit(0.0)) + F.lit(float(bias)))
    out = out.withColumn("probability", p).withColumn("label", F.when(F.col("probability") >= threshold, "spam").otherwise("legitimate"))
    return out.select("id", "probability", "label", F.coalesce("campaign", F.lit(-1)).alias("campaign"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("rules", F.lit(0)).alias("rules"))


def probabilities(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the probability of class 1."""
    return model.transform(df).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
