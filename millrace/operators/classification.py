"""Classifiers and what their choice rests on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entropy(counts: Sequence[Column], total: Column) -> Column:
    term = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return sum((term(c) for c in counts), F.lit(0.0))


def split_measures(df: DataFrame, attributes: Sequence[str], label: str) -> DataFrame:
    """``attribute, values, gain, split_info, gain_ratio`` for a 0/1 label: all attributes in one pass over the rows.

    Rows without a label are left out; a null attribute is a value of its own. An attribute of one value has ratio 0.
    """
    long = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("s")
    )
    cells = long.groupBy("s.attribute", "s.v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    cells = cells.withColumn("h", _entropy([F.col("p"), F.col("n") - F.col("p")], F.col("n")))
    sums = cells.groupBy("attribute").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("t"), F.sum("p").alias("tp"), F.sum(F.col("n") * F.col("h")).alias("nh"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    gain = _entropy([F.col("tp"), F.col("t") - F.col("tp")], F.col("t")) - F.col("nh") / F.col("t")
    info = F.log2("t") - F.col("nl") / F.col("t")
    return sums.select("attribute", "values", gain.alias("gain"), info.alias("split_info"), F.when(info > 1e-12, gain / info).otherwise(0.0).alias("gain_ratio"))


def knn(train: DataFrame, test: DataFrame, key: str, x: str, label: str, k: int, block: int = 2000, sample: int = 50_000) -> DataFrame:
    """``key, prediction, tie``: 1 if more than half of the k nearest (Euclidean, then key) are 1; tie: the next neighbour is as near.

    The training side is fitted on at most ``sample`` labelled rows (the first by the hash of the key) and sent out in blocks;
    each row keeps only its k + 1 nearest, so no table of all distances is made.
    """
    spark = train.sparkSession
    rows = sorted(train.select(key, x, label).dropna().orderBy(F.xxhash64(key), key).limit(sample).collect(), key=lambda r: r[key])
    parts = [spark.sparkContext.broadcast((np.array([r[key] for r in rows[i : i + block]]), np.array([r[x] for r in rows[i : i + block]], float), np.array([r[label] for r in rows[i : i + block]]))) for i in range(0, len(rows), block)]
    kind = test.schema[key].dataType.simpleString()

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            vectors = np.array(pdf[x].tolist(), float)
            best: list[list[tuple]] = [[] for _ in range(len(vectors))]
            for lo in range(0, len(vectors), 256):
                q = vectors[lo : lo + 256]
                for p in parts:
                    ids, data, labels = p.value
                    # a few more than needed by the fast form, whose rounding could swap near ones; these are measured exactly
                    fast = (q * q).sum(1)[:, None] - 2 * q @ data.T + (data * data).sum(1)[None, :]
                    some = min(k + 9, len(data))
                    for i, row in enumerate(np.argpartition(fast, some - 1, axis=1)[:, :some]):
                        exact = ((q[i] - data[row]) ** 2).sum(1)
                        best[lo + i] = sorted([*best[lo + i], *((round(float(d), 9), ids[j], labels[j]) for d, j in zip(exact, row))])[: k + 1]
            votes = [sum(b[2] for b in row[:k]) for row in best]
            tie = [len(row) > k and row[k][0] == row[k - 1][0] for row in best]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "prediction": [int(2 * v > min(k, len(row))) for v, row in zip(votes, best)], "tie": tie})

    return test.select(key, x).where(F.col(x).isNotNull()).mapInPandas(near, f"{key} {kind}, prediction int, tie boolean")


def class_means(df: DataFrame, x: str, label: str, size: int) -> dict[int, list[float]]:
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(F.element_at(x, i + 1).cast("double")).alias(f"m{i}") for i in range(size)]).orderBy(label).collect()
    return {r[label]: [r[f"m{i}"] for i in range(size)] for r in rows}


def nearest_centroid(train: DataFrame, test: DataFrame, key: str, x: str, label: str, size: int) -> DataFrame:
    from millrace.operators.clustering import nearest

    means = class_means(train, x, label, size)
    labels = list(means)
    m = nearest(F.col(x), [means[c] for c in labels])
    return test.select(key, F.element_at(F.array(*map(F.lit, labels)), m["k"] + 1).alias("prediction"))


class Mahalanobis:
    """Class by the smaller Mahalanobis distance; means and covariances are aggregates, only size x size matrices reach the driver."""

    def fit(self, df: DataFrame, x: str, label: str, size: int) -> Mahalanobis:
        from millrace.operators.reduction import covariance

        self.x, self.size, self.classes = x, size, {}
        for c in sorted(r[0] for r in df.select(label).dropna().distinct().collect()):
            mean, cov, _ = covariance(df.where(F.col(label) == c), x, size)
            self.classes[c] = (mean, np.linalg.pinv(cov))
        return self

    def distance(self, label: object) -> Column:
        mean, inverse = self.classes[label]
        literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
        total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        centred = F.zip_with(F.col(self.x), literal(mean), lambda x, m: x.cast("double") - m)
        turned = F.transform(F.array(*[literal(row) for row in inverse]), lambda row: total(row, centred))
        return F.sqrt(F.greatest(total(turned, centred), F.lit(0.0)))

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """``key, prediction, decision``: decision is the first class's distance less the second's."""
        labels = list(self.classes)
        best = F.array_min(F.array(*[F.struct(self.distance(c).alias("d"), F.lit(c).alias("c")) for c in labels]))
        decision = self.distance(labels[0]) - self.distance(labels[1]) if len(labels) > 1 else F.lit(0.0)
        return df.select(key, best["c"].alias("prediction"), decision.alias("decision"))


def multinomial_nb(counts: DataFrame, labels: DataFrame, key: str, label: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(``label, log_prior``; ``label, term, log_likelihood``): unsmoothed priors, likelihoods smoothed by ``alpha`` over the vocabulary."""
    known = labels.where(F.col(label).isNotNull()).select(key, label)
    docs = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    prior = docs.join(docs.agg(F.sum("n").alias("t")), F.lit(True)).select(label, F.log(F.col("n") / F.col("t")).alias("log_prior"))
    joined = counts.join(known, key)
    by_term = joined.groupBy(label, "term").agg(F.sum("tf").alias("c"))
    totals = by_term.groupBy(label).agg(F.sum("c").alias("t"))
    vocabulary = by_term.select("term").distinct()
    size = vocabulary.count()
    grid = vocabulary.join(F.broadcast(totals), F.lit(True))  # one row a class
    filled = grid.join(by_term, [label, "term"], "left")
    return prior, filled.select(label, "term", F.log((F.coalesce("c", F.lit(0)) + alpha) / (F.col("t") + alpha * size)).alias("log_likelihood"))


def multinomial_predict(counts: DataFrame, docs: DataFrame, key: str, label: str, prior: DataFrame, likelihood: DataFrame) -> DataFrame:
    """``key, prediction``; texts without a known term get the class of the larger prior, ties the smaller class."""
    scored = counts.join(likelihood, "term").groupBy(key, label).agg(F.sum(F.col("tf") * F.col("log_likelihood")).alias("s"))
    grid = docs.select(key).join(F.broadcast(prior), F.lit(True)).join(scored, [key, label], "left")  # one row a class
    total = F.round(F.col("log_prior") + F.coalesce("s", F.lit(0.0)), 9)
    best = grid.groupBy(key).agg(F.max(F.struct(total.alias("s"), (-F.col(label)).alias("l"))).alias("m"))
    return best.select(key, (-F.col("m.l")).alias("prediction"))


def word_ratios(counts: DataFrame, labels: DataFrame, key: str, label: str, alpha: float = 1.0, least: int = 30) -> DataFrame:
    """``term, n, llr``: log-likelihood ratio of class 1 to class 0, of terms with at least ``least`` occurrences."""
    _, like = multinomial_nb(counts, labels, key, label, alpha)
    total = counts.join(labels.where(F.col(label).isNotNull()), key).groupBy("term").agg(F.sum("tf").alias("n")).where(F.col("n") >= least)
    wide = like.groupBy("term").agg(F.max(F.when(F.col(label) == 1, F.col("log_likelihood"))).alias("one"), F.max(F.when(F.col(label) == 0, F.col("log_likelihood"))).alias("zero"))
    return total.join(wide, "term").select("term", "n", (F.col("one") - F.col("zero")).alias("llr"))


def perceptron(df: DataFrame, x: str, label: str, order: str, epochs: int = 10, eta: float = 1.0, sample: int = 100_000) -> tuple[np.ndarray, float, list[int]]:
    """(weights, bias, errors by epoch) of the sequential rule over the first ``sample`` rows in order: every update needs the last one."""
    rows = df.select(order, x, label).dropna().orderBy(order).limit(sample).collect()
    w, b, history = np.zeros(len(rows[0][x]) if rows else 0), 0.0, []
    for _ in range(epochs):
        errors = 0
        for r in rows:
            v, y = np.asarray(r[x], float), 1 if r[label] else -1
            if y * (w @ v + b) <= 0:
                w, b, errors = w + eta * y * v, b + eta * y, errors + 1
        history.append(errors)
        if not errors:
            break
    return w, b, history


def logistic(df: DataFrame, features: str, label: str, c: float = 1.0):
    """L2 logistic regression with the objective 0.5 |w|^2 + c * sum of log-losses and a free intercept."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(df.count(), 1)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(df)


def tree(df: DataFrame, features: str, label: str, depth: int = 5):
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity="entropy", maxDepth=depth, maxBins=128, seed=42).fit(df)


def gaussian_nb(df: DataFrame, features: str, label: str, kind: str = "gaussian"):
    """``kind``: gaussian or bernoulli."""
    from pyspark.ml.classification import NaiveBayes

    return NaiveBayes(featuresCol=features, labelCol=label, modelType=kind).fit(df)


def mlp(df: DataFrame, features: str, label: str, size: int, hidden: int = 32, max_iter: int = 100):
    """One hidden layer of sigmoid units, fitted by L-BFGS."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[size, hidden, 2], maxIter=max_iter, seed=42).fit(df)


def majority(df: DataFrame, label: str) -> int:
    return int(df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()[0])


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def explain(doc_terms: DataFrame, weights: DataFrame, key: str, top: int = 5) -> DataFrame:
    """``key, term, contribution``: the terms that speak most for class 1 in each row."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("contribution", 9)), "term")
    c = doc_terms.join(weights.select("term", F.col("weight").alias("w")), "term").select(key, "term", (F.col("weight") * F.col("w")).alias("contribution"))
    return c.where("contribution > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")
