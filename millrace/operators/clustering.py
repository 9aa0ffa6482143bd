"""Clustering: Lloyd steps with given centroids, medoids, Gaussian mixtures, silhouettes and agreement."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(x: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """struct(d, k): squared distance to the nearest centroid and its number; ties go to the smaller number.

    Centroids are literals of the expression, so points are assigned where they lie.
    """
    return F.array_min(F.array(*[F.struct(squared_distance(x, vector(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)]))


def kmeans_step(df: DataFrame, x: str, centroids: Sequence[Sequence[float]]) -> tuple[list[list[float]], float]:
    """(new centroids, sum of squared distances before the move) by one aggregation; an empty cluster keeps its centroid."""
    size = len(centroids[0])
    assigned = df.select(x, nearest(F.col(x), centroids).alias("m")).where(F.col(x).isNotNull())
    sums = assigned.groupBy("m.k").agg(F.count(F.lit(1)).alias("n"), F.sum("m.d").alias("sse"), *[F.avg(F.element_at(x, i + 1).cast("double")).alias(f"c{i}") for i in range(size)]).collect()
    new = [list(map(float, c)) for c in centroids]
    for r in sums:
        new[r["k"]] = [r[f"c{i}"] for i in range(size)]
    return new, float(sum(r["sse"] for r in sums))


def kmeans(df: DataFrame, x: str, centroids: Sequence[Sequence[float]], max_iter: int = 20, tol: float = 1e-8) -> tuple[list[list[float]], list[float]]:
    """Lloyd iterations from given centroids: (centroids, history of the sum of squares). Only k sums a round reach the driver."""
    data = materialize(df.select(x), "kmeans")
    history, now = [], [list(map(float, c)) for c in centroids]
    for _ in range(max_iter):
        new, sse = kmeans_step(data, x, now)
        history.append(sse)
        if np.allclose(new, now, atol=tol, rtol=0):
            break
        now = new
    return now, history


def assign(df: DataFrame, key: str, x: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    m = nearest(F.col(x), centroids)
    return df.select(key, m["k"].alias("cluster"), m["d"].alias("distance"))


def kmeans_scan(df: DataFrame, features: str, ks: Sequence[int], seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, cost, cosine silhouette) for each k, on an ML vector column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=features, maxIter=20).fit(df)
        score = ClusteringEvaluator(featuresCol=features, predictionCol="prediction", distanceMeasure="cosine").evaluate(model.transform(df))
        out.append((k, float(model.summary.trainingCost), float(score)))
    return out


def kmedoids(pairs: DataFrame, points: Sequence[int], k: int, restarts: int = 5, max_iter: int = 20, seed: int = 42) -> tuple[list[int], float]:
    """(medoids, cost) over a table of distances ``i, j, d`` in both directions, for a bounded sample of points.

    Points go to the nearest medoid; each cluster's new medoid has the smallest sum of distances within it. The best of the
    restarts is kept. The distance table grows with the square of the points: sample first.
    """
    spark = pairs.sparkSession
    pairs = materialize(pairs.select("i", "j", "d"), "distances")
    rng = np.random.default_rng(seed)
    best: tuple[list[int], float] = ([], math.inf)
    for _ in range(restarts):
        medoids = sorted(int(p) for p in rng.choice(np.asarray(points), k, replace=False))
        cost = math.inf
        for _ in range(max_iter):
            m = F.broadcast(spark.createDataFrame([(p,) for p in medoids], "j long"))
            own = pairs.join(m, "j").groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select("i", F.col("m.d").alias("d"), F.col("m.j").alias("medoid"))
            own = own.where(~F.col("i").isin(medoids)).union(spark.createDataFrame([(p, 0.0, p) for p in medoids], "i long, d double, medoid long"))
            own = materialize(own, "medoids")
            total = own.agg(F.sum("d")).first()[0]
            within = pairs.join(own.select("i", "medoid"), "i").join(own.select(F.col("i").alias("j"), F.col("medoid").alias("mj")), "j").where("medoid = mj")
            sums = within.groupBy("medoid", "i").agg(F.sum("d").alias("s"))
            new = sorted(r["c"] for r in sums.groupBy("medoid").agg(F.min(F.struct("s", "i")).alias("b")).select(F.col("b.i").alias("c")).collect())
            new = sorted([*new, *[p for p in medoids if p not in new][: k - len(new)]])
            if total >= cost - 1e-12 or new == medoids:
                cost = min(cost, total)
                break
            medoids, cost = new, total
        if cost < best[1]:
            best = (medoids, cost)
    return best


def _log_normal(x: Column, mu: float, var: float) -> Column:
    return -0.5 * (F.log(F.lit(2 * math.pi * var)) + (x - mu) * (x - mu) / var)


def em_step(df: DataFrame, x: str, mu: Sequence[float], sigma: Sequence[float], w: Sequence[float]) -> tuple[list[float], list[float], list[float], float]:
    """One round of two-Gaussian EM by a single aggregation: (means, deviations, weights, log-likelihood before the round)."""
    v = F.col(x).cast("double")
    logs = [math.log(w[k]) + _log_normal(v, mu[k], sigma[k] ** 2) for k in (0, 1)]
    top = F.greatest(*logs)
    total = top + F.log(F.exp(logs[0] - top) + F.exp(logs[1] - top))
    r = [F.exp(lg - total) for lg in logs]
    s = df.where(v.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("ll"), *[f.alias(f"{n}{k}") for k in (0, 1) for n, f in (("r", F.sum(r[k])), ("x", F.sum(r[k] * v)), ("q", F.sum(r[k] * v * v)))]).first()
    means = [s[f"x{k}"] / s[f"r{k}"] for k in (0, 1)]
    devs = [math.sqrt(max(s[f"q{k}"] / s[f"r{k}"] - means[k] ** 2, 1e-12)) for k in (0, 1)]
    return means, devs, [s[f"r{k}"] / s["n"] for k in (0, 1)], float(s["ll"])


def em_two_gaussians(df: DataFrame, x: str, mu: Sequence[float], sigma: Sequence[float], w: Sequence[float], max_iter: int = 100, tol: float = 1e-6) -> tuple[list[float], list[float], list[float], list[float]]:
    """EM until the log-likelihood gains less than ``tol``: means, deviations, weights and its history."""
    data = materialize(df.select(x), "em")
    history: list[float] = []
    for _ in range(max_iter):
        mu, sigma, w, ll = em_step(data, x, mu, sigma, w)
        if history and ll - history[-1] < tol:
            history.append(ll)
            break
        history.append(ll)
    return list(mu), list(sigma), list(w), history


def gmm_diagonal(df: DataFrame, x: str, start: Sequence[Sequence[float]], max_iter: int = 30, tol: float = 1e-4, floor: float = 1e-6) -> dict:
    """Mixture of Gaussians with diagonal covariance from given means: weights, means, variances, log-likelihood, BIC.

    Each round is one aggregation of k * (2 * size + 1) sums.
    """
    size, k = len(start[0]), len(start)
    data = materialize(df.select(x), "gmm")
    base = data.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.element_at(x, i + 1).cast("double")).alias(f"v{i}") for i in range(size)]).first()
    n = base["n"]
    means, var, weight = np.array(start, float), np.array([[max(base[f"v{i}"], floor) for i in range(size)]] * k), np.full(k, 1 / k)
    at = [F.element_at(x, i + 1).cast("double") for i in range(size)]
    last = -math.inf
    for _ in range(max_iter):
        logs = [F.lit(math.log(weight[c])) + sum((_log_normal(at[i], float(means[c, i]), float(var[c, i])) for i in range(size)), F.lit(0.0)) for c in range(k)]
        # each density is computed once, as a column, before it is used
        step = data.select(x, *[lg.alias(f"l{c}") for c, lg in enumerate(logs)])
        top = F.greatest(*[F.col(f"l{c}") for c in range(k)]) if k > 1 else F.col("l0")
        step = step.withColumn("t", top).withColumn("ll", F.col("t") + F.log(sum((F.exp(F.col(f"l{c}") - F.col("t")) for c in range(k)), F.lit(0.0))))
        step = step.select(x, "ll", *[F.exp(F.col(f"l{c}") - F.col("ll")).alias(f"r{c}") for c in range(k)])
        aggs = [F.sum("ll").alias("ll")]
        for c in range(k):
            aggs.append(F.sum(f"r{c}").alias(f"n{c}"))
            for i in range(size):
                aggs += [F.sum(F.col(f"r{c}") * at[i]).alias(f"s{c}_{i}"), F.sum(F.col(f"r{c}") * at[i] * at[i]).alias(f"q{c}_{i}")]
        s = step.agg(*aggs).first()
        mass = np.array([max(s[f"n{c}"], 1e-9) for c in range(k)])
        means = np.array([[s[f"s{c}_{i}"] / mass[c] for i in range(size)] for c in range(k)])
        var = np.maximum(np.array([[s[f"q{c}_{i}"] / mass[c] for i in range(size)] for c in range(k)]) - means**2, floor)
        weight = mass / mass.sum()
        if s["ll"] - last < tol * abs(s["ll"]):
            last = s["ll"]
            break
        last = s["ll"]
    free = k - 1 + 2 * k * size
    return {"weights": weight, "means": means, "variances": var, "log_likelihood": last, "bic": free * math.log(max(n, 1)) - 2 * last}


def silhouette(df: DataFrame, x: str, cluster: str) -> float:
    """Mean cosine silhouette of an array column, computed from each cluster's sum of unit vectors, so without pairs of rows."""
    from millrace.operators.similarity import dot

    size = df.select(F.size(x)).where(F.col(x).isNotNull()).first()[0]
    unit = F.transform(x, lambda v: v.cast("double") / F.sqrt(dot(F.col(x), F.col(x))))
    rows = df.where(F.col(x).isNotNull()).select(unit.alias("u"), F.col(cluster).alias("c"))
    sums = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.element_at("u", i + 1)) for i in range(size)]).alias("s")).collect()
    far = {r["c"]: (r["n"], r["s"]) for r in sums}  # one row a cluster
    if len(far) < 2:
        return 0.0
    terms = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"), dot(F.col("u"), vector(s)).alias("p")) for c, (n, s) in far.items()])
    own = F.filter("t", lambda e: e["c"] == F.col("c"))[0]
    a = (own["n"] - own["p"]) / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("t", lambda e: e["c"] != F.col("c")), lambda e: 1 - e["p"] / e["n"]))
    scored = rows.select("c", "u", terms.alias("t")).select(F.when(own["n"] == 1, 0.0).otherwise((b - a) / F.greatest(a, b)).alias("s"))
    return float(scored.agg(F.avg("s")).first()[0])


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """``ari`` of two labellings from their contingency counts."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ij = cells.agg(two(F.col("n")).alias("ij"), F.sum("n").alias("total"))
    ai = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("ai"))
    bj = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("bj"))
    one = ij.join(ai, F.lit(True)).join(bj, F.lit(True))
    expected = F.col("ai") * F.col("bj") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(F.try_divide(F.col("ij") - expected, (F.col("ai") + F.col("bj")) / 2 - expected).alias("ari"))


def profile(members: DataFrame, cluster: str, template: str, label: str, script: str, ts: str) -> DataFrame:
    """Templates, rows, hit rate, most frequent script, first and last year of each cluster."""
    from millrace.operators.olap import mode

    base = members.groupBy(cluster).agg(
        F.count_distinct(template).alias("templates"), F.count(F.lit(1)).alias("submissions"), F.avg(label).alias("hit_rate"), F.min(F.year(ts)).alias("first_year"), F.max(F.year(ts)).alias("last_year")
    )
    return base.join(mode(members, cluster, script).select(cluster, F.col("mode").alias("script")), cluster, "left")


def top_terms(weights: DataFrame, clusters: DataFrame, key: str, top: int = 6) -> DataFrame:
    """The terms of highest mean weight of each cluster, best first, as one text; ties by term."""
    from pyspark.sql import Window

    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    means = weights.join(clusters, key).groupBy("cluster", "term").agg(F.sum("weight").alias("w")).join(sizes, "cluster").select("cluster", "term", (F.col("w") / F.col("n")).alias("w"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("w", 9)), "term")
    ranked = means.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return ranked.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), ", ").alias("label"))
