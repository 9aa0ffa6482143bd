"""Scaling and dimension reduction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float, float]]:
    """(mean, population deviation, min, max) of each column in one pass."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    return {c: tuple(row[f"{n}_{i}"] or 0.0 for n in ("m", "s", "lo", "hi")) for i, c in enumerate(columns)}


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``z_column`` by the population deviation; 0 for constant columns."""
    m = moments(df, columns)
    return df.withColumns({f"z_{c}": (F.col(c).cast("double") - m[c][0]) / m[c][1] if m[c][1] else F.lit(0.0) for c in columns})


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``mm_column`` in 0..1; 0 for constant columns."""
    m = moments(df, columns)
    return df.withColumns({f"mm_{c}": (F.col(c).cast("double") - m[c][2]) / (m[c][3] - m[c][2]) if m[c][3] > m[c][2] else F.lit(0.0) for c in columns})


def covariance(df: DataFrame, vector: str, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, rows) of an array column; rows with a null vector are left out.

    Each batch of rows becomes one row of sums of products, these are added up in Spark by position, and only the
    size^2 + size + 1 totals reach the driver.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + size + size * size)
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float)
                total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"s": [total.tolist()]})

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(sums, "s array<double>")
    rows = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    t = np.array([r["x"] for r in rows])
    n = int(t[0])
    mean = t[1 : size + 1] / max(n, 1)
    return mean, (t[size + 1 :].reshape(size, size) - n * np.outer(mean, mean)) / max(n - 1, 1), n


def pca(df: DataFrame, key: str, vector: str, size: int, components: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``key, scores``, eigenvalues, eigenvectors): centred, covariance over n - 1, largest first; each vector's largest entry is positive.

    Only the size x size matrix reaches the driver; rows are projected by an expression.
    """
    mean, cov, _ = covariance(df, vector, size)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    vectors = vectors * np.where(signs == 0, 1, signs)
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    score = lambda k: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in vectors[:, k]]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x)
    return df.select(key, F.array(*[score(k) for k in range(components)]).alias("scores")), values, vectors


def explained(values: np.ndarray, share: float = 0.90) -> tuple[np.ndarray, int]:
    """Cumulative share of variance, and how many components reach ``share``."""
    cumulative = np.cumsum(values) / values.sum()
    return cumulative, int(np.searchsorted(cumulative, share - 1e-12) + 1)


def loadings(vectors: np.ndarray, names: Sequence[str], component: int, top: int = 7) -> list[tuple[str, float]]:
    order = np.argsort(-np.abs(vectors[:, component]), kind="stable")[:top]
    return [(names[i], float(vectors[i, component])) for i in order]


def pca_2x2(a: Column, b: Column) -> dict[str, Column]:
    """Eigenvalues and the angle of the first axis of two columns, in closed form, as aggregates."""
    va, vb, c = F.var_samp(a), F.var_samp(b), F.covar_samp(a, b)
    half, root = (va + vb) / 2, F.sqrt(F.pow((va - vb) / 2, F.lit(2.0)) + F.pow(c, F.lit(2.0)))
    return {"lambda1": half + root, "lambda2": half - root, "angle": F.atan2(2 * c, va - vb) / 2}


def lsa(weights: DataFrame, key: str, k: int = 50, more: int = 10, rounds: int = 4) -> DataFrame:
    """``key, lsa``: long-form weights (``key, term, weight``; a bounded number of terms) reduced to ``k`` singular directions, rows scaled to length 1.

    Randomised subspace iteration: the terms x (k + more) basis goes out to all tasks, each batch of rows A gives its part of
    A'(A basis), and the parts are added up by term; rows are projected at the end. The rows stay distributed throughout. Signs of
    directions are arbitrary; a row without weights has no row.
    """
    spark = weights.sparkSession
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # the vocabulary is bounded by the weights' own limit
    if not terms:
        return spark.createDataFrame([], f"{key} {weights.schema[key].dataType.simpleString()}, lsa array<double>")
    place = F.broadcast(spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, t int"))
    rows = weights.join(place, "term").groupBy(key).agg(F.collect_list("t").alias("t"), F.collect_list("weight").alias("w"))
    rows = materialize(rows, "lsa-rows")
    width = min(k + more, len(terms))
    basis = np.linalg.qr(np.random.default_rng(42).standard_normal((len(terms), width)))[0]

    def product(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
        t, w = batch.column("t").flatten().to_numpy(zero_copy_only=False), batch.column("w").flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        y = np.zeros((len(sizes), basis.shape[1]))
        np.add.at(y, of, w[:, None] * basis[t])
        return y, of, t, w

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(basis)

        def gather(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            for batch in batches:
                y, of, t, w = product(batch, sent.value)
                np.add.at(total, t, w[:, None] * y[of])
            used = np.flatnonzero(total.any(axis=1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * total.shape[1], pa.int32()), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["t", "z"])

        parts = rows.select("t", "w").mapInArrow(gather, "t int, z array<double>")
        added = parts.groupBy("t").agg(F.array(*[F.sum(F.get("z", F.lit(c))) for c in range(width)]).alias("z")).collect()
        moved = np.zeros((len(terms), width))
        for r in added:
            moved[r["t"]] = r["z"]
        basis, _, _ = np.linalg.svd(moved, full_matrices=False)
    sent = spark.sparkContext.broadcast(basis[:, :k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, _, _, _ = product(batch, sent.value)
            length = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.divide(y, length, out=np.zeros_like(y), where=length > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "lsa"])

    return rows.select(key, "t", "w").mapInArrow(project, f"{key} {rows.schema[key].dataType.simpleString()}, lsa array<double>")
