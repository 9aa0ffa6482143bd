"""Least squares by power sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``slope, intercept, r2`` in one pass; rows with a null are left out."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polynomial(df: DataFrame, x: str, y: str, degree: int = 2) -> tuple[list[float], float]:
    """(coefficients from the constant up, r2): the moments come from one aggregation, the small system is solved on the driver."""
    v, t = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(v.isNotNull() & t.isNotNull())
    s = rows.agg(F.sum(t * t).alias("yy"), F.sum(t).alias("y"), *[F.sum(F.pow(v, F.lit(float(k)))).alias(f"x{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(v, F.lit(float(k))) * t).alias(f"m{k}") for k in range(degree + 1)]).first()
    a = np.array([[s[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    b = np.array([s[f"m{i}"] for i in range(degree + 1)])
    coefficients = np.linalg.solve(a, b)
    residual = s["yy"] - 2 * coefficients @ b + coefficients @ a @ coefficients
    spread = s["yy"] - s["y"] ** 2 / s["x0"]
    return coefficients.tolist(), float(1 - residual / spread) if spread else 0.0


def monthly(df: DataFrame, ts: str, label: str) -> DataFrame:
    """``month, n, rate`` and ``t``, the months since the first one; rows without a time are left out."""
    grouped = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("month", ts).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
    first = grouped.agg(F.min("month").alias("first"))
    return grouped.join(F.broadcast(first), F.lit(True)).withColumn("t", F.months_between("month", "first").cast("int")).drop("first")
