"""Cubes of additive measures: roll-up, drill-down, slice, dice, pivot, totals, timelines and spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

#: Measures of a fact table with a tri-state label: rows, labelled rows, hits. All are sums, so they re-aggregate exactly.
LABEL_MEASURES = {"submissions": F.count, "labelled": F.count, "hits": F.sum}


@dataclass
class Cube:
    """Pre-aggregated cells over ``dims``; every later operation reads cells only, never the facts."""

    cells: DataFrame
    dims: Sequence[str]
    measures: Sequence[str]
    rates: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def build(cls, facts: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Column], rates: Mapping[str, tuple[str, str]] | None = None, keep: bool = False) -> Cube:
        """``measures`` are aggregate Columns that sum up (counts and sums); ``rates`` name quotients of two measures."""
        named = facts.select(*[c.alias(f"_d_{k}") for k, c in dims.items()], "*")
        cells = named.groupBy(*[F.col(f"_d_{k}").alias(k) for k in dims]).agg(*[c.alias(k) for k, c in measures.items()])
        return cls(materialize(cells, "cube") if keep else cells, list(dims), list(measures), dict(rates or {}))

    def _rated(self, df: DataFrame) -> DataFrame:
        """A rate is null where its denominator is 0."""
        return df.withColumns({k: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for k, (a, b) in self.rates.items()}) if self.rates else df

    def _sums(self) -> list[Column]:
        return [F.sum(m).alias(m) for m in self.measures]

    def roll_up(self, *dims: str) -> DataFrame:
        """Cells summed over all dimensions but ``dims``."""
        return self._rated(self.cells.groupBy(*dims).agg(*self._sums()))

    def drill_down(self, where: Column, *dims: str) -> DataFrame:
        """A part of the cube by finer dimensions."""
        return self._rated(self.cells.where(where).groupBy(*dims).agg(*self._sums()))

    def slice(self, dim: str, value: object, *dims: str) -> DataFrame:
        """One value of one dimension."""
        return self.drill_down(F.col(dim) == value, *dims)

    def dice(self, keep: Mapping[str, Sequence[object]], *dims: str) -> DataFrame:
        """Sets of values of several dimensions."""
        where = F.lit(True)
        for d, values in keep.items():
            where &= F.col(d).isin(list(values))
        return self.drill_down(where, *dims)

    def pivot(self, row: str, column: str, values: Sequence[object], measure: str) -> DataFrame:
        """``measure`` as a grid; the values are given, so no extra pass finds them. Missing cells are 0."""
        return self.cells.groupBy(row).pivot(column, list(values)).agg(F.sum(measure)).na.fill(0)

    def with_totals(self, *dims: str) -> DataFrame:
        """Roll-up with subtotals and the total: ``is_total``, ``is_subtotal`` mark them, rolled-up values are null."""
        level = F.grouping_id()
        rolled = self.cells.rollup(*dims).agg(*self._sums(), level.alias("_g"))
        top = (1 << len(dims)) - 1
        return self._rated(rolled).select("*", (F.col("_g") == top).alias("is_total"), ((F.col("_g") > 0) & (F.col("_g") < top)).alias("is_subtotal")).drop("_g")

    def all_combinations(self, *dims: str) -> DataFrame:
        """Every combination of ``dims`` kept or summed away, with ``level``, the grouping id."""
        return self._rated(self.cells.cube(*dims).agg(*self._sums(), F.grouping_id().cast("long").alias("level")))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def quantiles(df: DataFrame, group: Sequence[str], column: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles by group; for groups with a large share of all rows use the hot-key selection."""
    return df.groupBy(*group).agg(*[F.percentile(column, F.lit(p)).alias(k) for k, p in probs.items()], F.max(column).alias("largest"))


def mode(df: DataFrame, group: str, column: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones; nulls don't count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(group).agg(F.max("n").alias("n"))
    return counted.join(top, [group, "n"]).groupBy(group).agg(F.min(column).alias("mode"), F.max("n").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """``a, b, r`` of each pair of columns in one pass, strongest first; pairs with a constant column have no row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")
    return one.select(rows).select("p.*").where(F.col("r").isNotNull() & (F.abs("r") >= least)).orderBy(F.desc(F.abs("r")), "a", "b")


def timeline(df: DataFrame, ts: str, unit: str, as_of: Column, amount: int, aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates by minute, hour or day over the ``amount`` units before ``as_of`` (a parameter, never the clock)."""
    from millrace.functions.calendar import bucket

    since = as_of - F.expr(f"interval {amount} {unit}")
    return df.where((F.col(ts) >= since) & (F.col(ts) <= as_of)).groupBy(bucket(F.col(ts), unit).alias("date")).agg(*[c.alias(k) for k, c in aggs.items()])


def month_spine(df: DataFrame, month: str, measures: Sequence[str], fill: int | None = None) -> DataFrame:
    """One row for each month between the first and the last; gaps are null, or ``fill``."""
    ends = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    spine = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(month))
    out = spine.join(df, month, "left")
    return out.na.fill(fill, list(measures)) if fill is not None else out


def suppressed(rate: Column, count: Column, least: int) -> Column:
    """A rate over fewer than ``least`` rows is null."""
    return F.when(count >= least, rate)
