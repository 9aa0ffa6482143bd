"""Cubes, aggregates and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import calendar
from millrace.operators import olap
from millrace.operators import relational as rel
from millrace.plans.registry import query
from millrace.sources.tables import table


def measures() -> dict[str, Column]:
    """Aggregates of a tri-state label: null is unknown and never counts as 0."""
    return {"submissions": F.count(F.lit(1)), "labelled": F.count("honeypot_filled"), "hits": F.sum("honeypot_filled").cast("long")}


RATE = {"hit_rate": ("hits", "labelled")}
_FACT = "(select *, timestamp at time zone 'UTC' ts from formtrap_spam_clean where timestamp is not null)"
_AGG = "count(*) submissions, count(honeypot_filled) labelled, cast(sum(honeypot_filled) as bigint) hits"
_RATE = "case when labelled = 0 then null else round(hits * 1.0 / labelled, 6) end hit_rate"


def label_cube(spark: SparkSession, d: str) -> olap.Cube:
    """Cells by year, quarter, month, part of day, script and form version."""
    facts = table(spark, d, "formtrap_spam_clean").where("timestamp is not null")
    parts = calendar.parts(F.col("timestamp"))
    dims = {k: parts[k] for k in ("year", "quarter", "month", "part_of_day")} | {"script": F.col("script"), "form_version": F.col("form_version")}
    return olap.Cube.build(facts, dims, measures(), RATE)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"""select year(ts) as year, quarter(ts) as quarter, month(ts) as month, ['night', 'morning', 'afternoon', 'evening'][hour(ts) // 6 + 1] part_of_day, script, form_version, {_AGG} from {_FACT} group by all""")
def cube_base(spark: SparkSession, d: str) -> DataFrame:
    return label_cube(spark, d).cells


@query(f"select *, {_RATE} from (select year(ts) as year, {_AGG} from {_FACT} group by 1)")
def rollup_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).roll_up("year"))


@query(f"select *, {_RATE} from (select year(ts) as year, quarter(ts) as quarter, {_AGG} from {_FACT} group by 1, 2)")
def rollup_quarter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).roll_up("year", "quarter"))


@query(f"select *, {_RATE} from (select quarter(ts) as quarter, month(ts) as month, {_AGG} from {_FACT} where year(ts) = 2023 group by 1, 2)")
def drill_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).drill_down(F.col("year") == 2023, "quarter", "month"))


@query(f"select *, {_RATE} from (select year(ts) as year, part_of_day, {_AGG} from (select *, ['night', 'morning', 'afternoon', 'evening'][hour(ts) // 6 + 1] part_of_day from {_FACT}) where script = 'cyrillic' group by 1, 2)")
def slice_script(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).slice("script", "cyrillic", "year", "part_of_day"))


@query(f"select *, {_RATE} from (select script, form_version, {_AGG} from {_FACT} where script in ('latin', 'other') and year(ts) in (2022, 2024) group by 1, 2)")
def dice_script_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).dice({"script": ["latin", "other"], "year": [2022, 2024]}, "script", "form_version"))


@query(f"""select year(ts) as year, count(*) filter (where script = 'latin') latin, count(*) filter (where script = 'cyrillic') cyrillic, count(*) filter (where script = 'other') other,
 count(*) filter (where script = 'none') "none" from {_FACT} group by 1""")
def dice_pivot(spark: SparkSession, d: str) -> DataFrame:
    return label_cube(spark, d).pivot("year", "script", ["latin", "cyrillic", "other", "none"], "submissions")


@query(f"""select *, {_RATE} from (select year(ts) as year, script, {_AGG}, grouping_id(year(ts), script) = 3 is_total, grouping_id(year(ts), script) = 1 is_subtotal
 from {_FACT} group by rollup (year(ts), script))""")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).with_totals("year", "script"))


@query(f"select *, {_RATE} from (select year(ts) as year, script, {_AGG}, cast(grouping_id(year(ts), script) as bigint) as level from {_FACT} group by cube (year(ts), script))")
def cube_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(label_cube(spark, d).all_combinations("year", "script"))


_SCORED = """(select s.id, s.form_name, s.honeypot_hits, c.score, c.risk_level, strftime(s.created_at at time zone 'UTC', '%Y-%m') period
 from submissions s left join (select submission_id, arg_max(score, computed_at) score, max(lower(risk_level)) risk_level from submission_scores group by 1) c on s.id = c.submission_id)"""


def latest_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row a submission: rows written twice collapse, the newest of several computations wins."""
    s = table(spark, d, "submission_scores")
    return s.groupBy("submission_id").agg(F.max_by("score", "computed_at").alias("score"), F.max(F.lower("risk_level")).alias("risk_level"))


@query(f"""select period, grp, submissions, scored, trapped, is_total, is_subtotal from (select period, coalesce(risk_level, 'unscored') grp, count(*) submissions, count(score) scored,
 count(*) filter (where len(honeypot_hits) > 0) trapped, grouping_id(period, coalesce(risk_level, 'unscored')) = 3 is_total, grouping_id(period, coalesce(risk_level, 'unscored')) = 1 is_subtotal
 from {_SCORED} group by rollup (period, coalesce(risk_level, 'unscored')))""")
def olap_left_join_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Submissions by month and risk, with subtotals; those without a score stay as ``unscored``."""
    s = table(spark, d, "submissions").select("id", "created_at", "honeypot_hits")
    j = s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left")
    cube = olap.Cube.build(
        j, {"period": F.date_format("created_at", "yyyy-MM"), "grp": F.coalesce("risk_level", F.lit("unscored"))},
        {"submissions": F.count(F.lit(1)), "scored": F.count("score"), "trapped": F.count_if(F.size("honeypot_hits") > 0)},
    )
    return cube.with_totals("period", "grp")


def _timeline_sql(fmt: str, since: str) -> str:
    return f"""select strftime(created_at at time zone 'UTC', '{fmt}') as date, count(*) total, count(*) filter (where len(honeypot_hits) > 0) honeypot_triggered from submissions
 where created_at at time zone 'UTC' between timestamp '2024-07-01 00:00:00' - interval '{since}' and timestamp '2024-07-01 00:00:00' group by 1"""


def _timeline(spark: SparkSession, d: str, text: str) -> DataFrame:
    amount, unit = calendar.parse_range(text)
    aggs = {"total": F.count(F.lit(1)), "honeypot_triggered": F.count_if(F.size("honeypot_hits") > 0)}
    return olap.timeline(table(spark, d, "submissions"), "created_at", unit, F.lit("2024-07-01 00:00:00").cast("timestamp"), amount, aggs)


@query(_timeline_sql("%Y-%m-%d", "30 day"))
def timeline_day(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d, "30d")


@query(_timeline_sql("%Y-%m-%d %H:00:00", "96 hour"))
def timeline_hour(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d, "96h")


@query(_timeline_sql("%Y-%m-%d %H:%M:00", "3000 minute"))
def timeline_minute(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d, "3000m")


@query(f"""with m as (select date_trunc('month', ts) as month, count(*) n, avg(honeypot_filled) r, count(honeypot_filled) c from {_FACT} where script = 'none' group by 1),
 s as (select unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month)) as month)
 select strftime(s.month, '%Y-%m') as month, m.n, case when m.c >= 3 then round(m.r, 6) end rate from s left join m on s.month = m.month""")
def calendar_spine_gap(spark: SparkSession, d: str) -> DataFrame:
    """Months without rows stay, with null; rates over fewer than three labelled rows are null."""
    f = table(spark, d, "formtrap_spam_clean").where("timestamp is not null and script = 'none'")
    m = f.groupBy(F.date_trunc("month", "timestamp").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("honeypot_filled").alias("r"), F.count("honeypot_filled").alias("c"))
    spine = olap.month_spine(m, "month", ["n"])
    return spine.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.round(olap.suppressed(F.col("r"), F.col("c"), 3), 6).alias("rate"))


@query(f"""with m as (select date_trunc('month', ts) as month, count(*) n, avg(honeypot_filled) rate from {_FACT} group by 1)
 select strftime(month, '%Y-%m') as month, n, round(rate, 6) rate, cast(datediff('month', (select min(month) from m), month) as integer) t from m""")
def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.regression import monthly

    m = monthly(table(spark, d, "formtrap_spam_clean"), "timestamp", "honeypot_filled")
    return m.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.round("rate", 6).alias("rate"), "t")


@query("select form_version, count(*) filter (where script = 'latin') latin, count(*) filter (where script = 'cyrillic') cyrillic, count(*) filter (where script = 'other') other from formtrap_spam_clean group by 1")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return olap.crosstab(table(spark, d, "formtrap_spam_clean"), "form_version", "script", ["latin", "cyrillic", "other"])


@query("select doc_kind, round(quantile_cont(n_chars, 0.5), 6) p50, round(quantile_cont(n_chars, 0.95), 6) p95, round(quantile_cont(n_chars, 0.99), 6) p99, max(n_chars) largest from documents where n_chars is not null group by 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = olap.quantiles(table(spark, d, "documents").where("n_chars is not null"), ["doc_kind"], "n_chars", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("doc_kind", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "largest")


@query("select doc_kind, round(median(n_chars), 6) median_chars from documents where n_chars is not null group by 1")
def median_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars is not null").groupBy("doc_kind").agg(F.round(F.median("n_chars"), 6).alias("median_chars"))


@query("""select doc_kind, mode, n from (select doc_kind, source as mode, count(*) n, row_number() over (partition by doc_kind order by count(*) desc, source) r
 from documents where source is not null group by 1, 2) where r = 1""")
def mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return olap.mode(table(spark, d, "documents"), "doc_kind", "source")


@query("""with x as (select l_quantity q, l_extendedprice p, l_discount c, l_tax t from lineitem)
 select * from (select 'l_quantity' a, 'l_extendedprice' b, round(corr(q, p), 6) r from x union all select 'l_quantity', 'l_discount', round(corr(q, c), 6) from x
 union all select 'l_quantity', 'l_tax', round(corr(q, t), 6) from x union all select 'l_extendedprice', 'l_discount', round(corr(p, c), 6) from x
 union all select 'l_extendedprice', 'l_tax', round(corr(p, t), 6) from x union all select 'l_discount', 'l_tax', round(corr(c, t), 6) from x)""")
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = olap.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return c.select("a", "b", F.round("r", 6).alias("r"))


@query("select source, count(*) n from documents group by 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return olap.value_counts(table(spark, d, "documents"), "source")


@query("select 'text' column_name, count(*) - count(text) nulls from documents union all select 'lang', count(*) - count(lang) from documents union all select 'received_at', count(*) - count(received_at) from documents")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return rel.null_counts(table(spark, d, "documents").select("text", "lang", "received_at")).select("column_name", F.col("nulls").cast("long").alias("nulls"))


@query("select count(distinct source) sources, count(distinct lang) langs, count(distinct text) texts from documents")
def count_distincts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"))


@query("""select n_name, year(o_orderdate) as year, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey where r_name = 'EUROPE' group by 1, 2""")
def star_join_year(spark: SparkSession, d: str) -> DataFrame:
    """A star join: the small dimensions are of fixed size (25 nations, 5 regions) and left to the optimiser, which broadcasts them by their size."""
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    j = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
