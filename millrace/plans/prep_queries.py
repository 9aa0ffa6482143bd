"""Preparation pipelines over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import prep
from millrace.plans.registry import query
from millrace.sources.tables import table


def raw_export(spark: SparkSession, d: str) -> DataFrame:
    """Submissions in the shape of a raw export."""
    p = "raw_payload"
    null = F.lit(None).cast("string")
    return table(spark, d, "submissions").select(
        F.col("id").alias("src_row"), F.col("created_at").alias("ts"), null.alias("first"), null.alias("middle"), null.alias("last"), F.col(f"{p}.name").alias("full"), F.col(f"{p}.email").alias("email"),
        F.col(f"{p}.phone").alias("phone"), F.col(f"{p}.subject").alias("subject"), F.col(f"{p}.message").alias("message"), F.col(f"{p}.website_url").alias("trap"),
    )


_CELL = r"nullif(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_CELLS = ", ".join(f"{_CELL.format(f'raw_payload.{c}')} {a}" for c, a in (("name", "name"), ("email", "email"), ("phone", "phone"), ("subject", "subject"), ("message", "body"), ("website_url", "trap")))


@query(f"""with c as (select id src_row, created_at ts, {_CELLS} from submissions), m as (select *, case when subject is null and body is null then null else concat_ws(chr(10), subject, body) end message from c),
 k as (select *, row_number() over (partition by ts, name, email, phone, message, trap order by src_row) r from m where coalesce(name, email, phone, message) is not null)
 select row_number() over (order by src_row) id, epoch_us(ts) us, case when ts is null then 'B_legacy' else 'A_timestamped' end source_block, case when ts is null then 'legacy_export' else 'v2_full_name' end form_version, md5(coalesce(name, '')) name, md5(coalesce(email, '')) email, md5(coalesce(phone, '')) phone,
 md5(coalesce(message, '')) message, case when ts is not null then (trap is not null)::int end honeypot_filled from k where r = 1""")
def clean_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Every cleaned row, its texts as digests."""
    c = prep.clean(raw_export(spark, d))
    digests = [F.md5(F.coalesce(x, F.lit(""))).alias(x) for x in ("name", "email", "phone", "message")]
    return c.select("id", F.unix_micros("timestamp").alias("us"), "source_block", "form_version", *digests, "honeypot_filled")


@query()
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Every text, contact and time feature of the cleaned submissions."""
    return prep.features(prep.clean(raw_export(spark, d)))


_WINDOW = """t as (select timestamp ts, id, honeypot_filled h, sum(coalesce(honeypot_filled, 0)) over (order by timestamp, id, honeypot_filled nulls first rows unbounded preceding) run from formtrap_spam_clean where timestamp is not null),
 r as (select run, count(*) n, min(ts) lo, max(ts) hi from t where coalesce(h, 0) = 0 group by 1), o as (select *, row_number() over (order by n desc, lo) k from r)"""


@query(f"with {_WINDOW} select lo as start_at, hi as end_at, n as rows, (select n from o where k = 2) next_rows, ((epoch_us(hi) - epoch_us(lo)) // 86400000000)::int as days from o where k = 1")
def unrecorded_window(spark: SparkSession, d: str) -> DataFrame:
    return prep.unrecorded_window(table(spark, d, "formtrap_spam_clean"))


@query(f"""with {_WINDOW}, w as (select lo, hi from o where k = 1), e as (select case when ts between lo and hi then 'inside' when ts < lo and ts >= lo - interval 90 days then 'before' when ts > hi and ts <= hi + interval 90 days then 'after' end part, h from t, w),
 g as (select part, count(*) n, coalesce(sum(h), 0)::bigint hits, avg(h) rate from e where part is not null group by 1)
 select part, n as rows, hits, round(rate, 6) rate, case when part = 'inside' then round(pow(1 - (select rate from g where part = 'before'), n), 9) end no_hit from g""")
def label_evidence(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean")
    e = prep.label_evidence(f, prep.unrecorded_window(f))
    return e.withColumn("rate", F.round("rate", 6)).withColumn("no_hit", F.round("no_hit", 9))


@query()
def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("text", "doc_kind").where("text is not null")
    return prep.labelled_corpus(x.where("doc_kind = 'spam'"), x.where("doc_kind <> 'spam'"))


@query("""select 'ip' column_name, count(*) - count(ip) nulls, count(distinct ip) distinct_values from submissions union all select 'form_name', count(*) - count(form_name), count(distinct form_name) from submissions
 union all select 'normalized_text', count(*) - count(normalized_text), count(distinct normalized_text) from submissions""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return prep.quality_report(table(spark, d, "submissions").select("ip", "form_name", "normalized_text"))


@query("""select round(avg(cast(json_extract(props, '$.k') as double)), 6) mean_k from (select props from events order by ts desc, event_id desc limit 10)""")
def recent_json_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a JSON number over the last ten events: the limit is the report."""
    last = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    return last.agg(F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))
