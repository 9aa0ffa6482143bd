"""Cleaning, joins, sets, windows and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import calendar
from millrace.operators import reduction, rules
from millrace.operators import relational as rel
from millrace.plans.olap_queries import latest_scores
from millrace.plans.registry import query
from millrace.sources import readers, sinks
from millrace.sources.tables import table

_LATEST = "(select submission_id, arg_max(score, computed_at) score, max(lower(risk_level)) risk_level from submission_scores group by 1)"


@query(f"""select s.id, s.ip, len(s.honeypot_hits) honeypot_count, c.score, c.risk_level from submissions s left join {_LATEST} c on s.id = c.submission_id""")
def scored_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").select("id", "ip", F.when(F.col("honeypot_hits").isNotNull(), F.size("honeypot_hits")).cast("long").alias("honeypot_count"))
    return s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left").drop("submission_id")


@query("select id from submissions where id not in (select submission_id from submission_scores where submission_id is not null)")
def unscored_anti(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").select("id")
    return s.join(table(spark, d, "submission_scores"), s["id"] == F.col("submission_id"), "left_anti")


@query("""select distinct f.id from formtrap_spam_clean f where exists (select 1 from formtrap_spam_clean g where g.template_id = f.template_id and g.honeypot_filled = 1)""")
def semi_templates(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean")
    return f.join(f.where("honeypot_filled = 1").select("template_id").distinct(), "template_id", "left_semi").select("id").distinct()


@query("""select template_id from formtrap_spam_clean where honeypot_filled = 1 and template_id is not null intersect select template_id from formtrap_spam_clean where honeypot_filled = 0 and template_id is not null""")
def shared_templates_intersect(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean")
    left, _ = rel.shared_values(f.where("honeypot_filled = 1"), f.where("honeypot_filled = 0"), "template_id")
    return left.select("template_id").distinct()


@query("""select source from documents where doc_kind = 'spam' except all select source from documents where doc_kind = 'page'""")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.where("doc_kind = 'spam'").select("source").exceptAll(x.where("doc_kind = 'page'").select("source"))


@query("select text, 1 as label, 'spam' as src from documents where doc_kind = 'spam' and text is not null union all select message, 0, 'clean' from formtrap_spam_clean where honeypot_filled = 0 and message is not null")
def union_corpus(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("doc_kind = 'spam' and text is not null").select("text", F.lit(1).alias("label"), F.lit("spam").alias("src"))
    y = table(spark, d, "formtrap_spam_clean").where("honeypot_filled = 0 and message is not null").select(F.col("message").alias("text"), F.lit(0).alias("label"), F.lit("clean").alias("src"))
    return x.unionByName(y)


@query("""select id, created_at_us, score, risk_level from (select s.id, epoch_us(s.created_at) created_at_us, c.score, c.risk_level from submissions s left join """ + _LATEST + """ c on s.id = c.submission_id)
 order by created_at_us desc, id desc limit 50""")
def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty with their scores: the limit is the report. It is taken before the join."""
    s = table(spark, d, "submissions").select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    j = s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left")
    return j.select("id", F.unix_micros("created_at").alias("created_at_us"), "score", "risk_level")


@query("""select event_id, count(*) over (partition by user_id order by ts range between interval 10 minutes preceding and current row) recent from events""")
def rate_limit_range(spark: SparkSession, d: str) -> DataFrame:
    return rules.recent_count(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts").select("event_id", "recent")


@query("""select event_id, count(*) over (partition by user_id order by ts range between interval 10 minutes preceding and current row) - 1 as recent from events""")
def rate_limit_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return rules.recent_count(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", include_self=False).select("event_id", "recent")


@query("""select id, count(*) over (partition by ip order by created_at range between interval 10 minutes preceding and current row) recent from submissions where ip is not null""")
def ip_rate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").where("ip is not null").select("id", "ip", "created_at")
    return rules.recent_count(s, "ip", "created_at").select("id", "recent")


@query("""select id, epoch_us(timestamp) ts_us, template_id from (select *, row_number() over (partition by id order by timestamp nulls first, template_id nulls first, message nulls first) r from formtrap_spam_clean) where r = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean")
    first = rel.keep_first(f, ["id"], [F.col("timestamp").asc_nulls_first(), F.col("template_id").asc_nulls_first(), F.col("message").asc_nulls_first()])
    return first.select("id", F.unix_micros("timestamp").alias("ts_us"), "template_id")


@query("""select submission_id, score from (select submission_id, score, row_number() over (partition by submission_id order by computed_at desc, score desc) r from submission_scores) where r = 1""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submission_scores").select("submission_id", "score", "computed_at")
    return rel.keep_first(s, ["submission_id"], [F.desc("computed_at"), F.desc("score")]).select("submission_id", "score")


@query("select submission_id, arg_max(score, computed_at) score from submission_scores where computed_at is not null group by 1")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """First computations as the table, last ones as changes: equal keys take the newer version, keys of either stay."""
    s = table(spark, d, "submission_scores").where("computed_at is not null")
    old = s.groupBy("submission_id").agg(F.min_by("score", "computed_at").alias("score"), F.min("computed_at").alias("v"))
    new = s.groupBy("submission_id").agg(F.max_by("score", "computed_at").alias("score"), F.max("computed_at").alias("v"))
    return sinks.upserted(old, new, ["submission_id"], "v").select("submission_id", "score")


@query("""with n as (select email_domain, count(*) n from formtrap_spam_clean group by 1) select case when f.email_domain is null then 'none' when n.n < 5 then 'other' else f.email_domain end email_domain, count(*) c
 from formtrap_spam_clean f left join n on f.email_domain = n.email_domain group by 1""")
def rare_domain_collapse(spark: SparkSession, d: str) -> DataFrame:
    f = rel.rare_to_other(table(spark, d, "formtrap_spam_clean").select("email_domain"), "email_domain")
    return f.groupBy("email_domain").agg(F.count(F.lit(1)).alias("c"))


@query("""with f as (select id, epoch_us(timestamp) t, coalesce(honeypot_filled, 0) h, row_number() over (order by timestamp, id, template_id, message) k from formtrap_spam_clean where timestamp is not null),
 r as (select *, sum(h) over (order by k) run from f) select cast(run as bigint) run, count(*) as rows, min(t) start_us, max(t) end_us from r where h = 0 group by 1""")
def longest_run_islands(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of submissions without a filled trap; the longest is the first by ``rows``."""
    f = table(spark, d, "formtrap_spam_clean").where("timestamp is not null")
    r = rel.runs(f, ["timestamp", "id", "template_id", "message", "honeypot_filled"], F.coalesce("honeypot_filled", F.lit(0)))
    return r.select("run", "rows", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"))


@query("select honeypot_reliable, count(*) n, count(honeypot_filled) labelled, cast(sum(honeypot_filled) as bigint) hits, round(avg(honeypot_filled), 6) rate from formtrap_spam_clean group by 1")
def tri_state_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "formtrap_spam_clean").groupBy("honeypot_reliable").agg(F.count(F.lit(1)).alias("n"), F.count("honeypot_filled").alias("labelled"), F.sum("honeypot_filled").alias("hits"), F.round(F.avg("honeypot_filled"), 6).alias("rate"))


@query("select id, case when honeypot_reliable = 1 then honeypot_filled end masked_label from formtrap_spam_clean")
def masked_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels outside the reliable window become unknown."""
    return table(spark, d, "formtrap_spam_clean").select("id", F.when(F.col("honeypot_reliable") == 1, F.col("honeypot_filled")).alias("masked_label"))


@query("""select case when n_chars <= 0 then null when n_chars <= 200 then 'short' when n_chars <= 600 then 'medium' when n_chars <= 5000 then 'long' end len_bin, count(*) n, round(avg(n_chars), 6) mean_chars from documents where n_chars is not null group by 1""")
def len_bin_rates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("n_chars is not null")
    return x.groupBy(rel.cut(F.col("n_chars"), [0, 200, 600, 5000], ["short", "medium", "long"]).alias("len_bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("select doc_id, (doc_kind = 'note')::int doc_kind_note, (doc_kind = 'page')::int doc_kind_page, (doc_kind = 'spam')::int doc_kind_spam from documents where doc_kind is not null")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    x = rel.one_hot(table(spark, d, "documents").where("doc_kind is not null").select("doc_id", "doc_kind"), "doc_kind", ["note", "page", "spam"])
    return x.drop("doc_kind")


@query("""with m as (select avg(l_quantity) m, stddev_pop(l_quantity) s, min(l_quantity) lo, max(l_quantity) hi from lineitem) select l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) z_l_quantity, round((l_quantity - lo) / (hi - lo), 6) mm_l_quantity from lineitem, m""")
def zscore_minmax(spark: SparkSession, d: str) -> DataFrame:
    x = reduction.min_max(reduction.z_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]), ["l_quantity"])
    return x.select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 6).alias("z_l_quantity"), F.round("mm_l_quantity", 6).alias("mm_l_quantity"))


@query("""select id, coalesce(nullif(trim(raw_payload.name), ''), nullif(split_part(raw_payload.email, '@', 1), '')) who, nullif(concat_ws(chr(10), raw_payload.subject, raw_payload.message), '') body from submissions""")
def name_coalesce(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions")
    who = rel.full_name(F.col("raw_payload.name"), F.split_part(F.col("raw_payload.email"), F.lit("@"), F.lit(1)))
    return s.select("id", F.nullif(who, F.lit("")).alias("who"), rel.joined_lines(F.col("raw_payload.subject"), F.col("raw_payload.message")).alias("body"))


@query("""select coalesce(nullif(trim(raw_payload.email), ''), nullif(trim(raw_payload.website_url), '')) contact, cast(id as varchar) rid from submissions""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").select("id", F.col("raw_payload.email").alias("E-Mail"), F.col("raw_payload.website_url").alias("Website"))
    return readers.resolve_aliases(s, {"contact": ["email", "e-mail", "website"], "rid": ["ID", "row"]})


@query("""select id, year(ts) as year, quarter(ts) as quarter, month(ts) as month, dayname(ts) as weekday, hour(ts) as hour, ['night', 'morning', 'afternoon', 'evening'][hour(ts) // 6 + 1] part_of_day, strftime(ts, '%Y-%m') year_month,
 concat(year(ts), ' Q', quarter(ts)) quarter_label from (select id, created_at at time zone 'UTC' ts from submissions)""")
def time_parts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions")
    return s.select("id", *[c.alias(k) for k, c in calendar.parts(F.col("created_at")).items()], calendar.quarter_label(F.col("created_at")).alias("quarter_label"))


@query("""select id, server_received_ms - cast(raw_payload.form_render_time as bigint) as shown_ms, floor((server_received_ms * 1000 - epoch_us(created_at)) / 86400000000.0)::bigint days_late from submissions
 where try_cast(raw_payload.form_render_time as bigint) is not null""")
def render_times(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").withColumn("form_ms", F.col("raw_payload.form_render_time").try_cast("long")).where("form_ms is not null")
    return s.select("id", calendar.render_time(F.col("server_received_ms"), F.col("form_ms")).alias("shown_ms"), calendar.whole_days(F.col("created_at"), F.timestamp_millis("server_received_ms")).alias("days_late"))


@query("""with r as (select id, signature_hash, unnest(sample_submission_ids) sid from signatures) select signature_hash, count(*) n, min(sid) lo, max(sid) hi from r group by 1""")
def explode_samples(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "signatures").select("signature_hash", F.explode("sample_submission_ids").alias("sid"))
    return r.groupBy("signature_hash").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))


@query("""select c.id, count(*) members, cast(sum(s.occurrence) as bigint) occurrences from (select id, unnest(signature_ids) sid from clusters) c join signatures s on c.sid = s.id group by 1""")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.signatures import members

    m = members(table(spark, d, "clusters"), table(spark, d, "signatures"))
    return m.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("members"), F.sum("occurrence").alias("occurrences"))


@query("""select id, list_transform(list_slice(list_sort(list_distinct(list_transform(string_split(coalesce(raw_payload.subject, ''), ' '), lambda x: lower(x)))), 1, 3), lambda x: x).list_aggregate('string_agg', '|') words from submissions""")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    w = F.slice(F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce("raw_payload.subject", F.lit("")), " "), F.lower))), 1, 3)
    return table(spark, d, "submissions").select("id", F.array_join(w, "|").alias("words"))


@query("""select id, json_extract_string(try_cast(flags as json), '$.bot_likely') bot, json_extract_string(try_cast(flags as json), '$.fast') fast from submissions where try_cast(flags as json) is not null and flags like '{%'""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import jsonlike

    s = table(spark, d, "submissions").where(F.col("flags").startswith("{") & F.try_parse_json("flags").isNotNull())
    return s.select("id", jsonlike.field(F.col("flags"), "bot_likely").alias("bot"), jsonlike.field(F.col("flags"), "fast").alias("fast"))


@query("""select id, element_at(request_headers, 'accept-language')[1] as lang, cardinality(request_headers) n_headers from submissions where request_headers is not null""")
def header_map(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").where("request_headers is not null")
    return s.select("id", F.element_at("request_headers", "accept-language").alias("lang"), F.size("request_headers").cast("long").alias("n_headers"))


@query("""select count(*) n from submissions where lower(coalesce(raw_payload.message, '')) like '%casino%' and client_render_time >= 2000""")
def parameterised_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "submissions").createOrReplaceTempView("millrace_submissions")
    return readers.query(spark, "select count(*) n from millrace_submissions where lower(coalesce(raw_payload.message, '')) like :what and client_render_time >= :least", what="%casino%", least=2000)


@query()
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents without replacement, the same on every run."""
    return rel.sample_n(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


@query()
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    x = rel.split_by_hash(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_id", 0.2, "doc_kind")
    return x.groupBy("doc_kind", "in_test").count()


@query("""select user_id, string_agg(cast(event_id as varchar), ',' order by ts, event_id) items from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10 group by 1""")
def last_ten(spark: SparkSession, d: str) -> DataFrame:
    x = rel.last_n(table(spark, d, "events"), "user_id", "ts", "event_id", 10)
    return x.select("user_id", F.array_join(F.transform("items", lambda v: v.cast("string")), ",").alias("items"))


@query("""select event_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) diff, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) running from events""")
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("""select risk_level, n from (values ('low'), ('medium'), ('high'), ('critical')) v(risk_level) join (select v2.r, (select count(*) from """ + _LATEST + """ c where c.risk_level = v2.r) n from (values ('low'), ('medium'), ('high'), ('critical')) v2(r)) x on x.r = v.risk_level""")
def risk_distribution_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    counts = latest_scores(spark, d).where("risk_level is not null").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return rel.zero_filled(counts, "risk_level", ["low", "medium", "high", "critical"], "n")


