"""Arrival of submissions and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import ingest, relational, similarity
from millrace.plans.registry import query
from millrace.plans.rule_queries import _S
from millrace.plans.text_queries import _TEMPLATE
from millrace.sources.tables import table

_P = "raw_payload"
_ABSENT = "coalesce({0}, '') in ('', '0')"


def _absent(field: str) -> str:
    return _ABSENT.format(field)


_SIZE = " + ".join(f"coalesce(strlen({_P}.{f}), 0)" for f in ("name", "email", "subject", "message", "phone", "website_url", "company_code", "security_token", "form_render_time"))
_REASON = f"case when {_P} is null then 'no payload' when {_SIZE} > {ingest.MAX_PAYLOAD} then 'too large' {' '.join(f"when {_absent(f'{_P}.{f}')} then 'missing {f}'" for f in ingest.REQUIRED)} end"


@query(f"select coalesce({_REASON}, 'valid') reason, count(*) n from submissions group by 1")
def ingest_validation(spark: SparkSession, d: str) -> DataFrame:
    """How many submissions would be taken, and why others would not."""
    s = ingest.accepted(table(spark, d, "submissions").select(_P))
    return s.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_HITS = f"list_filter([case when not {_absent(f'{_P}.website_url')} then 'website_url' end, case when not {_absent(f'{_P}.company_code')} then 'company_code' end, case when {_absent(f'{_P}.security_token')} then 'security_token_missing' end], lambda x: x is not null)"


@query(f"select id, list_aggregate(list_concat({_HITS}, ['']), 'string_agg', ' ') hits from submissions")
def trap_extraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").select("id", F.array_join(F.concat(ingest.trap_hits(), F.array(F.lit(""))), " ").alias("hits"))


_REPEATED = (
    "(coalesce(list_bool_or(list_transform(list_filter(list_distinct(string_split({0}, '')), lambda c: c not in ('', chr(10), chr(13), chr(133), chr(8232), chr(8233))), lambda c: contains({0}, repeat(c, 11)))), false)"
    " or coalesce(list_max(map_values(list_aggregate(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w not in ('', '0')), 'histogram'))), 0) >= 10)"
)
_FLAGS = {
    "honeypot_triggered": f"len({_HITS}) > 0", "rapid_submission": f"coalesce(client_render_time < {ingest.FAST}, false)", "extremely_rapid": f"coalesce(client_render_time < {ingest.FASTEST}, false)",
    "bot_user_agent": "(" + " or ".join(f"contains(lower(coalesce(user_agent, '')), '{w}')" for w in ingest.AGENTS) + ")", "no_referer": _absent("referer"),
    "invalid_email": rf"({_P}.email is not null and not regexp_full_match({_P}.email, '{tx.EMAIL}'))", "repetitive_content": _REPEATED.format(f"coalesce({_P}.message, '')"),
}
_KINDS = {f: " || ".join(f"case when regexp_matches(coalesce({_P}.{f}, ''), '{p}') then '{k} ' else '' end" for k, p in tx.ATTACKS.items()) for f in ingest.REQUIRED}


@query(f"select id, {', '.join(f'{v} {k}' for k, v in _FLAGS.items())}, {', '.join(f'{v} suspicious_pattern_{k}' for k, v in _KINDS.items())} from submissions")
def submission_flags(spark: SparkSession, d: str) -> DataFrame:
    """Eight kinds of flags of every submission."""
    columns = [F.array_join(F.transform(v, lambda k: F.concat(k, F.lit(" "))), "").alias(k) if k.startswith("suspicious") else v.alias(k) for k, v in ingest.flags().items()]
    return table(spark, d, "submissions").select("id", *columns)


_IPS = [f"trim(split_part(element_at(request_headers, '{h}')[1], ',', 1))" for h in ingest.IP_HEADERS]


@query(f"select id, coalesce({', '.join(f"case when regexp_matches({x}, '{ingest.ADDRESS}') then {x} end" for x in _IPS)}, '0.0.0.0') client_ip from submissions")
def client_ips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").select("id", ingest.client_ip(F.col("request_headers")).alias("client_ip"))


@query(f"""select s.id, s.t as template, sha256(s.t) signature_hash, coalesce(g.occurrence, 0) occurrence, greatest(w - 2, 0) trigrams from (select id, {_TEMPLATE.format('normalized_text')} t,
 len(list_filter(regexp_split_to_array(coalesce(normalized_text, ''), '\\s+'), lambda x: x not in ('', '0'))) w from submissions where id % 100 = 0) s left join (select signature_hash, max(occurrence) occurrence from signatures group by 1) g on g.signature_hash = sha256(s.t)""")
def submission_detail(spark: SparkSession, d: str) -> DataFrame:
    """Template, signature and trigrams of the submissions asked for: those with an id divisible by 100."""
    s = table(spark, d, "submissions").select("id", "normalized_text")
    return ingest.detail(s, table(spark, d, "signatures"), s.where("id % 100 = 0").select("id"))


@query("select id, signature_hash, occurrence from signatures where id = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One row by its key; the filter reaches the scan."""
    return table(spark, d, "signatures").where("id = 7").select("id", "signature_hash", "occurrence")


@query("""select c.id, c.cluster_label, len(c.signature_ids)::int signatures, sum(s.occurrence)::bigint occurrences, count(s.id) known from clusters c left join (select id, unnest(list_distinct(signature_ids)) sid from clusters) m on m.id = c.id
 left join signatures s on s.id = m.sid group by c.id, c.cluster_label, c.signature_ids""")
def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with the number of its signatures, how many are known, and how often they occurred."""
    c = table(spark, d, "clusters").select("id", "cluster_label", F.when(F.col("signature_ids").isNotNull(), F.size("signature_ids")).alias("signatures"), "signature_ids")
    m = c.select("id", F.explode(F.array_distinct("signature_ids")).alias("sid")).join(table(spark, d, "signatures").select(F.col("id").alias("sid"), "occurrence"), "sid")
    g = m.groupBy("id").agg(F.sum("occurrence").alias("occurrences"), F.count(F.lit(1)).alias("known"))
    return c.drop("signature_ids").join(g, "id", "left").withColumn("known", F.coalesce("known", F.lit(0)))


_N = "(select count(*) from submissions)"
_REPORT = [
    ("total_submissions", "count(*) from submissions", lambda s: F.count(F.lit(1))), ("honeypot_triggered", "count(*) from submissions where len(honeypot_hits) > 0", lambda s: F.count_if(F.size("honeypot_hits") > 0)),
    *[(f"trap_{f}", f"count(*) from submissions where list_has_any(honeypot_hits, ['{f}', '{f}_missing'])", lambda s, f=f: F.count_if(F.arrays_overlap("honeypot_hits", F.array(F.lit(f), F.lit(f"{f}_missing"))))) for f in (*ingest.TRAPS, ingest.TIME_TRAP)],
]


@query(f"""{' union all '.join(f"select '{k}' metric, {x.replace(' from ', '::double as value from ', 1)}" for k, x, _ in _REPORT)} union all select 'high_risk', count(*)::double from {_S} where risk_level in ('high', 'critical')
 union all select 'average_score', round(avg(score), 4) from {_S} union all select 'signatures', count(*)::double from signatures union all select 'average_occurrence', round(avg(occurrence), 4) from signatures union all select 'largest_occurrence', max(occurrence)::double from signatures
 union all select 'pattern_coverage', round(sum(case when occurrence >= 3 then occurrence end) * 100.0 / {_N}, 2) from signatures""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The metric rows of the evaluation, long form."""
    from millrace.plans.olap_queries import latest_scores

    s, g, c = table(spark, d, "submissions"), table(spark, d, "signatures"), latest_scores(spark, d)
    long = lambda df, m: df.agg(*[v.cast("double").alias(k) for k, v in m.items()]).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*m))).alias("metric", "value"))
    rows = long(s, {k: f(s) for k, _, f in _REPORT})
    rows = rows.unionByName(long(c, {"high_risk": F.count_if(F.col("risk_level").isin("high", "critical")), "average_score": F.round(F.avg("score"), 4)}))
    rows = rows.unionByName(long(g, {"signatures": F.count(F.lit(1)), "average_occurrence": F.round(F.avg("occurrence"), 4), "largest_occurrence": F.max("occurrence")}))
    covered = g.agg(F.sum(F.when(F.col("occurrence") >= 3, F.col("occurrence"))).alias("c")).join(s.agg(F.count(F.lit(1)).alias("n")), F.lit(True))  # one row each
    return rows.unionByName(covered.select(F.lit("pattern_coverage").alias("metric"), F.round(F.col("c") * 100.0 / F.col("n"), 2).alias("value")))


_CAMPAIGN = f"""with m as (select min(c.id) campaign, s.signature_hash h from (select id, unnest(signature_ids) sid from clusters) c join signatures s on s.id = c.sid group by 2),
 e as (select m.campaign, x.* from (select sha256({_TEMPLATE.format('normalized_text')}) h, ip, user_agent, created_at from submissions where normalized_text is not null) x join m on m.h = x.h
  where created_at >= (select max(created_at) from submissions) - interval 365 days),
 g as (select campaign, count(*) submissions, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3.6e9 as hours, count(distinct ip) * 1.0 / count(*) ip_diversity, count(distinct user_agent) * 1.0 / count(*) agent_diversity, 1 - count(distinct h) * 1.0 / count(*) consistency from e where created_at is not null group by 1),
 p as (select *, case when hours > 0 then submissions / hours end per_hour from g),
 q as (select *, case when submissions > 100 then 30 when submissions > 50 then 20 when submissions > 10 then 10 else 0 end + case when per_hour > 10 then 25 when per_hour > 5 then 15 when per_hour > 1 then 5 else 0 end
  + case when ip_diversity < 0.1 then 20 else 0 end + case when agent_diversity < 0.05 then 15 else 0 end + case when consistency > 0.9 then 10 else 0 end points from p)
 select campaign, submissions, round(hours, 4) as hours, round(per_hour, 6) per_hour, round(ip_diversity, 6) ip_diversity, round(agent_diversity, 6) agent_diversity, round(consistency, 6) consistency, points,
  case when points >= 70 then 'critical' when points >= 50 then 'high' when points >= 30 then 'medium' else 'low' end severity from q"""


@query(_CAMPAIGN)
def campaign_severity(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns (clusters of signatures) of the last year of the data, their metrics and severity."""
    c = table(spark, d, "clusters").select(F.col("id").alias("campaign"), F.explode("signature_ids").alias("sid"))
    m = c.join(table(spark, d, "signatures").select(F.col("id").alias("sid"), F.col("signature_hash").alias("h")), "sid").groupBy("h").agg(F.min("campaign").alias("campaign"))
    s = table(spark, d, "submissions").where("normalized_text is not null").select(tx.signature_hash(tx.template_v2(F.col("normalized_text"))).alias("h"), "ip", "user_agent", "created_at")
    last = table(spark, d, "submissions").agg((F.max("created_at") - F.expr("interval 365 days")).alias("since"))  # one row
    e = s.join(F.broadcast(last), F.lit(True)).where("created_at >= since").join(m, "h")
    g = ingest.campaign_metrics(e, "campaign", "created_at", "h")
    return g.select("campaign", "submissions", F.round("hours", 4).alias("hours"), *[F.round(x, 6).alias(x) for x in ("per_hour", "ip_diversity", "agent_diversity", "consistency")], "points", "severity")


@query(f"""with r as (select distinct submission_id, rules_triggered from submission_scores), x as (select submission_id, len(rules_triggered) n, unnest(rules_triggered).id rule_id from r), t as (select count(distinct submission_id) n from r),
 l as (select id, len(honeypot_hits) > 0 bad from submissions where honeypot_hits is not null)
 select rule_id, round(count(distinct x.submission_id) * 1.0 / (select n from t), 6) trigger_rate, round(count(distinct case when x.n = 1 then x.submission_id end) * 1.0 / (select n from t), 6) solo_rate,
 round(count(distinct case when l.bad then x.submission_id end) * 1.0 / nullif(count(distinct case when l.bad is not null then x.submission_id end), 0), 6) accuracy from x left join l on l.id = x.submission_id group by 1""")
def rule_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule fires, fires alone, and fires on rows that fell into a trap."""
    r = table(spark, d, "submission_scores").select("submission_id", "rules_triggered").distinct()
    total = r.agg(F.count_distinct("submission_id").alias("t"))
    x = r.select("submission_id", F.size("rules_triggered").alias("n"), F.explode("rules_triggered.id").alias("rule_id"))
    one = x.groupBy("rule_id", "submission_id").agg(F.max((F.col("n") == 1).cast("int")).alias("solo"))
    l = table(spark, d, "submissions").where("honeypot_hits is not null").select(F.col("id").alias("submission_id"), (F.size("honeypot_hits") > 0).cast("int").alias("bad"))  # noqa: E741
    g = one.join(l, "submission_id", "left").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("solo").alias("s"), F.avg("bad").alias("a")).join(F.broadcast(total), F.lit(True))  # one row
    return g.select("rule_id", F.round(F.col("n") / F.col("t"), 6).alias("trigger_rate"), F.round(F.col("s") / F.col("t"), 6).alias("solo_rate"), F.round("a", 6).alias("accuracy"))


@query("with h as (select date_trunc('hour', created_at) h, count(*) n from submissions where created_at is not null group by 1) select count(*) as hours, max(n) busiest, round(avg(n), 6) per_hour from h")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "submissions").where("created_at is not null").groupBy(F.date_trunc("hour", "created_at").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.agg(F.count(F.lit(1)).alias("hours"), F.max("n").alias("busiest"), F.round(F.avg("n"), 6).alias("per_hour"))


@query(f"""with s as (select sha256({_TEMPLATE.format('normalized_text')}) h from submissions where normalized_text is not null), g as (select signature_hash, max(list_contains((select list(distinct sid) from (select unnest(signature_ids) sid from clusters)), id)::int) clustered from signatures group by 1)
 select round(count(g.signature_hash) * 1.0 / count(*), 6) signature_coverage, round(sum(coalesce(g.clustered, 0)) * 1.0 / count(*), 6) cluster_coverage from s left join g on g.signature_hash = s.h""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of submissions whose signature is known, and is in a cluster."""
    sid = table(spark, d, "clusters").select(F.explode("signature_ids").alias("sid")).distinct()
    g = table(spark, d, "signatures").select("signature_hash", "id").join(sid, F.col("id") == F.col("sid"), "left").groupBy("signature_hash").agg(F.max(F.col("sid").isNotNull().cast("int")).alias("clustered"))
    s = table(spark, d, "submissions").where("normalized_text is not null").select(tx.signature_hash(tx.template_v2(F.col("normalized_text"))).alias("signature_hash"))
    return s.join(g, "signature_hash", "left").agg(F.round(F.avg(F.col("clustered").isNotNull().cast("int")), 6).alias("signature_coverage"), F.round(F.avg(F.coalesce("clustered", F.lit(0))), 6).alias("cluster_coverage"))


_WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> ''))"


@query(f"""select c.id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) end, 6) jaccard
 from (select c.id, {_WORDS_SQL.format('c.example')} a, {_WORDS_SQL.format('s.pattern')} b from clusters c join signatures s on s.id = c.signature_ids[1]) c""")
def pattern_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Token Jaccard of each cluster's example and the pattern of its first signature."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    c = table(spark, d, "clusters").select("id", "example", F.get("signature_ids", F.lit(0)).alias("sid"))
    j = c.join(table(spark, d, "signatures").select(F.col("id").alias("sid"), "pattern"), "sid")
    return j.select("id", F.round(similarity.jaccard(words(F.col("example")), words(F.col("pattern"))), 6).alias("jaccard"))


@query(f"""with x as (select cast(s.created_at at time zone 'UTC' as date) metric_date, sha256({_TEMPLATE.format('normalized_text')}) h, normalized_text is not null known, len(honeypot_hits) > 0 bad, coalesce(c.risk_level in ('high', 'critical'), false) high from submissions s left join {_S} c on s.id = c.submission_id where created_at is not null)
 select metric_date, count(distinct case when known then h end) unique_signatures, count(*) filter (where bad and high) true_positives, count(*) filter (where not bad and high) false_positives, round(count(*) filter (where not bad and high) * 1.0 / nullif(count(*) filter (where not bad), 0), 6) false_positive_rate from x group by 1""")
def daily_marks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct signatures, marked hits and false alarms by day, recomputed as a whole."""
    from millrace.plans.olap_queries import latest_scores

    s = table(spark, d, "submissions").where("created_at is not null").select("id", F.to_date("created_at").alias("metric_date"), (F.size("honeypot_hits") > 0).alias("bad"), F.when(F.col("normalized_text").isNotNull(), tx.signature_hash(tx.template_v2(F.col("normalized_text")))).alias("h"), "honeypot_hits")
    s = s.withColumn("bad", F.when(F.col("honeypot_hits").isNotNull(), F.col("bad")))
    x = s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left").withColumn("high", F.coalesce(F.col("risk_level").isin("high", "critical"), F.lit(False)))
    distinct = x.where("h is not null").select("metric_date", "h").distinct().groupBy("metric_date").agg(F.count(F.lit(1)).alias("unique_signatures"))
    fp, clean = F.count_if(~F.col("bad") & F.col("high")), F.count_if(~F.col("bad"))
    g = x.groupBy("metric_date").agg(F.count_if(F.col("bad") & F.col("high")).alias("true_positives"), fp.alias("false_positives"), F.round(F.try_divide(fp.cast("double"), clean), 6).alias("false_positive_rate"))
    return g.join(distinct, "metric_date", "left").withColumn("unique_signatures", F.coalesce("unique_signatures", F.lit(0)))


@query("""select id, len(honeypot_hits)::int as n, '$[' || (list_position(list_transform(honeypot_hits, lambda x: x like 'company%'), true) - 1) || ']' as place, coalesce(list_contains(honeypot_hits, 'website_url'), false) as has_url from submissions""")
def array_search(spark: SparkSession, d: str) -> DataFrame:
    """Length, first match of a pattern and membership of an array of strings."""
    from millrace.functions import jsonlike

    h = F.col("honeypot_hits")
    return table(spark, d, "submissions").select("id", jsonlike.length(F.to_json(h)).alias("n"), ingest.json_search(h, "company%").alias("place"), jsonlike.contains(h, F.lit("website_url")).alias("has_url"))


@query("""with g as (select date_trunc('hour', created_at) h, count(*) n, count_if(len(honeypot_hits) > 0) t from submissions where created_at is not null group by 1), r as (select unnest(generate_series((select min(h) from g), (select max(h) from g), interval 1 hour)) h)
 select r.h as "at", coalesce(g.n, 0) total, coalesce(g.t, 0) triggered from r left join g on g.h = r.h""")
def hourly_spine(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every hour between the first and the last, also of hours without any."""
    return ingest.spine(table(spark, d, "submissions").select("created_at", "honeypot_hits"), "created_at", "hour", {"total": F.count(F.lit(1)), "triggered": F.count_if(F.size("honeypot_hits") > 0)})


@query("with a as (select id, row_number() over (order by id) p from clusters), b as (select s_suppkey, row_number() over (order by s_suppkey) p from supplier) select a.id, b.s_suppkey from a full join b on a.p = b.p")
def columns_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return ingest.concat_columns(table(spark, d, "clusters").select("id"), table(spark, d, "supplier").select("s_suppkey"), "id", "s_suppkey")


@query("with x as (select floor(ln(1 + length(message)) / 0.25)::bigint bin from formtrap_spam_clean where message is not null) select bin, count(*) n, round(count(*) / (0.25 * (select count(*) from x)), 6) density from x group by 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Density of the logarithm of message length."""
    h = ingest.histogram(table(spark, d, "formtrap_spam_clean"), F.log1p(F.char_length("message")), 0.25)
    return h.withColumn("density", F.round("density", 6))


@query("""select case lower(risk_level) when 'low' then 'harmless' when 'medium' then 'doubtful' when 'high' then 'bad' when 'critical' then 'bad' else 'unknown' end verdict, coalesce(list_position(['low', 'medium', 'high', 'critical'], lower(risk_level)), 0) as rank, count(*) n from submission_scores group by 1, 2""")
def risk_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Levels translated to verdicts, with their rank in the declared order."""
    level = F.lower("risk_level")
    labels = {"low": "harmless", "medium": "doubtful", "high": "bad", "critical": "bad"}
    s = table(spark, d, "submission_scores").select(relational.translate(level, labels, "unknown").alias("verdict"), relational.rank_of(level, list(labels)).cast("int").alias("rank"))
    return s.groupBy("verdict", "rank").agg(F.count(F.lit(1)).alias("n"))
