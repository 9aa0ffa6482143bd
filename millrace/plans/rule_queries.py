"""The rule engine and operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.plans.registry import query
from millrace.plans.text_queries import _TEMPLATE
from millrace.sources.tables import table

_ANY = "concat_ws(chr(1), lower(coalesce(raw_payload.name, '')), lower(coalesce(raw_payload.email, '')), lower(coalesce(raw_payload.subject, '')), lower(coalesce(raw_payload.message, '')))"


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_WEIGHTS = {
    1: (50, "list_has_any(honeypot_hits, ['website_url', 'website_url_missing'])"),
    2: (45, "list_has_any(honeypot_hits, ['company_code', 'company_code_missing'])"),
    3: (30, "list_has_any(honeypot_hits, ['security_token', 'security_token_missing'])"),
    4: (25, "client_render_time < 2000"),
    5: (15, _has("lower(user_agent)", ("bot", "crawler", "scraper", "curl", "wget"))),
    6: (20, "occurrence >= 10"),
    7: (40, "cluster_id is not null"),
    8: (10, "((trim(coalesce(raw_payload.name, '')) <> '')::int + (trim(coalesce(raw_payload.email, '')) <> '')::int + (trim(coalesce(raw_payload.subject, '')) <> '')::int + (trim(coalesce(raw_payload.message, '')) <> '')::int) < 2"),
    9: (100, _has(_ANY, ("union select", "drop table", "or 1=1", "--", "xp_cmdshell"))),
    10: (80, _has(_ANY, ("<script", "javascript:", "onerror=", "onload="))),
    11: (5, r"not coalesce(regexp_full_match(raw_payload.email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), false)"),
    12: (15, _has(_ANY, (r"(.)\1{10,}",))),
    13: (8, "coalesce(referer, '') = ''"),
    14: (35, "recent >= 5"),
}
_JOINED = f"""(select s.*, g.occurrence, g.cluster_id, case when s.ip is null then null else count(*) over (partition by s.ip order by s.created_at range between interval 10 minutes preceding and current row) end recent
 from (select *, sha256({_TEMPLATE.format('normalized_text')}) h from submissions) s left join (select signature_hash, max(occurrence) occurrence, min(c.id) cluster_id from signatures
 left join (select id, unnest(signature_ids) sid from clusters) c on c.sid = signatures.id group by 1) g on s.h = g.signature_hash)"""
_SCORE = " + ".join(f"(case when coalesce({c}, false) then {w} else 0 end)" for w, c in _WEIGHTS.values())
_FIRED = " || ".join(f"(case when coalesce({c}, false) then '{i},' else '' end)" for i, (_, c) in _WEIGHTS.items())


def scored_submissions(spark: SparkSession, d: str) -> DataFrame:
    """All submissions under the default rules, but for the one that needs a model."""
    s = table(spark, d, "submissions")
    s = rules.with_signature(s, table(spark, d, "signatures"), table(spark, d, "clusters"))
    rate = next(r for r in rules.catalogue() if r.kind == "rate_limit")
    known = rules.recent_count(s.where("ip is not null"), "ip", "created_at", rate.params["window_minutes"])
    s = known.unionByName(s.where("ip is null").withColumn("recent", F.lit(None).cast("long")))
    return rules.score(s, [r for r in rules.catalogue() if r.kind != "model_score"])


@query(f"""select id, score, case when score >= 100 then 'critical' when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end risk_level, score >= 100 blocked, fired from (select id, {_SCORE} score, {_FIRED} fired from {_JOINED})""")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.transform("rules_triggered", lambda r: r["id"])), lambda i: F.concat(i.cast("string"), F.lit(","))), "")
    return scored_submissions(spark, d).select("id", "score", "risk_level", "blocked", ids.alias("fired"))


@query("""with r as (select submission_id, len(rules_triggered) n, unnest(rules_triggered) r from (select distinct submission_id, rules_triggered from submission_scores))
 select r.id rule_id, count(*) triggers, count_if(n = 1) isolated, round(count_if(n = 1) * 1.0 / count(*), 6) ratio from r group by 1""")
def rule_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submission_scores").select("submission_id", "rules_triggered").distinct()
    r = s.select(F.size("rules_triggered").alias("n"), F.explode("rules_triggered").alias("r"))
    g = r.groupBy(F.col("r.id").alias("rule_id")).agg(F.count(F.lit(1)).alias("triggers"), F.count_if(F.col("n") == 1).alias("isolated"))
    return g.withColumn("ratio", F.round(F.col("isolated") / F.col("triggers"), 6))


@query("select h field_name, count(*) hits from (select unnest(honeypot_hits) h from submissions) group by 1")
def honeypot_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "submissions").select(F.explode("honeypot_hits").alias("field_name"))
    return h.groupBy("field_name").agg(F.count(F.lit(1)).alias("hits"))


@query("""select count(*) total, count(*) filter (where len(honeypot_hits) > 0) honeypot_triggered, count(distinct ip) ips, count_if(raw_payload is null) without_payload, round(count(*) filter (where len(honeypot_hits) > 0) * 100.0 / count(*), 2) detection_rate from submissions""")
def kpi_stats(spark: SparkSession, d: str) -> DataFrame:
    trapped = F.count_if(F.size("honeypot_hits") > 0)
    return table(spark, d, "submissions").agg(
        F.count(F.lit(1)).alias("total"), trapped.alias("honeypot_triggered"), F.count_distinct("ip").alias("ips"), F.count_if(F.col("raw_payload").isNull()).alias("without_payload"),
        F.round(F.coalesce(F.try_divide(trapped * 100.0, F.count(F.lit(1))), F.lit(0.0)), 2).alias("detection_rate"),
    )


_S = "(select submission_id, arg_max(score, computed_at) score, max(lower(risk_level)) risk_level from submission_scores group by 1)"


@query(f"""select cast(s.created_at at time zone 'UTC' as date) metric_date, count(*) total_submissions, count(*) filter (where len(s.honeypot_hits) > 0) honeypot_triggered, count(*) filter (where c.risk_level in ('high', 'critical')) high_risk_count,
 round(count(*) filter (where len(s.honeypot_hits) > 0) * 100.0 / count(*), 2) detection_rate from submissions s left join {_S} c on s.id = c.submission_id group by 1""")
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row a day, recomputed as a whole, so that marking and late rows need no update in place."""
    from millrace.plans.olap_queries import latest_scores

    s = table(spark, d, "submissions").select("id", "created_at", "honeypot_hits")
    j = s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left")
    trapped = F.count_if(F.size("honeypot_hits") > 0)
    return j.groupBy(F.to_date("created_at").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_submissions"), trapped.alias("honeypot_triggered"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_count"), F.round(trapped * 100.0 / F.count(F.lit(1)), 2).alias("detection_rate")
    )


@query(f"""with x as (select len(s.honeypot_hits) > 0 trapped, coalesce(c.score >= 30, false) flagged from submissions s left join {_S} c on s.id = c.submission_id)
 select count_if(trapped and flagged) tp, count_if(not trapped and flagged) fp, count_if(trapped and not flagged) fn, round(count_if(trapped and flagged) * 1.0 / nullif(count_if(flagged), 0), 6) as precision,
 round(count_if(trapped and flagged) * 1.0 / nullif(count_if(trapped and flagged) + count_if(not trapped), 0), 6) recall_ops from x where trapped is not null""")
def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """``recall_ops`` keeps the operational denominator (hits plus rows without a trap); it is no recall in the usual sense."""
    from millrace.plans.olap_queries import latest_scores

    s = table(spark, d, "submissions").where("honeypot_hits is not null").select("id", (F.size("honeypot_hits") > 0).alias("trapped"))
    x = s.join(latest_scores(spark, d), s["id"] == F.col("submission_id"), "left").select("trapped", F.coalesce(F.col("score") >= 30, F.lit(False)).alias("flagged"))
    a = x.agg(F.count_if(F.col("trapped") & F.col("flagged")).alias("tp"), F.count_if(~F.col("trapped") & F.col("flagged")).alias("fp"), F.count_if(F.col("trapped") & ~F.col("flagged")).alias("fn"), F.count_if(~F.col("trapped")).alias("clean"))
    return a.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("clean")), 6).alias("recall_ops"))


@query("""select ip, count(*) n, count(distinct user_agent) agents, round(count(distinct user_agent) * 1.0 / count(*), 6) agent_diversity, (epoch_us(max(created_at)) - epoch_us(min(created_at))) // 1000000 span_s from submissions where ip is not null group by 1 having count(*) >= 5""")
def campaign_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Span, size and agent diversity of sources with at least five rows."""
    g = table(spark, d, "submissions").where("ip is not null").groupBy("ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_agent").alias("agents"), F.expr("(unix_micros(max(created_at)) - unix_micros(min(created_at))) div 1000000").alias("span_s")
    )
    return g.where("n >= 5").withColumn("agent_diversity", F.round(F.col("agents") / F.col("n"), 6))
