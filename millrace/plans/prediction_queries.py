"""Predictions of a model kept beside the submissions: upsert, joins, roll-up and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import classification, evaluation, relational, rules
from millrace.plans.olap_queries import latest_scores
from millrace.plans.registry import query
from millrace.plans.rule_queries import _S
from millrace.session import materialize
from millrace.sources.sinks import upserted
from millrace.sources.tables import table

#: A fixed linear model of length, web addresses and exclamation marks: what the queries over predictions score with.
_BIAS, _WEIGHTS = -2.0, {"length": 0.004, "urls": 1.2, "exclamations": 0.5}


def predictions(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    """``submission_id, probability, label, version``; submissions without a message have none."""
    s = table(spark, d, "submissions").select(F.col("id").alias("submission_id"), F.col("raw_payload.message").alias("m")).where("m <> ''")
    parts = {"length": F.char_length("m"), "urls": tx.occurrences(F.col("m"), "http"), "exclamations": tx.occurrences(F.col("m"), "!")}
    z = sum((F.lit(w) * parts[k] for k, w in _WEIGHTS.items()), F.lit(_BIAS))
    p = F.round(classification.sigmoid(z), 6)
    return s.select("submission_id", p.alias("probability"), F.when(p >= 0.5, "spam").otherwise("legitimate").alias("label"), F.lit(version).alias("version"))


_Z = f"{_BIAS} + 0.004 * length(m) + 1.2 * ((length(m) - length(replace(m, 'http', ''))) / 4) + 0.5 * (length(m) - length(replace(m, '!', '')))"
_P = f"(select *, case when probability >= 0.5 then 'spam' else 'legitimate' end as label from (select id submission_id, round(1 / (1 + exp(-({_Z}))), 6) probability from (select id, raw_payload.message m from submissions) where m <> ''))"


@query(f"select submission_id, probability, label, case when submission_id % 2 = 0 then 2 else 1 end as version from {_P}")
def prediction_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A second run over the even ids replaces their rows; the others stay as they were."""
    return upserted(predictions(spark, d), predictions(spark, d, 2).where("submission_id % 2 = 0"), ["submission_id"], "version")


@query(f"select s.id, coalesce(p.probability >= 0.5, false) fired, case when p.probability >= 0.5 then 60 else 0 end score from submissions s left join {_P} p on p.submission_id = s.id")
def model_rule(spark: SparkSession, d: str) -> DataFrame:
    """The rule that asks the model; without a prediction it does not fire."""
    own = [r for r in rules.catalogue() if r.kind == "model_score"]
    s = table(spark, d, "submissions").select("id").join(predictions(spark, d), F.col("id") == F.col("submission_id"), "left")
    return rules.score(s, own).select("id", (F.size("rules_triggered") > 0).alias("fired"), "score")


@query(f"""select p.submission_id, epoch_us(s.created_at) created_at_us, p.probability, p.label, c.score from {_P} p join submissions s on s.id = p.submission_id left join {_S} c on c.submission_id = p.submission_id
 order by s.created_at desc nulls last, p.submission_id desc limit 15""")
def recent_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifteen predictions with the score of the rules: the limit is the report."""
    s = table(spark, d, "submissions").select("id", "created_at")
    newest = predictions(spark, d).join(s, F.col("submission_id") == F.col("id")).orderBy(F.desc_nulls_last("created_at"), F.desc("submission_id")).limit(15)
    j = newest.join(latest_scores(spark, d), "submission_id", "left")
    return j.select("submission_id", F.unix_micros("created_at").alias("created_at_us"), "probability", "label", "score")


@query(f"""select coalesce(cast(y as varchar), 'all') period, coalesce(label, 'all') grp, count(*) submissions, count(score) scored, count(probability) predicted, round(avg(probability), 5) mean_probability
 from (select year(s.created_at at time zone 'UTC') y, coalesce(p.label, 'none') as label, p.probability, c.score from submissions s left join {_P} p on p.submission_id = s.id left join {_S} c on c.submission_id = s.id where s.created_at is not null) group by rollup (y, label)""")
def prediction_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Submissions with predictions and scores by year and label, with subtotals."""
    s = table(spark, d, "submissions").where("created_at is not null").select("id", F.year("created_at").cast("string").alias("period"))
    j = s.join(predictions(spark, d), F.col("id") == F.col("submission_id"), "left").drop("submission_id").join(latest_scores(spark, d), F.col("id") == F.col("submission_id"), "left")
    g = j.select("period", F.coalesce("label", F.lit("none")).alias("grp"), "score", "probability").rollup("period", "grp")
    r = g.agg(F.count(F.lit(1)).alias("submissions"), F.count("score").alias("scored"), F.count("probability").alias("predicted"), F.round(F.avg("probability"), 5).alias("mean_probability"))
    return r.select(F.coalesce("period", F.lit("all")).alias("period"), F.coalesce("grp", F.lit("all")).alias("grp"), "submissions", "scored", "predicted", "mean_probability")


@query(f"""select count(*) submissions, count(p.submission_id) predicted, count(*) filter (where p.label = 'spam') spam, count(*) filter (where p.submission_id is null) unscored, round(avg(p.probability), 5) mean_probability,
 count(*) filter (where p.label = 'spam' and len(s.honeypot_hits) > 0) spam_and_trapped from submissions s left join {_P} p on p.submission_id = s.id""")
def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "submissions").select("id", "honeypot_hits").join(predictions(spark, d), F.col("id") == F.col("submission_id"), "left")
    spam = F.col("label") == "spam"
    return j.agg(
        F.count(F.lit(1)).alias("submissions"), F.count("submission_id").alias("predicted"), F.count_if(spam).alias("spam"), F.count_if(F.col("submission_id").isNull()).alias("unscored"),
        F.round(F.avg("probability"), 5).alias("mean_probability"), F.count_if(spam & (F.size("honeypot_hits") > 0)).alias("spam_and_trapped"),
    )


@query(f"""with x as (select (len(s.honeypot_hits) > 0)::int y, p.probability from submissions s join {_P} p on p.submission_id = s.id where s.honeypot_hits is not null)
 select t.t threshold, count(*) filter (where y = 1 and probability >= t.t) tp, count(*) filter (where y = 1 and probability < t.t) fn, count(*) filter (where y = 0 and probability >= t.t) fp, count(*) filter (where y = 0 and probability < t.t) tn from x, (values (0.3), (0.5), (0.7), (0.9)) t(t) group by 1""")
def model_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Counts at four cut-offs of the model's probability."""
    s = table(spark, d, "submissions").where("honeypot_hits is not null").select("id", (F.size("honeypot_hits") > 0).cast("int").alias("y"))
    x = s.join(predictions(spark, d), F.col("id") == F.col("submission_id"))
    return evaluation.threshold_table(x, "y", "probability", [0.3, 0.5, 0.7, 0.9]).select("threshold", "tp", "fn", "fp", "tn")


@query("""with c as (select id, lower(trim(template_id)) k, source_block from formtrap_spam_clean where timestamp is not null), f as (select lower(trim(template_id)) k, count(*) n, max(length(message)) longest from formtrap_spam_clean group by 1)
 select source_block, count(*) n, sum(f.n)::bigint template_rows, max(f.longest) longest from c join f on c.k = f.k group by 1""")
def rows_with_features(spark: SparkSession, d: str) -> DataFrame:
    """Timed rows joined to the features of their template, by block."""
    f = table(spark, d, "formtrap_spam_clean").withColumn("k", F.lower(F.trim("template_id")))
    features = f.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("tn"), F.max(F.char_length("message")).alias("longest"))
    from millrace.operators.skew import hot_aware_join

    features = materialize(features, "features")
    rows = f.where("timestamp is not null").select("k", "source_block")
    total = features.agg(F.sum("tn")).first()[0] or 1
    j = hot_aware_join(rows, features, ["k"], "tn", total)
    return j.groupBy("source_block").agg(F.count(F.lit(1)).alias("n"), F.sum("tn").alias("template_rows"), F.max("longest").alias("longest"))


@query("""with x as (select regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]{2,}') w, (doc_kind = 'spam')::int y from documents where doc_kind is not null), t as (select unnest(w) term, y from x),
 c as (select term, count(*) filter (where y = 1) a, count(*) filter (where y = 0) b from t group by 1), s as (select sum(a) ta, sum(b) tb, count(*) v from c), g as (select unnest([0.01, 0.1, 1.0, 10.0]) alpha)
 select cast(alpha as double) alpha, round(avg(ln((a + alpha) / (ta + alpha * v))), 6) mean_one, round(avg(ln((b + alpha) / (tb + alpha * v))), 6) mean_zero, count(*) filter (where a = 0) unseen_one, count(*) filter (where b = 0) unseen_zero from c, s, g group by 1""")
def alpha_scan(spark: SparkSession, d: str) -> DataFrame:
    """Mean log-likelihood of the vocabulary in each class at four smoothings, and the words a class never has."""
    from millrace.plans.mining_queries import _nb

    _, counts, labels, _, _ = _nb(spark, d)
    by = counts.join(labels, "doc_id").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("tf")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("tf")).otherwise(0)).alias("b"))
    by = materialize(by, "vocabulary")
    t = by.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("v")).first()  # one row
    out = [f for a in (0.01, 0.1, 1.0, 10.0) for f in (F.avg(F.log((F.col("a") + a) / (float(t["ta"] or 0) + a * t["v"]))).alias(f"one_{a}"), F.avg(F.log((F.col("b") + a) / (float(t["tb"] or 0) + a * t["v"]))).alias(f"zero_{a}"))]
    one = by.agg(*out, F.count_if(F.col("a") == 0).alias("u1"), F.count_if(F.col("b") == 0).alias("u0"))
    rows = [F.struct(F.lit(a).alias("alpha"), F.round(F.col(f"`one_{a}`"), 6).alias("mean_one"), F.round(F.col(f"`zero_{a}`"), 6).alias("mean_zero"), F.col("u1").alias("unseen_one"), F.col("u0").alias("unseen_zero")) for a in (0.01, 0.1, 1.0, 10.0)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("""with r as (select *, count(*) over (partition by ip order by created_at range between interval 30 minutes preceding and current row) recent from submissions where ip is not null and created_at is not null) select count(*) n, count(*) filter (where recent >= 3) limited from r""")
def rate_rule_window(spark: SparkSession, d: str) -> DataFrame:
    """The rate rule with another window and limit than the default."""
    rule = rules.Rule(14, "ip_rate_limit", 35, "high", "rate_limit", {"threshold": 3, "window_minutes": 30})
    s = rules.recent_count(table(spark, d, "submissions").where("ip is not null and created_at is not null").select("id", "ip", "created_at"), "ip", "created_at", rule.params["window_minutes"])
    return rules.score(s, [rule]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("limited"))


@query("select form_name, count(*) n, row_number() over (order by count(*) desc, form_name) place from submissions where form_name is not null group by 1")
def form_names(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of the form name by falling frequency."""
    g = table(spark, d, "submissions").where("form_name is not null").groupBy("form_name").agg(F.count(F.lit(1)).alias("n"))
    placed = relational.running_sums(g.withColumn("_one", F.lit(1)), [F.desc("n"), "form_name"], ["_one"])
    return placed.select("form_name", "n", F.col("running__one").cast("long").alias("place"))
