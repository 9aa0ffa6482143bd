"""A weighted rule engine: a catalogue of conditions becomes one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import hot_aware_left_join
from millrace.session import materialize

SEVERITIES = ("low", "medium", "high", "critical")
#: From these scores on a row is medium, high and critical.
LADDER = ((100, "critical"), (60, "high"), (30, "medium"))


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    weight: int
    severity: str
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True


#: Condition kinds. Each builder gets the parameters and gives a Column over the submission columns; null counts as false.
KINDS: dict[str, Callable[[dict], Column]] = {}


def kind(name: str) -> Callable:
    def add(f: Callable[[dict], Column]) -> Callable[[dict], Column]:
        KINDS[name] = f
        return f

    return add


@kind("trap_filled")
def _trap_filled(p: dict) -> Column:
    return F.array_contains("honeypot_hits", p["field"]) | F.array_contains("honeypot_hits", f"{p['field']}_missing")


@kind("rapid_submit")
def _rapid(p: dict) -> Column:
    return F.col("client_render_time") < p["threshold_ms"]


@kind("pattern_match")
def _pattern(p: dict) -> Column:
    """Patterns between slashes are regular expressions, others literals; both are compared in lower case."""
    fields = ("name", "email", "subject", "message") if p["field"] == "any" else (p["field"],)
    texts = [F.lower(F.col(f"raw_payload.{f}")) if p["field"] == "any" else F.lower(F.col(f)) for f in fields]
    one = lambda t, x: t.rlike(x.strip("/").lower()) if x.startswith("/") and x.endswith("/") and len(x) > 2 else t.contains(x.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(one(t, x), F.lit(False)) for t in texts for x in p["patterns"]])


@kind("field_count")
def _field_count(p: dict) -> Column:
    n = sum((F.coalesce((F.trim(F.col(f"raw_payload.{f}")) != ""), F.lit(False)).cast("int") for f in ("name", "email", "subject", "message")), F.lit(0))
    return (n < p["min"]) | (n > p["max"])


@kind("email_validation")
def _email(p: dict) -> Column:
    from millrace.functions.text import email_valid

    return ~email_valid(F.col("raw_payload.email"))


@kind("header_check")
def _header(p: dict) -> Column:
    return (F.coalesce(F.col(p["header"]), F.lit("")) == "") if p.get("present", True) else (F.coalesce(F.col(p["header"]), F.lit("")) != "")


@kind("repeated_pattern")
def _repeated(p: dict) -> Column:
    """Needs ``occurrence`` of the row's signature, see :func:`with_signature`."""
    return F.col("occurrence") >= p["threshold"]


@kind("cluster_match")
def _cluster(p: dict) -> Column:
    return F.col("cluster_id").isNotNull()


@kind("rate_limit")
def _rate(p: dict) -> Column:
    """Needs ``recent``, see :func:`recent_count`."""
    return F.col("recent") >= p["threshold"]


@kind("model_score")
def _model(p: dict) -> Column:
    return F.col("probability") >= p["threshold"]


def catalogue() -> list[Rule]:
    """Names, weights, severities and parameters of the default rules."""
    return [
        Rule(1, "honeypot_text_filled", 50, "high", "trap_filled", {"field": "website_url"}),
        Rule(2, "honeypot_semantic_filled", 45, "high", "trap_filled", {"field": "company_code"}),
        Rule(3, "honeypot_time_trap", 30, "medium", "trap_filled", {"field": "security_token"}),
        Rule(4, "rapid_submission", 25, "medium", "rapid_submit", {"threshold_ms": 2000}),
        Rule(5, "suspicious_user_agent", 15, "low", "pattern_match", {"field": "user_agent", "patterns": ["bot", "crawler", "scraper", "curl", "wget"]}),
        Rule(6, "repeated_signature", 20, "medium", "repeated_pattern", {"threshold": 10}),
        Rule(7, "template_cluster_match", 40, "high", "cluster_match"),
        Rule(8, "abnormal_field_count", 10, "low", "field_count", {"min": 2, "max": 10}),
        Rule(9, "sql_injection_attempt", 100, "critical", "pattern_match", {"field": "any", "patterns": ["UNION SELECT", "DROP TABLE", "OR 1=1", "--", "xp_cmdshell"]}),
        Rule(10, "xss_attempt", 80, "high", "pattern_match", {"field": "any", "patterns": ["<script", "javascript:", "onerror=", "onload="]}),
        Rule(11, "email_format_invalid", 5, "low", "email_validation"),
        Rule(12, "repetitive_character_spam", 15, "medium", "pattern_match", {"field": "any", "patterns": [r"(.)\1{10,}"]}),
        Rule(13, "no_referrer", 8, "low", "header_check", {"header": "referer"}),
        Rule(14, "ip_rate_limit", 35, "high", "rate_limit", {"threshold": 5, "window_minutes": 10}),
        Rule(15, "ml_spam_score", 60, "high", "model_score", {"threshold": 0.5}),
    ]


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    """Enabled rules, gravest and heaviest first."""
    return sorted((r for r in rules if r.enabled), key=lambda r: (-SEVERITIES.index(r.severity), -r.weight, r.id))


def fired(rules: Sequence[Rule]) -> Column:
    """Array of struct(id, name, weight, severity) of the rules that hold."""
    one = lambda r: F.when(F.coalesce(KINDS[r.kind](r.params), F.lit(False)), F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.weight).alias("weight"), F.lit(r.severity).alias("severity")))
    return F.array_compact(F.array(*[one(r) for r in ordered(rules)]))


def risk(score: Column) -> Column:
    out = None
    for least, label in LADDER:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise("low")


def score(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rules_triggered, score, risk_level, blocked``; conditions whose columns ``df`` lacks are left out by the caller."""
    out = df.withColumn("rules_triggered", fired(rules))
    out = out.withColumn("score", F.aggregate("rules_triggered", F.lit(0), lambda a, r: a + r["weight"]))
    return out.withColumn("risk_level", risk(F.col("score"))).withColumn("blocked", F.col("score") >= LADDER[0][0])


def recent_count(df: DataFrame, key: str, ts: str, minutes: int = 10, include_self: bool = True) -> DataFrame:
    """``recent``: rows of the same key in the ``minutes`` up to the row's own time, with or without itself.

    A range window over microseconds. Rows are partitioned by key and stretch of time, and those of the stretch before are
    added as lookers-on, so that a key with a third of all rows is spread over as many tasks as it has stretches.
    """
    span = minutes * 60 * 1_000_000
    stretch = 6 * span
    t = F.unix_micros(ts)
    cell = F.floor(t / stretch)
    own = df.withColumn("_t", t).withColumn("_cell", cell).withColumn("_own", F.lit(True))
    late = own.where(F.col("_t") >= (F.col("_cell") + 1) * stretch - span).withColumn("_cell", F.col("_cell") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(key, "_cell").orderBy("_t").rangeBetween(-span, 0)
    counted = own.unionByName(late).withColumn("recent", F.count(F.lit(1)).over(w))
    counted = counted.where("_own").drop("_t", "_cell", "_own")
    return counted if include_self else counted.withColumn("recent", F.col("recent") - 1)


def with_signature(df: DataFrame, signatures: DataFrame, clusters: DataFrame) -> DataFrame:
    """``occurrence`` of the row's signature and the smallest ``cluster_id`` that holds it; null if unknown."""
    from millrace.functions.text import signature_hash, template_v2

    members = clusters.select(F.col("id").alias("cluster_id"), F.explode("signature_ids").alias("sid")).groupBy("sid").agg(F.min("cluster_id").alias("cluster_id"))
    known = signatures.select(F.col("signature_hash").alias("_h"), "occurrence", "id").join(members, F.col("id") == F.col("sid"), "left").select("_h", "occurrence", "cluster_id")
    known = known.groupBy("_h").agg(F.max("occurrence").alias("occurrence"), F.min("cluster_id").alias("cluster_id"))
    return hot_aware_left_join(materialize(df.withColumn("_h", signature_hash(template_v2(F.col("normalized_text")))), "hashed"), known, ["_h"]).drop("_h")
