"""What is told about a submission when it arrives, and what is reported about it later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

#: Longest payload that is taken, in bytes of its values.
MAX_PAYLOAD = 10_240
#: Fields that a submission needs, the trap fields, and their trap that must be filled by then.
REQUIRED = ("name", "email", "subject", "message")
TRAPS, TIME_TRAP = ("website_url", "company_code"), "security_token"
#: Words of automatic user agents; render times in milliseconds that are fast, and extremely fast.
AGENTS = ("bot", "crawler", "spider", "scraper", "curl", "wget", "python")
FAST, FASTEST = 2000, 500
#: Headers that name the client, the first that holds an address counts.
IP_HEADERS = ("cf-connecting-ip", "x-forwarded-for", "x-real-ip", "remote-addr")
_V4 = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
_V6 = r"([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?"
ADDRESS = f"^(({_V4})|({_V6}))$"


def absent(value: Column) -> Column:
    """Null, empty, or ``0``: what a form field counts as not given."""
    return F.coalesce(value, F.lit("")).isin("", "0")


def accepted(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """``reason`` (null if all is well) and ``valid``: size in bytes, then the first required field that is missing.

    Invalid rows are marked for quarantine, not dropped.
    """
    size = sum((F.coalesce(F.octet_length(F.col(f"{payload}.{f.name}")), F.lit(0)) for f in df.schema[payload].dataType.fields), F.lit(0))
    reason = F.when(F.col(payload).isNull(), "no payload").when(size > MAX_PAYLOAD, "too large")
    for f in REQUIRED:
        reason = reason.when(absent(F.col(f"{payload}.{f}")), f"missing {f}")
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def trimmed(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """The payload with every text without outer white space."""
    fields = [f.name for f in df.schema[payload].dataType.fields]
    return df.withColumn(payload, F.when(F.col(payload).isNotNull(), F.struct(*[F.trim(F.col(f"{payload}.{f}")).alias(f) for f in fields])))


def trap_hits(payload: str = "raw_payload") -> Column:
    """Names of the traps that were filled, and ``..._missing`` of the time trap if it was not."""
    hits = [F.when(~absent(F.col(f"{payload}.{f}")), F.lit(f)) for f in TRAPS]
    return F.array_compact(F.array(*hits, F.when(absent(F.col(f"{payload}.{TIME_TRAP}")), F.lit(f"{TIME_TRAP}_missing"))))


def flags(payload: str = "raw_payload", hits: Column | None = None) -> dict[str, Column]:
    """The flags of a submission: booleans, and the kinds of attack pattern in each required field."""
    hits = trap_hits(payload) if hits is None else hits
    agent = F.lower(F.coalesce("user_agent", F.lit("")))
    out = {
        "honeypot_triggered": F.size(hits) > 0,
        "rapid_submission": F.col("client_render_time") < FAST,
        "extremely_rapid": F.col("client_render_time") < FASTEST,
        "bot_user_agent": reduce(lambda a, b: a | b, [agent.contains(w) for w in AGENTS]),
        "no_referer": absent(F.col("referer")),
        "invalid_email": F.col(f"{payload}.email").isNotNull() & ~tx.email_valid(F.col(f"{payload}.email")),
        "repetitive_content": tx.repetitive(F.col(f"{payload}.message")),
    }
    out = {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}
    return out | {f"suspicious_pattern_{f}": F.coalesce(tx.attacks(F.coalesce(F.col(f"{payload}.{f}"), F.lit(""))), F.array().cast("array<string>")) for f in REQUIRED}


def flags_json(payload: str = "raw_payload") -> Column:
    """A JSON object of the flags that hold."""
    parts = []
    for k, v in flags(payload).items():
        parts.append(F.when(F.size(v) > 0, v).alias(k) if k.startswith("suspicious") else F.when(v, F.lit(True)).alias(k))
    return F.to_json(F.struct(*parts))


def client_ip(headers: Column) -> Column:
    """The first address of the first header that begins with one; ``0.0.0.0`` if none does."""
    one = [F.trim(F.split(F.element_at(headers, h), ",")[0]) for h in IP_HEADERS]
    return F.coalesce(*[F.when(x.rlike(ADDRESS), x) for x in one], F.lit("0.0.0.0"))


def score_batch(df: DataFrame, rules) -> DataFrame:
    """Scores of a batch with ``error``: rows that cannot be scored (without id or payload) keep their place and say why."""
    from millrace.operators.rules import score

    error = F.when(F.col("id").isNull(), "no id").when(F.col("raw_payload").isNull(), "no payload")
    marked = score(df, rules).withColumn("error", error)
    return marked.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("score", "risk_level", "rules_triggered", "blocked")})


def detail(submissions: DataFrame, signatures: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, template, signature_hash, occurrence, trigrams`` of the submissions asked for (``ids``, column ``id``)."""
    asked = submissions.join(ids, "id", "left_semi").select("id", tx.template_v2(F.col("normalized_text")).alias("template"), F.size(tx.word_ngrams(F.col("normalized_text"))).alias("trigrams"))
    asked = asked.withColumn("signature_hash", tx.signature_hash(F.col("template")))
    known = signatures.groupBy("signature_hash").agg(F.max("occurrence").alias("occurrence"))
    return asked.join(known, "signature_hash", "left").select("id", "template", "signature_hash", F.coalesce("occurrence", F.lit(0)).alias("occurrence"), "trigrams")


def json_search(values: Column, pattern: str) -> Column:
    """Path ``$[i]`` of the first string of an array that fits a pattern with ``_`` and ``%``; null if none does."""
    found = F.array_position(F.transform(values, lambda x: F.coalesce(x.like(pattern), F.lit(False))), F.lit(True))
    return F.when(found > 0, F.concat(F.lit("$["), (found - 1).cast("string"), F.lit("]")))


def concat_columns(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The rows of two tables side by side by their position in an order; the longer one's rest has nulls. Names must differ.

    Positions are running counts over ranges of the order, so no task sees all rows.
    """
    from millrace.operators.relational import running_sums

    at = [running_sums(d.withColumn(f"_one{i}", F.lit(1)), [o], [f"_one{i}"]).withColumnRenamed(f"running__one{i}", "_at").drop(f"_one{i}") for i, (d, o) in enumerate(((left, left_order), (right, right_order)))]
    return at[0].join(at[1], "_at", "full").drop("_at")


def spine(df: DataFrame, ts: str, unit: str, measures: dict[str, Column]) -> DataFrame:
    """``at`` and measures for each minute, hour or day between the first and the last row, 0 where there is none."""
    grouped = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("at")).agg(*[v.alias(k) for k, v in measures.items()])
    ends = grouped.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    every = ends.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("at"))
    return every.join(grouped, "at", "left").select("at", *[F.coalesce(k, F.lit(0)).alias(k) for k in measures])


def histogram(df: DataFrame, column: Column, width: float) -> DataFrame:
    """``bin, n, density``: counts in bins of equal width, and their share of all rows for each unit of width."""
    g = df.select(F.floor(column / width).cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total), F.lit(True)).select("bin", "n", (F.col("n") / (F.col("t") * width)).alias("density"))  # one row


#: Points of a campaign whose measure is above, or below, a limit (the first that holds), and the ladder of severities.
SEVERITY_POINTS = (
    ("submissions", ">", ((100, 30), (50, 20), (10, 10))), ("per_hour", ">", ((10, 25), (5, 15), (1, 5))), ("ip_diversity", "<", ((0.1, 20),)),
    ("agent_diversity", "<", ((0.05, 15),)), ("consistency", ">", ((0.9, 10),)),
)
SEVERITY = ((70, "critical"), (50, "high"), (30, "medium"))


def campaign_metrics(events: DataFrame, key: str, ts: str, pattern: str) -> DataFrame:
    """Volume, hours, rate an hour, diversity of clients and agents, consistency of patterns, points and severity of each ``key``.

    ``events`` has ``ip, user_agent`` besides. Distinct values are counted in two steps, so that a hot key's are never in one task. A
    campaign of one moment has no rate.
    """
    first = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    base = first.groupBy(key).agg(F.count(F.lit(1)).alias("submissions"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    for c in ("ip", "user_agent", pattern):
        base = base.join(first.where(F.col(c).isNotNull()).select(key, c).distinct().groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{c}")), key, "left")
    share = lambda c: F.coalesce(f"_n_{c}", F.lit(0)) / F.col("submissions")
    hours = (F.unix_micros("_hi") - F.unix_micros("_lo")) / 3.6e9
    out = base.select(
        key, "submissions", hours.alias("hours"), F.try_divide(F.col("submissions").cast("double"), hours).alias("per_hour"), share("ip").alias("ip_diversity"), share("user_agent").alias("agent_diversity"),
        (1 - share(pattern)).alias("consistency"),
    )
    points = F.lit(0)
    for c, sign, steps in SEVERITY_POINTS:
        step = F
        for limit, p in steps:
            step = step.when(F.col(c) > limit if sign == ">" else F.col(c) < limit, p)
        points = points + step.otherwise(0)
    level = F
    for least, label in SEVERITY:
        level = level.when(F.col("points") >= least, label)
    return out.withColumn("points", points).withColumn("severity", level.otherwise("low"))
