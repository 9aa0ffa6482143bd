"""Preparation of a raw export: cleaning, identity, label audit, feature table, labelled corpus and the leakage gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import calendar
from millrace.functions import text as tx
from millrace.operators import relational as rel
from millrace.operators.skew import hot_aware_left_join
from millrace.session import materialize

#: Columns of a raw export; ``src_row`` stands for the order of its lines.
RAW = "src_row long, ts timestamp, first string, middle string, last string, full string, email string, phone string, subject string, message string, trap string"


def clean(raw: DataFrame) -> DataFrame:
    """``id, timestamp, source_block, form_version, name, email, phone, message, honeypot_filled``: one row for each distinct filled line.

    Blank cells are null. Lines without any content go; of equal lines (null equals null) the first stays. Ids count the lines
    that stay, in their order. Lines without a time are the older block, whose trap was not recorded: unknown, not 0.
    """
    blank = lambda c: F.nullif(tx.stripped(F.col(c)), F.lit(""))
    cells = ("first", "middle", "last", "full", "email", "phone", "subject", "message", "trap")
    r = raw.select("src_row", "ts", *[blank(c).alias(c) for c in cells])
    parts = [F.col(c) for c in ("first", "middle", "last")]
    one_name = F.size(F.array_distinct(F.array_compact(F.array(*parts)))) <= 1
    r = r.select(
        "src_row", "ts", rel.full_name(F.col("full"), *parts).alias("name"), "email", "phone", rel.joined_lines(F.col("subject"), F.col("message")).alias("message"), "trap",
        F.when(F.col("ts").isNull(), "legacy_export").when(F.col("full").isNotNull() | one_name, "v2_full_name").otherwise("v1_split_name").alias("form_version"),
    )
    r = rel.any_filled(r, ["name", "email", "phone", "message"])
    keys = [c for c in r.columns if c != "src_row"]
    kept = rel.keep_first(r, keys, ["src_row"])
    numbered = rel.running_sums(kept.withColumn("_one", F.lit(1)), ["src_row"], ["_one"])
    return numbered.select(
        F.col("running__one").cast("long").alias("id"), F.col("ts").alias("timestamp"), F.when(F.col("ts").isNull(), "B_legacy").otherwise("A_timestamped").alias("source_block"),
        "form_version", "name", "email", "phone", "message", F.when(F.col("ts").isNotNull(), F.col("trap").isNotNull().cast("int")).alias("honeypot_filled"),
    )


def unrecorded_window(df: DataFrame, ts: str = "timestamp", key: str = "id", label: str = "honeypot_filled") -> DataFrame:
    """``start_at, end_at, rows, next_rows, days``: the longest stretch of timed rows without a hit, the second longest, and its whole days."""
    r = rel.runs(df.where(F.col(ts).isNotNull()).select(ts, key, label), [ts, key, label], F.coalesce(F.col(label), F.lit(0)))
    top = r.orderBy(F.desc("rows"), "start_at").limit(2).select(F.collect_list(F.struct("rows", "start_at", "end_at")).alias("t"))
    t = F.col("t")
    return top.where(F.size(t) > 0).select(
        t[0]["start_at"].alias("start_at"), t[0]["end_at"].alias("end_at"), t[0]["rows"].alias("rows"), F.get(t, F.lit(1))["rows"].alias("next_rows"), calendar.whole_days(t[0]["start_at"], t[0]["end_at"]).alias("days")
    )


def flag_reliable(df: DataFrame, window: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``honeypot_reliable``: 0 inside the window, 1 outside, null without a time. ``window`` has one row."""
    w = window.first()
    if w is None:
        return df.withColumn("honeypot_reliable", F.when(F.col(ts).isNotNull(), 1))
    return df.withColumn("honeypot_reliable", F.when(F.col(ts).isNull(), None).when(F.col(ts).between(F.lit(w["start_at"]), F.lit(w["end_at"])), 0).otherwise(1))


def label_evidence(df: DataFrame, window: DataFrame, days: int = 90, ts: str = "timestamp", label: str = "honeypot_filled") -> DataFrame:
    """``part, rows, hits, rate`` before, inside and after the window, and ``no_hit``: the chance of no hit inside at the rate before."""
    w = window.first()
    lo, hi = F.lit(w["start_at"]), F.lit(w["end_at"])
    span = F.expr(f"interval {days} days")
    t = F.col(ts)
    part = F.when(t.between(lo, hi), "inside").when((t < lo) & (t >= lo - span), "before").when((t > hi) & (t <= hi + span), "after")
    g = df.withColumn("part", part).where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).alias("hits"), F.avg(label).alias("rate"))
    before = F.max(F.when(F.col("part") == "before", F.col("rate"))).over(Window.partitionBy(F.lit(1)))  # three rows
    return g.withColumn("no_hit", F.when(F.col("part") == "inside", F.pow(1 - before, F.col("rows"))))


def features(df: DataFrame, least_domain: int = 5) -> DataFrame:
    """The feature table of cleaned rows (``id, name, email, phone, message, timestamp``): masked message, template, text, contact and time features."""
    masked = tx.mask_pii(F.col("message"), F.col("name"))
    d = df.withColumn("masked", masked).withColumn("template_id", tx.template_id(F.col("masked"))).withColumn("email_domain", F.nullif(F.regexp_extract(F.lower("email"), "@(.+)$", 1), F.lit("")))
    counts = d.where("template_id <> ''").groupBy("template_id").agg(F.count(F.lit(1)).alias("template_count"))
    d = hot_aware_left_join(materialize(d, "templates"), counts, ["template_id"]).withColumn("template_count", F.coalesce("template_count", F.lit(0)))
    d = rel.rare_to_other(d, "email_domain", least_domain)
    t, c, k = tx.text_features(F.col("masked")), tx.contact_features(*map(F.col, ("name", "email", "phone", "message"))), calendar.parts(F.col("timestamp"))
    return d.select(
        "id", tx.flag(F.col("masked") != "").alias("has_message"), tx.script_of(F.col("masked")).alias("script"), "template_id", "template_count", "email_domain",
        *[v.alias(n) for group in (t, c, k) for n, v in group.items()],
    )


def labelled_corpus(spam: DataFrame, ham: DataFrame, text: str = "text") -> DataFrame:
    """``text, label, source, script``: one spam message for each template and each distinct other text, in a repeatable random order."""
    s = rel.keep_first(spam.select(F.col(text).alias("text"), tx.template_id(F.col(text)).alias("t")).where("t <> ''"), ["t"], ["text"])
    h = ham.select(tx.mask_pii(F.col(text)).alias("text")).where("text <> ''").distinct()
    both = s.select("text", F.lit(1).alias("label"), F.lit("spam").alias("source")).unionByName(h.select("text", F.lit(0).alias("label"), F.lit("ham").alias("source")))
    return rel.shuffled(both.withColumn("script", tx.script_of(F.col("text"))), "text")


def leakage(published: DataFrame, text: str, raw: DataFrame, values: Sequence[str], least: int = 5) -> DataFrame:
    """``kind, hits``: pattern hits in published texts, and texts that hold a raw value, of any length, as a run of words; all must be 0.

    Words are split at everything but letters, marks and digits. Values meet texts by a hash join on their first three words (all, if
    they have fewer), then the whole value is looked up in the text. Values shorter than ``least`` characters don't count.
    """
    word = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    texts = published.select(F.monotonically_increasing_id().alias("row"), word(F.col(text)).alias("w"))
    texts = materialize(texts.select("row", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t")), "gate-texts")
    held = raw.select(F.explode(F.array(*[word(F.col(c)) for c in values])).alias("v")).where(F.char_length(F.array_join("v", " ")) >= least)
    held = held.select(F.array_join(F.slice("v", 1, 3), " ").alias("g"), F.concat(F.lit(" "), F.array_join("v", " "), F.lit(" ")).alias("v")).distinct()
    held = materialize(held, "gate-values")
    grams = texts.select("row", F.explode(F.array_distinct(F.flatten(F.array(*map(runs_of, (1, 2, 3)))))).alias("g"))
    met = grams.join(held, "g").select("row", "v").join(texts.select("row", "t"), "row").where(F.contains("t", "v")).select("row").distinct()
    literal = met.agg(F.lit("value").alias("kind"), F.count(F.lit(1)).alias("hits"))
    patterns = [published.agg(F.lit(k).alias("kind"), F.count_if(F.col(text).rlike(p)).alias("hits")) for k, p in (("email", tx.EMAIL), ("phone", tx.PHONE))]
    return literal.unionByName(patterns[0]).unionByName(patterns[1])


#: Features that the model matrix has on a log(1 + x) scale, and the values of its one nominal column.
LOGGED = "msg_len word_count avg_word_len line_count url_count email_mentions phone_mentions exclam_count name_len name_words email_local_len email_local_digits phone_digits".split()
SCRIPTS = ("latin", "cyrillic", "other", "none")


def model_matrix(rows: DataFrame, keep: Sequence[str] = ("id",)) -> tuple[DataFrame, list[str]]:
    """(``keep`` and one column a feature, names of the features): text and contact features as doubles, counts logged, script one-hot.

    ``rows`` has ``name, email, phone, message``. No feature comes from the trap or the time.
    """
    masked = tx.mask_pii(F.col("message"), F.col("name"))
    d = rows.withColumn("_m", masked)
    values = tx.text_features(F.col("_m")) | tx.contact_features(*map(F.col, ("name", "email", "phone", "message")))
    columns = {k: (F.log1p(v.cast("double")) if k in LOGGED else v.cast("double")) for k, v in values.items()}
    script = tx.script_of(F.col("_m"))
    columns |= {f"script_{s}": F.coalesce((script == s).cast("double"), F.lit(0.0)) for s in SCRIPTS}
    return d.select(*keep, *[v.alias(k) for k, v in columns.items()]), list(columns)


def binary_columns(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column_name, mean, binary``: whether a feature has no other values than 0 and 1; one pass over all."""
    one = matrix.agg(*[F.struct(F.lit(c).alias("column_name"), F.avg(c).alias("mean"), (F.count_if(~F.col(c).isin(0.0, 1.0)) == 0).alias("binary")).alias(c) for c in names])
    return one.select(F.explode(F.array(*names)).alias("r")).select("r.*")


def transaction_items(text: dict[str, Column], contact: dict[str, Column], script: Column, filled: Column) -> dict[str, Column]:
    """The 21 items of a submission by name."""
    n, urls = text["msg_len"], text["url_count"]
    return {
        "url=none": urls == 0, "url=one": urls == 1, "url=2+": urls >= 2, "len=empty": n == 0, "len=short": n.between(1, 50), "len=medium": n.between(51, 300), "len=long": n > 300,
        "script=latin": script == "latin", "script=cyrillic": script == "cyrillic", "markup=bbcode/html": (text["has_bbcode"] == 1) | (text["has_html"] == 1), "name=joined": contact["name_joined"] == 1,
        "email=free": contact["email_free"] == 1, "email=ru": contact["email_ru"] == 1, "email=none": contact["has_email"] == 0, "phone=ru_format": contact["phone_ru_format"] == 1, "phone=none": contact["has_phone"] == 0,
        "topic=money": text["kw_money"] == 1, "topic=seo": text["kw_seo"] == 1, "topic=crypto": text["kw_crypto"] == 1, "honeypot=filled": filled == 1, "honeypot=empty": filled == 0,
    }


def quality_report(df: DataFrame) -> DataFrame:
    """``column_name, nulls, distinct_values`` of every column in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns], *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])).alias("r")).select("r.*")


def score_messages(df: DataFrame, key: str, message: str, weights: DataFrame, bias: float, threshold: float = 0.5) -> DataFrame:
    """``key, probability, label``: masked message to terms to a linear model to a sigmoid, as one plan; messages empty after masking have no row.

    ``weights`` has ``term, weight``.
    """
    from millrace.operators.classification import sigmoid
    from millrace.operators.similarity import term_counts

    rows = df.select(key, tx.mask_pii(F.col(message)).alias("m")).where("m <> ''")
    z = term_counts(rows, key, "m").join(weights, "term").groupBy(key).agg(F.sum(F.col("tf") * F.col("weight")).alias("z"))
    p = sigmoid(F.coalesce("z", F.lit(0.0)) + F.lit(float(bias)))
    out = rows.select(key).join(z, key, "left").select(key, p.alias("probability"))
    return out.withColumn("label", F.when(F.col("probability") >= threshold, "spam").otherwise("legitimate"))
