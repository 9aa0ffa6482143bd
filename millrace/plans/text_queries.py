"""Text features, templates and signatures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import olap, signatures
from millrace.plans.registry import query
from millrace.sources.tables import table

_WS = r"[\t-\r\x{85}\p{Z}]"
_T = f"(select doc_id, coalesce(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '') t from documents)"
_C = f"(select *, regexp_replace(regexp_replace(t, '<(EMAIL|PHONE|SITE|NAME)>', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g') inn, regexp_replace(t, '<(EMAIL|PHONE|SITE|NAME)>', ' ', 'g') core from {_T})"
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+"


def _chars(column: str, klass: str) -> str:
    return f"length(regexp_replace({column}, '[^{klass}]', '', 'g'))"


def _share(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0 else round(1.0 * ({a}) / ({b}), 6) end"


@query(
    rf"""select doc_id, length(t) msg_len, len(regexp_extract_all(core, '{_WORD}')) word_count, case when t = '' then 0 else length(t) - length(replace(t, chr(10), '')) + 1 end line_count,
 len(regexp_extract_all(t, '(?i)(?:https?://|www\.)[^\s<>"''\[\]]+')) url_count, length(core) - length(replace(core, '!', '')) exclam_count,
 {_share(f"length(list_aggregate(regexp_extract_all(core, '{_WORD}'), 'string_agg', ''))", f"len(regexp_extract_all(core, '{_WORD}'))").replace("length(list_aggregate", "coalesce(length(list_aggregate").replace("'string_agg', ''))", "'string_agg', '')), 0)")} avg_word_len from {_C}"""
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    f = tx.text_features(F.col("text"))
    names = ("msg_len", "word_count", "line_count", "url_count", "exclam_count")
    return table(spark, d, "documents").select("doc_id", *[f[k].cast("long").alias(k) for k in names], F.round(f["avg_word_len"], 6).alias("avg_word_len"))


@query(
    rf"""select doc_id, {_share(_chars('core', chr(92) + 'p{Nd}'), 'length(inn)')} digit_ratio, {_share(_chars('core', chr(92) + 'p{Lu}'), _chars('core', chr(92) + 'p{L}'))} upper_ratio,
 {_share("length(regexp_replace(core, '[" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "t-" + chr(92) + "r" + chr(92) + "x{85}" + chr(92) + "p{Z}]', '', 'g'))", 'length(inn)')} special_ratio,
 {_share("length(regexp_replace(core, '[" + chr(92) + "x00-" + chr(92) + "x7F]', '', 'g'))", 'length(inn)')} non_ascii_ratio,
 {_share("length(regexp_replace(core, '[^" + chr(92) + "x{400}-" + chr(92) + "x{4FF}]', '', 'g'))", _chars('core', chr(92) + 'p{L}'))} cyrillic_ratio from {_C}"""
)
def char_ratios(spark: SparkSession, d: str) -> DataFrame:
    f = tx.text_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[F.round(f[k], 6).alias(k) for k in ("digit_ratio", "upper_ratio", "special_ratio", "non_ascii_ratio", "cyrillic_ratio")])


@query(
    f"""with c as (select doc_id, unnest(string_split(inn, '')) ch from {_C}), g as (select doc_id, ch, count(*) n from c where ch <> '' group by 1, 2), t as (select doc_id, sum(n) t from g group by 1)
 select x.doc_id, round(coalesce(e.h, 0.0), 6) char_entropy from documents x left join (select g.doc_id, -sum(n / t * log2(n / t)) h from g join t on g.doc_id = t.doc_id group by 1) e on x.doc_id = e.doc_id"""
)
def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(tx.text_features(F.col("text"))["char_entropy"], 6).alias("char_entropy"))


@query("select doc_id, " + ", ".join(f"coalesce(regexp_matches(core, '(?i){p}'), false)::int {k}" for k, p in tx.KEYWORDS.items()) + f" from {_C}")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    f = tx.text_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[f[k].alias(k) for k in tx.KEYWORDS])


@query(
    r"""select id, regexp_matches(lower(coalesce(raw_payload.message, '')), '\[/?url')::int has_bbcode, regexp_matches(lower(coalesce(raw_payload.message, '')), '<a\s|href=|</\w+>')::int has_html from submissions"""
)
def markup_flags(spark: SparkSession, d: str) -> DataFrame:
    f = tx.text_features(F.col("raw_payload.message"))
    return table(spark, d, "submissions").select("id", f["has_bbcode"].alias("has_bbcode"), f["has_html"].alias("has_html"))


#: DuckDB knows no back-references: runs of one character are spelled out for the characters that occur.
_REPEAT = "|".join(re.escape(chr(c)).replace("'", "''") + "{4,}" for c in range(32, 127)) + "|" + "|".join(c + "{4,}" for c in "абвгдежзиклмнопрстуфхцчшщыьэюяії！？。…")
_TEMPLATE = "coalesce({0}, '')"
for _p, _r in ((tx.EMAIL, "<EMAIL>"), (r"https?://[^\s]+", "<URL>"), (tx.TEMPLATE_PHONE, "<PHONE>"), (r"\b\d+\b", "<NUM>"), (_REPEAT, "<REPEAT>"), (r"[\s\x0B]+", " ")):
    _TEMPLATE = f"regexp_replace({_TEMPLATE if _p != tx.EMAIL else 'lower(' + _TEMPLATE + ')'}, '{_p.replace('{', '{{').replace('}', '}}')}', '{_r}', 'g')"
_TEMPLATE = f"trim({_TEMPLATE})"


@query("select id, " + _TEMPLATE.format("normalized_text") + " pattern from submissions")
def template_v2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").select("id", tx.template_v2(F.col("normalized_text")).alias("pattern"))


@query(f"""with p as (select id, created_at, {_TEMPLATE.format('normalized_text')} pattern from submissions where normalized_text is not null)
 select sha256(pattern) signature_hash, count(*) occurrence, epoch_us(min(created_at)) first_us, epoch_us(max(created_at)) last_us from p where pattern <> '' group by pattern""")
def signature_table(spark: SparkSession, d: str) -> DataFrame:
    s = signatures.extract(table(spark, d, "submissions"), "id", "normalized_text", "created_at")
    return s.select("signature_hash", "occurrence", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query()
def template_v1_ids(spark: SparkSession, d: str) -> DataFrame:
    """Template ids by Unicode classes and how many messages share them."""
    t = table(spark, d, "formtrap_spam_clean").select(tx.template_id(F.col("message")).alias("template"))
    return t.where("template <> ''").groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query()
def masked_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with e-mail, phone and the sender's own name as tokens."""
    return table(spark, d, "submissions").select("id", tx.mask_pii(F.col("raw_payload.message"), F.col("raw_payload.name")).alias("masked"))


@query("select id, trim(regexp_replace(lower(coalesce(normalized_text, '')), '[\\s\\x0B]+', ' ', 'g')) clean, concat_ws(' | ', raw_payload.name, raw_payload.email, raw_payload.subject, raw_payload.message) joined from submissions")
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    p = [F.col(f"raw_payload.{f}") for f in ("name", "email", "subject", "message")]
    return table(spark, d, "submissions").select("id", tx.normalized(F.col("normalized_text")).alias("clean"), tx.joined_fields(*p).alias("joined"))


@query(
    r"""with w as (select id, list_filter(string_split_regex(coalesce(raw_payload.subject, ''), '\s+'), lambda x: x not in ('', '0')) w from submissions),
 g as (select id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end) gram from w) select gram, count(*) n from g group by 1"""
)
def word_trigrams(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "submissions").select(F.explode(tx.word_ngrams(F.col("raw_payload.subject"), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""select id, case when regexp_matches(lower(trim(coalesce(raw_payload.email, ''))), '@') then list_last(string_split(lower(trim(coalesce(raw_payload.email, ''))), '@')) else lower(trim(coalesce(raw_payload.email, ''))) end as domain from submissions""".replace("list_last(", "list_extract(").replace("'@')) else", "'@'), -1) else"))
def email_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").select("id", tx.domain_of(F.col("raw_payload.email")).alias("domain"))


@query(rf"""select id, (trim(coalesce(raw_payload.name, '')) <> '')::int has_name, length(trim(coalesce(raw_payload.name, ''))) name_len, (trim(coalesce(raw_payload.email, '')) <> '')::int has_email,
 regexp_full_match(trim(coalesce(raw_payload.email, '')), '{tx.EMAIL}')::int email_valid, length(regexp_replace(coalesce(raw_payload.phone, ''), '[^0-9]', '', 'g')) phone_digits,
 ((trim(coalesce(raw_payload.name, '')) <> '')::int + (trim(coalesce(raw_payload.email, '')) <> '')::int + (trim(coalesce(raw_payload.phone, '')) <> '')::int + (trim(coalesce(raw_payload.message, '')) <> '')::int) / 4.0 field_completion_ratio from submissions""")
def contact_features(spark: SparkSession, d: str) -> DataFrame:
    p = {f: F.col(f"raw_payload.{f}") for f in ("name", "email", "phone", "message")}
    c = tx.contact_features(p["name"], p["email"], p["phone"], p["message"])
    return table(spark, d, "submissions").select("id", *[c[k].cast("long" if k.endswith(("len", "digits")) else "double" if "ratio" in k else "int").alias(k) for k in ("has_name", "name_len", "has_email", "email_valid", "phone_digits", "field_completion_ratio")])


@query(r"""with l as (select doc_id, regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g') x, text from documents)
 select doc_id, case when x = '' then 'none' when 2 * length(regexp_replace(x, '[^\x{400}-\x{4FF}]', '', 'g')) > length(x) then 'cyrillic' when 2 * length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > length(x) then 'latin' else 'other' end script from l""")
def script_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.script_of(F.col("text")).alias("script"))


@query("select doc_id, " + " || ".join(f"(case when regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}') then '{k} ' else '' end)" for k, p in tx.ATTACKS.items()) + " kinds from documents")
def attack_patterns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(tx.attacks(F.coalesce("text", F.lit(""))), lambda k: F.concat(k, F.lit(" "))), "").alias("kinds"))


@query(
    "select id from (select id, coalesce(raw_payload.message, '') m from submissions) where coalesce(list_bool_or(list_transform(list_filter(list_distinct(string_split(m, '')), lambda c: c not in ('', chr(10), chr(13), chr(133), chr(8232), chr(8233))), lambda c: contains(m, repeat(c, 11)))), false)"
    " or coalesce(list_max(map_values(list_aggregate(list_filter(regexp_split_to_array(m, '\\s+'), lambda w: w not in ('', '0')), 'histogram'))), 0) >= 10"
)
def repetitive_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").where(tx.repetitive(F.col("raw_payload.message"))).select("id")


@query(f"""select topic, count(*) n, count(honeypot_filled) labelled, cast(sum(honeypot_filled) as bigint) hits from (select *, case when coalesce(has_message, 0) = 0 then 'no message'
 {' '.join(f"when regexp_matches(coalesce(message, ''), '(?i){tx.KEYWORDS[k]}') then '{v}'" for k, v in (('kw_crypto', 'crypto'), ('kw_gambling', 'gambling'), ('kw_adult', 'adult'), ('kw_pharma', 'pharma'), ('kw_seo', 'seo / marketing'), ('kw_money', 'money')))}
 else 'other' end topic from formtrap_spam_clean) group by 1""")
def topic_cube(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean")
    cube = olap.Cube.build(f, {"topic": tx.topic(F.coalesce("has_message", F.lit(0)), F.coalesce("message", F.lit("")))}, {"n": F.count(F.lit(1)), "labelled": F.count("honeypot_filled"), "hits": F.sum("honeypot_filled").cast("long")})
    return cube.roll_up("topic")


@query("select template_id, count(*) n from formtrap_spam_clean where template_id is not null group by 1")
def template_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "formtrap_spam_clean").where("template_id is not null").groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(sum(occurrence) filter (where occurrence >= 3) as bigint) covered, round(sum(occurrence) filter (where occurrence >= 3) * 100.0 / (select count(*) from submissions), 2) coverage from signatures")
def pattern_coverage(spark: SparkSession, d: str) -> DataFrame:
    return signatures.coverage(table(spark, d, "signatures"), table(spark, d, "submissions").count())


@query("select cast(sum(occurrence) as bigint) total, count(*) patterns, round(sum(occurrence) * 1.0 / count(*), 6) ratio from signatures")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    return signatures.compression(table(spark, d, "signatures")).withColumn("ratio", F.round("ratio", 6))


@query("select id, pattern, occurrence from signatures order by occurrence desc, id limit 10")
def top_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent patterns: the limit is the report."""
    return table(spark, d, "signatures").orderBy(F.desc("occurrence"), "id").limit(10).select("id", "pattern", "occurrence")
