"""The queries of the problems of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def patterns_and_texts(spark: SparkSession, d: str) -> DataFrame:
    """``tab, id, text`` of submissions and signatures."""
    s = table(spark, d, "submissions").select(F.lit("submissions").alias("tab"), "id", F.col("normalized_text").alias("text"))
    g = table(spark, d, "signatures").select(F.lit("signatures").alias("tab"), "id", F.col("pattern").alias("text"))
    return s.unionByName(g)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.form_duplicates import collapse

    return collapse(patterns_and_texts(spark, d), "tab", "id", "text").where("id <> rep_id").select("tab", "rep_id", F.col("id").alias("copy_id"))


#: Reduced parts of a text, sorted; DuckDB's regular expressions know the same Unicode classes.
_PARTS = r"list_sort(list_filter(list_transform(string_split(text, '|'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', '', 'g')), lambda x: x <> ''))"
_TEXTS = "select 'submissions' tab, id, normalized_text text from submissions union all select 'signatures', id, pattern from signatures"
SQL["p3_found"] = f"""
with t as ({_TEXTS}), k as (select tab, id, {_PARTS} k from t where text is not null),
g as (select tab, k, min(id) rep_id from k group by all having count(*) > 1)
select k.tab tab, g.rep_id rep_id, k.id copy_id from k join g on k.tab = g.tab and k.k = g.k where k.id <> g.rep_id"""


@query
def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record of each set of equal records, with the number of its copies."""
    from millrace.llm.form_duplicates import collapse

    return collapse(patterns_and_texts(spark, d), "tab", "id", "text").where("id = rep_id").select("tab", "rep_id", "copies")


SQL["p3_copies"] = f"""
with t as ({_TEXTS}), k as (select tab, id, {_PARTS} k from t where text is not null)
select tab, min(id) rep_id, count(*) copies from k group by tab, k having count(*) > 1"""


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.splits import tied_groups

    return tied_groups(table(spark, d, "formtrap_spam_clean"), "id", "template_id").where("members > 1").select("id", "group_key")


SQL["p5_found"] = r"""
with recursive p as (select distinct id, nullif(lower(regexp_replace(template_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') e from formtrap_spam_clean where id is not null),
q as (select id, e from p where e is not null),
l as (select distinct a.e a, b.e b from q a join q b on a.id = b.id and a.e <> b.e),
r as (select e, e as label from q union select l.b, r.label from r join l on l.a = r.e),
m as (select e, min(label) label from r group by e),
g as (select q.id, min(m.label) group_key from q join m on q.e = m.e group by q.id)
select id, group_key from g where group_key in (select group_key from g group by group_key having count(*) > 1)"""


@query
def p5_split(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.splits import assign_splits

    return assign_splits(table(spark, d, "formtrap_spam_clean"), "id", "template_id", "script")


@query
def p5_split_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of all splits, sets of tied ids that lie in more than one, and whether the shares are within a hundredth of the asked ones."""
    split = p5_split(spark, d).select("id", "split").distinct()
    tied = p5_found(spark, d).join(split, "id").groupBy("group_key").agg(F.count_distinct("split").alias("k"))
    torn = tied.agg(F.count_if(F.col("k") > 1).alias("torn_groups"))
    shares = [F.abs(F.count_if(F.col("split") == s) / F.count(F.lit(1)) - x) <= 0.01 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1))]
    one = split.agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("rows"), (shares[0] & shares[1] & shares[2]).alias("in_proportion"))
    return one.join(torn, F.lit(True))  # one row each


SQL["p5_split_invariant"] = "select count(distinct id) ids, count(distinct id) as rows, true in_proportion, 0 torn_groups from formtrap_spam_clean where id is not null"


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.encoding import TOKENIZERS, encode

    return encode(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").withColumnRenamed("id", "doc_id")


@query
def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each document's text as its ids give it back; empty for null."""
    from millrace.llm.encoding import TOKENIZERS, decode, pieces

    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    back = decode(p8_ids(spark, d).withColumnRenamed("doc_id", "id"), pieces(spark, "file://" + path))
    return back.select(F.col("id").alias("doc_id"), F.md5("text").alias("digest"))


SQL["p8_round_trip"] = "select doc_id, md5(coalesce(text, '')) digest from documents"


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.leakage import leaks

    found = leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", "lang")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


_REDUCED = r"regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g')"
_RUNS = "unnest(list_transform(range(1, greatest(length(t) - {0} + 2, 1)), lambda k: substr(t, k, {0})))"
SQL["p9_found"] = f"""
with i as (select item_id, case when lower(lang) like 'zh%' then 20 else 50 end n, {_REDUCED} t from eval_items where text is not null), g as (select item_id, n, {_RUNS.format('n')} g from i),
d as (select doc_id, {_REDUCED} t from documents where text is not null), r as (select doc_id, 50 n, {_RUNS.format(50)} g from d union all select doc_id, 20, {_RUNS.format(20)} from d)
select distinct r.doc_id, g.item_id from r join g on r.n = g.n and r.g = g.g"""


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.lookalikes import look_alikes

    found = look_alikes(table(spark, d, "submissions"), "id", "normalized_text")
    return found.where("id <> rep_id").select("rep_id", F.col("id").alias("copy_id"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.near_duplicates import near_duplicates

    found = near_duplicates(patterns_and_texts(spark, d), "tab", "id", "text")
    return found.where("id <> rep_id").select("tab", "rep_id", F.col("id").alias("member_id"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.sentences import sentences

    return sentences(table(spark, d, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def own_words(s: DataFrame) -> DataFrame:
    """``id, words``: the subject and message parts of ``normalized_text``.

    The parts that repeat the form's name and e-mail are left out; without a payload, parts that hold one address and those
    of up to three words beside it.
    """
    from millrace.llm.common import reduced

    parts = F.split("normalized_text", r"\s\|\s")
    name, mail = reduced(F.col("raw_payload.name")), reduced(F.col("raw_payload.email"))
    address = lambda x: x.rlike(r"^\s*\S+(@|\(at\)|\[at\])\S+\s*$")
    known = F.filter(parts, lambda x: ~(F.coalesce(reduced(x) == name, F.lit(False)) | F.coalesce(reduced(x) == mail, F.lit(False)) | address(x)))
    place = F.coalesce(F.array_position(F.transform(parts, address), F.lit(True)), F.lit(0))
    short = lambda x: x.rlike(r"^\s*\S+(\s+\S+){0,2}\s*$")
    guessed = F.filter(parts, lambda x, i: ~(address(x) | ((place > 0) & short(x) & ((i + 2 == place) | (place == 1) & (i == F.size(parts) - 1)))))
    return s.select("*", F.array_join(F.when(F.col("raw_payload").isNull() | F.col("raw_payload.name").isNull(), guessed).otherwise(known), " | ").alias("words"))


def language_records(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.languages import primary_subtag

    s = own_words(table(spark, d, "submissions").select("id", "normalized_text", "raw_payload", "request_headers").where("normalized_text is not null"))
    host = F.lower(F.regexp_extract("raw_payload.email", r"@\s*([^\s>@]+)", 1))
    s = s.select(
        F.lit("submissions").alias("tab"), "id", F.col("words").alias("text"), primary_subtag(F.element_at("request_headers", "accept-language")).alias("declared"), host.alias("host"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
    )
    x = table(spark, d, "documents").where("text is not null").select(
        F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "text", primary_subtag(F.col("lang")).alias("declared"), F.lower("source").alias("host"),
        F.regexp_extract(F.lower("source"), r"\.([^.]+)$", 1).alias("suffix"),
    )
    return s.unionByName(x)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm import languages as lg

    found = lg.detect(language_records(spark, d), table(spark, d, "lang_samples")).where(F.size("languages") > 0)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("tab"), lg.primary_subtag(F.col("lang")).alias("declared"))
    joined = found.join(docs, ["tab", "id"], "left")
    right = (F.size("languages") == 1) & F.coalesce(F.col("declared") == F.col("languages")[0]["label"], F.lit(False))
    told = joined.where((F.col("tab") == "submissions") | ~right).select("tab", F.col("id").alias("rec_id"), F.explode("languages.label").alias("label"))
    c = lg.cluster_scripts(table(spark, d, "clusters"), table(spark, d, "signatures")).where("main_script is null or lower(main_script) <> script")
    return told.unionByName(c.select(F.lit("clusters").alias("tab"), F.col("id").cast("long").alias("rec_id"), F.col("script").alias("label")))


@query
def p2_cluster_scripts(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.languages import cluster_scripts

    return cluster_scripts(table(spark, d, "clusters"), table(spark, d, "signatures")).select("id", "script")


SQL["p2_cluster_scripts"] = r"""
with l as (select id sid, regexp_replace(regexp_replace(pattern, '<[^<>]*>', '', 'g'), '[^\p{L}]', '', 'g') x from signatures where pattern is not null),
s as (select sid, case when x = '' then 'none' when 2 * length(regexp_replace(x, '[^\x{400}-\x{4FF}]', '', 'g')) > length(x) then 'cyrillic'
  when 2 * length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > length(x) then 'latin' else 'other' end script from l),
m as (select id, unnest(list_distinct(signature_ids)) sid from clusters),
v as (select m.id, s.script, count(*) n from m join s on m.sid = s.sid group by all)
select id, script from (select id, script, row_number() over (partition by id order by n desc, list_position(['latin', 'cyrillic', 'other', 'none'], script)) r from v) where r = 1"""


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.personal_data import find

    s = table(spark, d, "submissions").select("id", "raw_payload", "normalized_text")
    return find(s, "id").select(F.col("id").alias("submission_id"), "field", "kind").distinct()


@query
def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders in place of personal items."""
    from millrace.llm.personal_data import mask

    return mask(table(spark, d, "submissions").select("id", "raw_payload", "normalized_text"), "id").withColumnRenamed("id", "submission_id")


@query
def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that ask an item's question with other numbers, units or names."""
    from millrace.llm.leakage import reparameterised

    found = reparameterised(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", "lang")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "changed")


@query
def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Each text's languages with a confidence; mixed texts have a row for each."""
    from millrace.llm import languages as lg

    found = lg.detect(language_records(spark, d), table(spark, d, "lang_samples"))
    return found.select("tab", F.col("id").alias("rec_id"), F.explode("languages").alias("l")).select("tab", "rec_id", "l.label", F.round("l.confidence", 4).alias("confidence"), "l.letters")


@query
def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of one language: 1-based start and length in code points of the record's own words, label and confidence."""
    from millrace.llm import languages as lg

    found = lg.detect(language_records(spark, d), table(spark, d, "lang_samples"))
    return found.select("tab", F.col("id").alias("rec_id"), F.explode("stretches").alias("s")).select("tab", "rec_id", "s.start", "s.length", "s.label", F.round("s.confidence", 4).alias("confidence"))


@query
def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form."""
    from millrace.llm.lookalikes import unify

    return unify(table(spark, d, "submissions"), "id", "normalized_text").select("id", "text")
