"""Association rules, similarity, clustering, classification and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import association, classification, clustering, evaluation, reduction, regression, similarity
from millrace.plans.registry import query
from millrace.session import materialize
from millrace.sources.tables import table


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """The items of each clean submission."""
    f = table(spark, d, "formtrap_spam_clean")
    n = F.char_length(F.coalesce("message", F.lit("")))
    return f.select(
        F.monotonically_increasing_id().alias("tx"),
        association.items_of({
            "len empty": n == 0, "len short": (n > 0) & (n <= 200), "len medium": (n > 200) & (n <= 500), "len long": n > 500, "script latin": F.col("script") == "latin", "script cyrillic": F.col("script") == "cyrillic",
            "url": F.coalesce("message", F.lit("")).contains("http"), "form v1": F.col("form_version") == "v1_split_name", "form v2": F.col("form_version") == "v2_full_name",
            "honeypot filled": F.col("honeypot_filled") == 1, "honeypot empty": F.col("honeypot_filled") == 0,
        }).alias("items"),
    )


_ITEMS = """(select row_number() over () tx, list_filter([case when length(coalesce(message, '')) = 0 then 'len empty' end, case when length(message) between 1 and 200 then 'len short' end, case when length(message) between 201 and 500 then 'len medium' end,
 case when length(message) > 500 then 'len long' end, case when script = 'latin' then 'script latin' end, case when script = 'cyrillic' then 'script cyrillic' end, case when contains(message, 'http') then 'url' end,
 case when form_version = 'v1_split_name' then 'form v1' end, case when form_version = 'v2_full_name' then 'form v2' end, case when honeypot_filled = 1 then 'honeypot filled' end, case when honeypot_filled = 0 then 'honeypot empty' end], lambda x: x is not null) items from formtrap_spam_clean)"""
_L = f"l as (select tx, unnest(items) i from {_ITEMS}), n as (select count(*) n from formtrap_spam_clean)"
_SETS = f"""{_L}, s1 as (select [i] itemset, count(*) c from l group by i), s2 as (select [a.i, b.i] itemset, count(*) c from l a join l b on a.tx = b.tx and a.i < b.i group by a.i, b.i),
 s3 as (select [a.i, b.i, c.i] itemset, count(*) c from l a join l b on a.tx = b.tx and a.i < b.i join l c on b.tx = c.tx and b.i < c.i group by a.i, b.i, c.i),
 s4 as (select [a.i, b.i, c.i, e.i] itemset, count(*) c from l a join l b on a.tx = b.tx and a.i < b.i join l c on b.tx = c.tx and b.i < c.i join l e on c.tx = e.tx and c.i < e.i group by a.i, b.i, c.i, e.i),
 s5 as (select [a.i, b.i, c.i, e.i, f.i] itemset, count(*) c from l a join l b on a.tx = b.tx and a.i < b.i join l c on b.tx = c.tx and b.i < c.i join l e on c.tx = e.tx and c.i < e.i join l f on e.tx = f.tx and e.i < f.i group by all),
 f as (select itemset, c, c * 1.0 / (select n from n) support from (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4 union all select * from s5) where c >= 0.1 * (select n from n))"""


@query(f"with {_SETS} select list_aggregate(itemset, 'string_agg', '; ') itemset, c n, round(support, 6) support from f")
def apriori_itemsets(spark: SparkSession, d: str) -> DataFrame:
    s = association.frequent_itemsets(transactions(spark, d), "items", 0.1)
    return s.select(F.array_join("itemset", "; ").alias("itemset"), "n", F.round("support", 6).alias("support"))


@query(f"""with {_SETS}, r as (select a.itemset ante, x.itemset whole, x.support, x.support / a.support confidence, list_filter(x.itemset, lambda y: not list_contains(a.itemset, y)) cons from f x join f a on len(a.itemset) < len(x.itemset) and list_has_all(x.itemset, a.itemset))
 select list_aggregate(r.ante, 'string_agg', '; ') antecedent, list_aggregate(r.cons, 'string_agg', '; ') consequent, round(r.support, 6) support, round(r.confidence, 6) confidence, round(r.confidence / c.support, 6) lift from r join f c on c.itemset = r.cons where r.confidence >= 0.8""")
def assoc_rules(spark: SparkSession, d: str) -> DataFrame:
    r = association.rules(association.frequent_itemsets(transactions(spark, d), "items", 0.1), 0.8)
    return r.select(F.array_join("antecedent", "; ").alias("antecedent"), F.array_join("consequent", "; ").alias("consequent"), *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


#: No set has more than five items: the groups of items that shut each other out are five.
_LOW = _SETS.replace("c >= 0.1 *", "c >= 0.05 *")
_SPLITS = "r as (select a.itemset ante, x.support, x.support / a.support confidence, list_filter(x.itemset, lambda y: not list_contains(a.itemset, y)) cons from f x join f a on len(a.itemset) < len(x.itemset) and list_has_all(x.itemset, a.itemset))"


def _kept(level: int) -> str:
    """Rules of ``level`` antecedent items that no kept shorter rule makes redundant."""
    before = " union all ".join(f"select ante, confidence from k{k}" for k in range(1, level))
    test = f" and not exists (select 1 from ({before}) b where list_has_all(r.ante, b.ante) and b.confidence >= r.confidence - 0.02)" if before else ""
    return f"k{level} as (select r.* from t r where len(r.ante) = {level}{test})"


@query(f"""with {_LOW}, {_SPLITS}, t as (select r.ante, r.support, r.confidence, r.confidence / c.support lift from r join f c on c.itemset = r.cons where r.cons = ['honeypot filled'] and r.confidence >= 0.5 - 1e-12 and not list_has_any(r.ante, ['honeypot empty', 'honeypot filled'])),
 {', '.join(map(_kept, (1, 2, 3, 4)))} select list_aggregate(ante, 'string_agg', '; ') antecedent, 'honeypot filled' consequent, round(support, 6) support, round(confidence, 6) confidence, round(lift, 6) lift
 from (select * from k1 union all select * from k2 union all select * from k3 union all select * from k4) order by round(lift, 9) desc, support desc, list_aggregate(ante, 'string_agg', ',') limit 6""")
def assoc_rules_pruned(spark: SparkSession, d: str) -> DataFrame:
    r = association.rules(association.frequent_itemsets(transactions(spark, d), "items", 0.05), 0.5)
    p = association.target_rules(r, "honeypot filled", ["honeypot empty", "honeypot filled"])
    return p.select(F.array_join("antecedent", "; ").alias("antecedent"), F.array_join("consequent", "; ").alias("consequent"), *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query(f"""with {_LOW}, {_SPLITS}, g as (select s.s, c.c from (values (0.05), (0.1), (0.2), (0.3)) s(s), (values (0.6), (0.8), (0.9)) c(c))
 select cast(g.s as double) min_support, cast(g.c as double) min_confidence, (select count(*) from r where support >= g.s - 1e-12 and confidence >= g.c - 1e-12) rules, (select count(*) from f where support >= g.s - 1e-12) itemsets from g""")
def assoc_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return association.sensitivity(association.frequent_itemsets(transactions(spark, d), "items", 0.05), [0.05, 0.1, 0.2, 0.3], [0.6, 0.8, 0.9])


@query(f"""with x as (select list_contains(items, 'script latin') and list_contains(items, 'url') a, list_contains(items, 'len long') c from {_ITEMS}) select round(count_if(a and c) * 1.0 / count(*), 6) support, round(count_if(a and c) * 1.0 / count_if(a), 6) confidence,
 round(count_if(a and c) * 1.0 * count(*) / (count_if(a) * count_if(c)), 6) lift from x""")
def verified_rule(spark: SparkSession, d: str) -> DataFrame:
    v = association.verify_rule(transactions(spark, d), "items", ["script latin", "url"], ["len long"])
    return v.select(*[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query(f"""with {_SETS}, r as (select a.itemset ante, x.support / a.support confidence, list_filter(x.itemset, lambda y: not list_contains(a.itemset, y)) cons from f x join f a on len(a.itemset) = len(x.itemset) - 1 and list_has_all(x.itemset, a.itemset))
 select list_aggregate(ante, 'string_agg', '; ') antecedent, cons[1] consequent, (select count(*) from {_ITEMS} t where list_has_all(t.items, r.ante)) n from r where confidence >= 0.8 - 1e-12""")
def mined_rule_match(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each mined rule of one consequent fits."""
    found = association.rules(association.frequent_itemsets(transactions(spark, d), "items", 0.1), 0.8).where(F.size("consequent") == 1)
    m = association.match_rules(transactions(spark, d), "tx", "items", materialize(found, "rules"))
    return m.groupBy(F.array_join("antecedent", "; ").alias("antecedent"), F.element_at("consequent", 1).alias("consequent")).agg(F.count(F.lit(1)).alias("n"))


def queries_against(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set of searches (ids divisible by 100) and all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    return q, e.select("vec_id", F.col("embedding").alias("y"), "label")


@query("""select a.vec_id q, b.vec_id, round(list_sum([abs(x) for x in list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double - z[2]::double)]), 4) m1, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) ** 2))), 4) m2,
 round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double) ** 3)) ** (1.0 / 3), 4) m3 from embeddings a join embeddings b on a.vec_id % 100 = 0""")
def minkowski_1_2_3(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the query set to all rows; the query set is sent out in one block (a hundredth of the rows)."""
    q, e = queries_against(spark, d)
    j = e.join(q, F.lit(True))
    return j.select("q", "vec_id", *[F.round(similarity.minkowski(F.col("x"), F.col("y"), r), 4).alias(f"m{r}") for r in (1, 2, 3)])


@query("""with b as (select vec_id, [(x > 0)::int for x in embedding] v from embeddings), j as (select a.vec_id q, b.vec_id, list_transform(list_zip(a.v, b.v), lambda z: z[1] * 2 + z[2]) z from b a join b on a.vec_id % 100 = 0)
 select q, vec_id, round(len(list_filter(z, lambda x: x in (0, 3))) / 64.0, 6) smc, round(coalesce(len(list_filter(z, lambda x: x = 3)) * 1.0 / nullif(len(list_filter(z, lambda x: x <> 0)), 0), 0), 6) jaccard from j""")
def smc_jaccard(spark: SparkSession, d: str) -> DataFrame:
    q, e = queries_against(spark, d)
    bits = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    j = e.withColumn("y", bits("y")).join(q.withColumn("x", bits("x")), F.lit(True))
    s = similarity.smc_jaccard(F.col("x"), F.col("y"))
    return j.select("q", "vec_id", F.round(s["smc"], 6).alias("smc"), F.round(s["jaccard"], 6).alias("jaccard"))


@query("""select q, vec_id, round(c, 6) as cosine from (select a.vec_id q, b.vec_id, list_cosine_similarity([x::double for x in a.embedding], [x::double for x in b.embedding]) c, row_number() over (partition by a.vec_id order by round(list_cosine_similarity([x::double for x in a.embedding], [x::double for x in b.embedding]), 9) desc, b.vec_id) r
 from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) where r <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar rows of each query; partial top lists are merged, never whole rankings."""
    q, e = queries_against(spark, d)
    j = e.join(q, F.lit(True)).where("q <> vec_id").select("q", "vec_id", similarity.cosine(F.col("x"), F.col("y")).alias("cosine"))
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 5").select("q", "vec_id", F.round("cosine", 6).alias("cosine"))



def _tok(name: str, key: str) -> str:
    return rf"(select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200c}}\x{{200d}}]{{2,}}')) term from {name})"


def _tfidf(name: str, key: str) -> str:
    return f"""tf as (select {key}, term, count(*) tf from {_tok(name, key)} group by all), n as (select count(*) n from {name}), df as (select term, count(*) df from tf group by 1 having count(*) >= 2),
 raw as (select {key}, tf.term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) w from tf join df on tf.term = df.term, n), w as (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) weight from raw)"""


#: One message for each template.
_DISTINCT = "(select lower(trim(template_id)) k, min(message) as text from formtrap_spam_clean where trim(template_id) <> '' and message is not null group by 1)"
_TFIDF = _tfidf(_DISTINCT, "k")


def distinct_messages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean").where("trim(template_id) <> '' and message is not null")
    return f.groupBy(F.lower(F.trim("template_id")).alias("k")).agg(F.min("message").alias("text"))


@query(f"with {_tfidf('documents', 'doc_id')} select doc_id, term, round(weight, 6) weight from w")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return similarity.tfidf(table(spark, d, "documents"), "doc_id", "text", max_terms=None).withColumn("weight", F.round("weight", 6))


@query(f"with {_TFIDF} select a.k a, b.k b, round(sum(a.weight * b.weight), 6) as cosine from w a join w b on a.term = b.term and a.k < b.k group by 1, 2 having sum(a.weight * b.weight) >= 0.5")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of templates whose messages are alike."""
    w = similarity.tfidf(distinct_messages(spark, d), "k", "text", max_terms=None)
    return similarity.cosine_pairs(w, "k", 0.5).withColumn("cosine", F.round("cosine", 6))


@query(f"with {_TFIDF}, p as (select a.k a, b.k b, sum(a.weight * b.weight) c from w a join w b on a.term = b.term and a.k <> b.k group by 1, 2), m as (select a, max(c) c from p group by 1), t as (select count(*) * 1.0 n from {_DISTINCT}) select round(count(*) filter (where c >= 0.5) / max(n), 6) at_50, round(count(*) filter (where c >= 0.7) / max(n), 6) at_70, round(count(*) filter (where c >= 0.9) / max(n), 6) at_90 from m, t")
def near_duplicate_shares(spark: SparkSession, d: str) -> DataFrame:
    s = distinct_messages(spark, d)
    best = similarity.best_cosines(similarity.tfidf(s, "k", "text", max_terms=None), "k", 0.5)
    n = s.agg(F.count(F.lit(1)).alias("n"))  # one row
    one = best.agg(*[F.count_if(F.col("cosine") >= x).alias(f"at_{int(x * 100)}") for x in (0.5, 0.7, 0.9)]).join(n, F.lit(True))
    return one.select(*[F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("at_50", "at_70", "at_90")])


@query()
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ratio of every cluster's example to the pattern of each of its signatures."""
    from millrace.functions.text import levenshtein_ratio

    c = table(spark, d, "clusters").select("id", "example", F.explode(F.array_distinct("signature_ids")).alias("sid"))
    j = c.join(table(spark, d, "signatures").select(F.col("id").alias("sid"), "pattern"), "sid")
    return j.select("id", "sid", F.round(levenshtein_ratio(F.col("example"), F.col("pattern")), 6).alias("ratio"))


@query()
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Signatures joined to earlier leaders, all against all, by their whole patterns."""
    found = similarity.greedy_clusters(table(spark, d, "signatures"), "id", "pattern", "occurrence", prefix=None)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))


_ATTR = "(select script, form_version, source_block, has_message::varchar has_message, honeypot_filled y from formtrap_spam_clean where honeypot_filled is not null)"


def _gain(a: str) -> str:
    return f"""select '{a}' attribute, count(*) as "values", h0 - sum(n * h) / t gain, log2(t) - sum(n * log2(n)) / t split_info from (select {a} v, count(*) n, sum(y) p, case when sum(y) in (0, count(*)) then 0 else -(sum(y) / count(*) * log2(sum(y) / count(*)) + (1 - sum(y) / count(*)) * log2(1 - sum(y) / count(*))) end h from x group by 1),
 (select count(*) t, -(avg(y) * log2(avg(y)) + (1 - avg(y)) * log2(1 - avg(y))) h0 from x) group by h0, t"""


@query(f"""with x as {_ATTR} select attribute, "values", round(gain, 6) gain, round(split_info, 6) split_info, round(case when split_info > 1e-12 then gain / split_info else 0 end, 6) gain_ratio from ({' union all '.join(map(_gain, ('script', 'form_version', 'source_block', 'has_message')))})""")
def info_gain_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = classification.split_measures(table(spark, d, "formtrap_spam_clean"), ["script", "form_version", "source_block", "has_message"], "honeypot_filled")
    return m.select("attribute", "values", *[F.round(c, 6).alias(c) for c in ("gain", "split_info", "gain_ratio")])


_LAB = "(select doc_id, (doc_kind = 'spam')::int y from documents where doc_kind is not null)"
_MNB = f"""tf as (select doc_id, term, count(*) tf from {_tok('documents', 'doc_id')} group by all), lab as {_LAB}, c as (select y, term, sum(tf) c from tf join lab using (doc_id) group by 1, 2), tot as (select y, sum(c) t from c group by 1), v as (select distinct term from c),
 ll as (select tot.y, v.term, ln((coalesce(c.c, 0) + 1.0) / (tot.t + (select count(*) from v))) ll from v join tot on true left join c on c.y = tot.y and c.term = v.term), pr as (select y, ln(count(*) * 1.0 / (select count(*) from lab)) lp from lab group by 1)"""


def _nb(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "documents").select("doc_id", "text", "doc_kind")
    counts = materialize(similarity.term_counts(s, "doc_id", "text"), "terms")
    labels = s.where("doc_kind is not null").select("doc_id", (F.col("doc_kind") == "spam").cast("int").alias("y"))
    return s, counts, labels, *classification.multinomial_nb(counts, labels, "doc_id", "y")


@query(f"with {_MNB} select y, term, round(ll, 6) log_likelihood from ll")
def mnb_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return _nb(spark, d)[4].withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(f"with {_MNB}, s as (select doc_id, pr.y, round(lp + coalesce(sum(tf * ll), 0), 6) s from documents join pr on true left join tf using (doc_id) left join ll on ll.y = pr.y and ll.term = tf.term group by doc_id, pr.y, lp) select doc_id, prediction from (select doc_id, y prediction, row_number() over (partition by doc_id order by s desc, y) r from s) where r = 1")
def mnb_predict(spark: SparkSession, d: str) -> DataFrame:
    s, counts, _, prior, like = _nb(spark, d)
    return classification.multinomial_predict(counts, s, "doc_id", "y", prior, like)


@query(f"""with x as (select term, y, count(*) tf from {_tok('documents', 'doc_id')} join {_LAB} lab using (doc_id) group by 1, 2), w as (select term, sum(tf) n, coalesce(sum(case when y = 1 then tf end), 0) a, coalesce(sum(case when y = 0 then tf end), 0) b from x group by 1),
 t as (select sum(a) ta, sum(b) tb, count(*) v from w) select term, n::bigint n, round(ln((a + 1.0) / (ta + v)) - ln((b + 1.0) / (tb + v)), 6) llr from w, t where n >= 30""")
def word_llr(spark: SparkSession, d: str) -> DataFrame:
    _, counts, labels, _, _ = _nb(spark, d)
    return classification.word_ratios(counts, labels, "doc_id", "y").withColumn("llr", F.round("llr", 6))


def binary(spark: SparkSession, d: str) -> DataFrame:
    """All vectors with a 0/1 label: whether they are of the upper half of the classes."""
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))


def binary_features(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return binary(spark, d).select("vec_id", F.col("y").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("""with t as (select vec_id, embedding e, (label >= 5)::int y from embeddings), j as (select a.vec_id, b.y, row_number() over (partition by a.vec_id order by round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1]::double - z[2]::double) ** 2)), 9), b.vec_id) r from t a join t b on a.vec_id % 100 = 0 and b.vec_id % 100 <> 0)
 select vec_id, (2 * sum(y) > 5)::int prediction from j where r <= 5 group by 1""")
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (ids divisible by 100) classified by all other rows, k = 5."""
    t = binary(spark, d)
    return classification.knn(t.where("vec_id % 100 <> 0"), t.where("vec_id % 100 = 0"), "vec_id", "embedding", "y", 5).select("vec_id", "prediction")


@query("""with u as (select vec_id, label, unnest(range(1, 65)) i, unnest(embedding)::double x from embeddings), m as (select label, i, avg(x) m from u group by 1, 2), dd as (select u.vec_id, m.label l, sum((u.x - m.m) ** 2) dist from u join m on u.i = m.i group by 1, 2)
 select vec_id, prediction from (select vec_id, l prediction, row_number() over (partition by vec_id order by dist, l) r from dd) where r = 1""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return classification.nearest_centroid(e, e, "vec_id", "embedding", "label", 64)


_KM = "with u as (select vec_id, unnest(range(1, 65)) i, unnest(embedding)::double x from embeddings), c0 as (select vec_id k, i, x m from u where vec_id in (1, 2, 3))"


def _km(prev: str, name: str) -> str:
    return f""", d{name} as (select u.vec_id, c.k, sum((u.x - c.m) ** 2) dist from u join {prev} c on u.i = c.i group by 1, 2), a{name} as (select vec_id, k, dist from (select *, row_number() over (partition by vec_id order by dist, k) r from d{name}) where r = 1),
 c{name} as (select a.k, u.i, avg(u.x) m from u join a{name} a on u.vec_id = a.vec_id group by 1, 2)"""


def _starts(spark: SparkSession, d: str) -> list[list[float]]:
    rows = table(spark, d, "embeddings").where("vec_id in (1, 2, 3)").orderBy("vec_id").collect()
    return [list(r["embedding"]) for r in rows]


@query(f"{_KM}{_km('c0', '1')} select k, i, round(m, 5) m from c1")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    new, _ = clustering.kmeans_step(table(spark, d, "embeddings"), "embedding", _starts(spark, d))
    return spark.createDataFrame([(k + 1, i + 1, round(m, 5)) for k, c in enumerate(new) for i, m in enumerate(c)], "k long, i long, m double")


@query(f"{_KM}{_km('c0', '1')}{_km('c1', '2')}{_km('c2', '3')} select vec_id, k as cluster from a3")
def kmeans_fixed_iter(spark: SparkSession, d: str) -> DataFrame:
    """Clusters after two moves of three given centroids."""
    e = table(spark, d, "embeddings")
    c, _ = clustering.kmeans(e, "embedding", _starts(spark, d), max_iter=2)
    return clustering.assign(e, "vec_id", "embedding", c).select("vec_id", (F.col("cluster") + 1).cast("long").alias("cluster"))


@query("""with x as (select ln(1 + n_chars) x from documents where n_chars > 0), p as (select x, 0.5 * exp(-0.5 * (x - 5) ** 2) a, 0.5 * exp(-0.5 * (x - 7) ** 2) b from x), r as (select x, a / (a + b) r from p)
 select round(sum(r * x) / sum(r), 6) mu0, round(sum((1 - r) * x) / sum(1 - r), 6) mu1, round(avg(r), 6) w0, round(sqrt(sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) ** 2), 6) s0 from r""")
def em_step(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("n_chars > 0").select(F.log1p("n_chars").alias("x"))
    mu, sigma, w, _ = clustering.em_step(x, "x", [5.0, 7.0], [1.0, 1.0], [0.5, 0.5])
    return spark.createDataFrame([(round(mu[0], 6), round(mu[1], 6), round(w[0], 6), round(sigma[0], 6))], "mu0 double, mu1 double, w0 double, s0 double")


@query("""select var_samp(l_quantity) * 0 + round((var_samp(l_quantity) + var_samp(l_discount * 100)) / 2 + sqrt(((var_samp(l_quantity) - var_samp(l_discount * 100)) / 2) ** 2 + covar_samp(l_quantity, l_discount * 100) ** 2), 4) lambda1,
 round((var_samp(l_quantity) + var_samp(l_discount * 100)) / 2 - sqrt(((var_samp(l_quantity) - var_samp(l_discount * 100)) / 2) ** 2 + covar_samp(l_quantity, l_discount * 100) ** 2), 4) lambda2 from lineitem""")
def pca_2x2(spark: SparkSession, d: str) -> DataFrame:
    p = reduction.pca_2x2(F.col("l_quantity"), F.col("l_discount") * 100)
    return table(spark, d, "lineitem").agg(F.round(p["lambda1"], 4).alias("lambda1"), F.round(p["lambda2"], 4).alias("lambda2"))


@query("""with c as (select honeypot_filled a, coalesce(honeypot_reliable, 0) b, count(*) n from formtrap_spam_clean where honeypot_filled is not null group by 1, 2), s as (select sum(n * (n - 1) / 2.0) ij, sum(n) t from c), ai as (select sum(n * (n - 1) / 2.0) v from (select sum(n) n from c group by a)), bj as (select sum(n * (n - 1) / 2.0) v from (select sum(n) n from c group by b))
 select round((ij - ai.v * bj.v / (t * (t - 1) / 2.0)) / ((ai.v + bj.v) / 2 - ai.v * bj.v / (t * (t - 1) / 2.0)), 6) ari from s, ai, bj""")
def ari(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "formtrap_spam_clean").where("honeypot_filled is not null").withColumn("r", F.coalesce("honeypot_reliable", F.lit(0)))
    return clustering.adjusted_rand(f, "honeypot_filled", "r").select(F.round("ari", 6).alias("ari"))


_PRED = "(select script, honeypot_filled y, contains(message, 'http')::int p, coalesce(length(message), 0) s from formtrap_spam_clean where honeypot_filled is not null)"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """The baseline that calls a message with a web address spam, and its length as a score."""
    f = table(spark, d, "formtrap_spam_clean").where("honeypot_filled is not null")
    return f.select("script", F.col("honeypot_filled").alias("y"), F.col("message").contains("http").cast("int").alias("p"), F.coalesce(F.char_length("message"), F.lit(0)).alias("s"))


@query(f"""select script, tp, fn, fp, tn, round((tp + tn) * 1.0 / nullif(tp + fn + fp + tn, 0), 6) accuracy, round((coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) + coalesce(tn * 1.0 / nullif(tn + fp, 0), 0)) / 2, 6) balanced_accuracy from (select script, count_if(y = 1 and p = 1) tp, count_if(y = 1 and p = 0) fn, count_if(y = 0 and p = 1) fp, count_if(y = 0 and p = 0) tn from {_PRED} group by 1) where tp + fn + fp + tn > 0""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.scored_metrics(predicted(spark, d), ["script"], "y", "p").where("tp + fn + fp + tn > 0")
    return m.select("script", "tp", "fn", "fp", "tn", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"with r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from {_PRED}) select round((sum(k) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) auc from r")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(predicted(spark, d), "y", "s").select(F.round("auc", 6).alias("auc"))


@query(f"select t.t threshold, count_if(y = 1 and s >= t.t) tp, count_if(y = 1 and s < t.t) fn, count_if(y = 0 and s >= t.t) fp, count_if(y = 0 and s < t.t) tn from {_PRED}, (values (100.0), (200.0), (400.0), (600.0)) t(t) group by 1")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.threshold_table(predicted(spark, d), "y", "s", [100, 200, 400, 600]).select("threshold", "tp", "fn", "fp", "tn")


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 from lineitem")
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    f = regression.line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""with m as (select date_trunc('month', timestamp) mo, avg(honeypot_filled) y from formtrap_spam_clean where timestamp is not null group by 1), p as (select date_diff('month', (select min(mo) from m), mo)::double x, y from m where y is not null),
 s as (select count(*)::double n, sum(x) a, sum(x * x) b, sum(x ** 3) c, sum(x ** 4) e, sum(y) y0, sum(x * y) y1, sum(x * x * y) y2, sum(y * y) yy from p), z as (select *, n * (b * e - c * c) - a * (a * e - b * c) + b * (a * c - b * b) det from s),
 k as (select *, (y0 * (b * e - c * c) - a * (y1 * e - c * y2) + b * (y1 * c - b * y2)) / det c0, (n * (y1 * e - c * y2) - y0 * (a * e - b * c) + b * (a * y2 - b * y1)) / det c1, (n * (b * y2 - c * y1) - a * (a * y2 - b * y1) + y0 * (a * c - b * b)) / det c2 from z)
 select round(c0, 6) c0, round(c1, 6) c1, round(c2, 6) c2, round(1 - (select sum((p.y - k.c0 - k.c1 * p.x - k.c2 * p.x * p.x) ** 2) from p) / (yy - y0 * y0 / n), 6) r2 from k""")
def poly2_fit(spark: SparkSession, d: str) -> DataFrame:
    """A parabola through the monthly rate of filled traps."""
    m = regression.monthly(table(spark, d, "formtrap_spam_clean"), "timestamp", "honeypot_filled")
    c, r2 = regression.polynomial(m, "t", "rate", 2)
    return spark.createDataFrame([tuple(round(float(x), 6) for x in (*c, r2))], "c0 double, c1 double, c2 double, r2 double")


@query()
def pca_full(spark: SparkSession, d: str) -> DataFrame:
    scores, _, _ = reduction.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 5)
    return scores


@query()
def gmm_bic(spark: SparkSession, d: str) -> DataFrame:
    """BIC of diagonal mixtures of one to three Gaussians on the first components."""
    scores, _, _ = reduction.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 3)
    starts = [list(r["scores"]) for r in scores.where("vec_id in (1, 2, 3)").orderBy("vec_id").collect()]
    out = [(k, float(clustering.gmm_diagonal(scores, "scores", starts[:k], max_iter=8)["bic"])) for k in (1, 2, 3)]
    return spark.createDataFrame(out, "k int, bic double")


@query()
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    e = binary(spark, d)
    return classification.Mahalanobis().fit(e, "embedding", "y", 64).transform(e, "vec_id")


@query()
def logistic_cv(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of L2 logistic regression on vectors."""
    e = binary_features(spark, d)
    folds = evaluation.stratified_folds(e, "vec_id", "label")
    return evaluation.cross_validate(folds, lambda train: classification.logistic(train, "features", "label"), "features", "label")


@query()
def tree_predictions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return classification.tree(e, "features", "label").transform(e).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query()
def kmeans_scan(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return spark.createDataFrame(clustering.kmeans_scan(e, "features", [4, 6]), "k int, cost double, silhouette double")


@query()
def kmedoids(spark: SparkSession, d: str) -> DataFrame:
    """Four medoids of a bounded sample of 200 vectors; the table of its distances is the operator's input."""
    from millrace.operators.relational import sample_n

    e = sample_n(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", 200)
    a, b = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    pairs = a.join(b, F.col("i") != F.col("j")).select("i", "j", (1 - similarity.cosine(F.col("x"), F.col("y"))).alias("d"))
    medoids, cost = clustering.kmedoids(pairs, [r["vec_id"] for r in e.select("vec_id").collect()], 4, restarts=2, max_iter=5)
    return spark.createDataFrame([(m, float(cost)) for m in medoids], "medoid long, cost double")


@query()
def perceptron(spark: SparkSession, d: str) -> DataFrame:
    _, _, errors = classification.perceptron(binary(spark, d), "embedding", "y", "vec_id", epochs=20)
    return spark.createDataFrame(list(enumerate(errors)), "epoch int, errors int")


@query()
def mlp(spark: SparkSession, d: str) -> DataFrame:
    e = binary_features(spark, d)
    return classification.mlp(e, "features", "label", 64, 8, 20).transform(e).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query()
def naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return classification.gaussian_nb(e, "features", "label").transform(e).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query(f"""with t as (select s, count_if(y = 1) p, count_if(y = 0) q from {_PRED} group by 1), w as (select s threshold, sum(p) over (order by s desc) cp, sum(q) over (order by s desc) cq, sum(p) over () tp, sum(q) over () tq from t) select threshold, round(cp / tp, 6) tpr, round(cq / tq, 6) fpr from w""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc(predicted(spark, d), "y", "s").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


#: The candidates of the choice: a threshold on message length each, with their size in bytes and latency in milliseconds.
_CANDIDATES = (("over_100", 100, 1000.0, 1.0), ("over_200", 200, 2000.0, 2.0), ("over_400", 400, 9e6, 1.0), ("over_600", 600, 10.0, 0.5))


@query(f"""with c as (select * from (values {', '.join(f"('{m}', {t}, {float(b)}, {l})" for m, t, b, l in _CANDIDATES)}) c(model, t, bytes, ms)), k as (select model, bytes, ms, count(*) filter (where y = 1 and s >= t) tp, count(*) filter (where y = 1 and s < t) fn, count(*) filter (where y = 0 and s >= t) fp from {_PRED}, c group by 1, 2, 3),
 f as (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from k where bytes < 5e6 and ms < 10) select model, round(f1, 6) f1, fp as false_positives from f where f1 >= (select max(f1) from f) - 0.01 order by fp, model limit 1""")
def select_model(spark: SparkSession, d: str) -> DataFrame:
    """The choice under limits of size and latency, among thresholds of message length measured on the labelled rows."""
    t = evaluation.threshold_table(predicted(spark, d), "y", "s", [x for _, x, _, _ in _CANDIDATES]).select("threshold", "f1", F.col("fp").alias("false_positives"))
    sizes = spark.createDataFrame([(m, float(x), b, ms) for m, x, b, ms in _CANDIDATES], "model string, threshold double, bytes double, ms double")
    found = evaluation.select_model(t.join(sizes, "threshold").withColumn("auc", F.lit(0.0)), 5e6, 10.0)
    return found.select("model", F.round("f1", 6).alias("f1"), "false_positives")


@query("""with f as (select lower(trim(template_id)) c, * from formtrap_spam_clean where template_id is not null), b as (select c, count(distinct template_id) templates, count(*) submissions, round(avg(honeypot_filled), 6) hit_rate, min(year(timestamp))::int first_year, max(year(timestamp))::int last_year from f group by 1),
 m as (select c, script, row_number() over (partition by c order by count(*) desc, script) r from f where script is not null group by 1, 2) select b.*, m.script from b left join m on b.c = m.c and m.r = 1""")
def campaign_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Size, hit rate, script and years of each template's campaign."""
    f = table(spark, d, "formtrap_spam_clean").where("template_id is not null")
    return clustering.profile(f.withColumn("c", F.lower(F.trim("template_id"))), "c", "template_id", "honeypot_filled", "script", "timestamp").withColumn("hit_rate", F.round("hit_rate", 6))
