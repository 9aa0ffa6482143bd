"""Models on the feature matrix of the submissions: preparation, scans, controls and the scoring service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import association, classification, clustering, evaluation, modelling, prep, reduction, similarity
from millrace.operators.ingest import trap_hits
from millrace.plans.registry import query
from millrace.session import materialize
from millrace.sources.tables import table

#: The first year of the test part of a split by time.
TEST_YEAR = 2025


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """``id, name, email, phone, message, label, template, year`` of submissions with a payload: label 1 if a text trap was filled."""
    p = "raw_payload"
    s = table(spark, d, "submissions").where(f"{p} is not null")
    hit = (F.size(F.array_remove(trap_hits(), "security_token_missing")) > 0).cast("int")
    fields = [F.col(f"{p}.{f}").alias(f) for f in ("name", "email", "phone", "message")]
    s = s.select("id", *fields, hit.alias("label"), F.year("created_at").alias("year"))
    return s.withColumn("template", tx.template_id(F.col("message")))


def matrix(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    m, names = prep.model_matrix(contacts(spark, d), ("id", "label", "template", "year", "message"))
    return materialize(modelling.vectors(m, names), "matrix"), names


def by_time(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = evaluation.time_split(m.withColumn("_t", F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))), "_t", TEST_YEAR)
    return s.where("not in_test"), s.where("in_test")


@query()
def model_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The 45 columns of the matrix with their mean, and which are binary."""
    m, names = matrix(spark, d)
    return prep.binary_columns(m, names)


_STRIP = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_FREE, _RU = (", ".join(f"'{x}'" for x in names) for names in (tx.FREE_MAIL, tx.RU_MAIL))
_ITEM_SQL = {
    "url=none": "u = 0", "url=one": "u = 1", "url=2+": "u >= 2", "len=empty": "n = 0", "len=short": "n between 1 and 50", "len=medium": "n between 51 and 300", "len=long": "n > 300",
    "script=latin": "2 * cyr <= letters and 2 * lat > letters", "script=cyrillic": "2 * cyr > letters", "markup=bbcode/html": r"(regexp_matches(lower(core), '\[/?url') or regexp_matches(lower(core), '<a\s|href=|</\w+>'))",
    "name=joined": r"regexp_full_match(nm, '[A-Z][a-z]+[A-Z][\p{L}\p{M}\p{Nd}\p{Pc}]*')", "email=free": f"host in ({_FREE})", "email=ru": f"(host in ({_RU}) or suffix(host, '.ru'))", "email=none": "em = ''",
    "phone=ru_format": "regexp_full_match(digits, '[78][0-9]{10}')", "phone=none": "ph = ''", "topic=money": f"regexp_matches(core, '(?i){tx.KEYWORDS['kw_money']}')",
    "topic=seo": f"regexp_matches(core, '(?i){tx.KEYWORDS['kw_seo']}')", "topic=crypto": f"regexp_matches(core, '(?i){tx.KEYWORDS['kw_crypto']}')", "honeypot=filled": "y = 1", "honeypot=empty": "y = 0",
}
_ITEMS_SQL = rf"""with a as (select {_STRIP.format('raw_payload.message')} t, {_STRIP.format('raw_payload.name')} nm, {_STRIP.format('raw_payload.email')} em, {_STRIP.format('raw_payload.phone')} ph,
 (coalesce(raw_payload.website_url, '') not in ('', '0') or coalesce(raw_payload.company_code, '') not in ('', '0'))::int y from submissions where raw_payload is not null),
 b as (select *, regexp_replace(t, '{tx.MASKS}', ' ', 'g') core, length(t) n, regexp_extract(lower(em), '([^@]*)$', 1) host, regexp_replace(ph, '[^0-9]', '', 'g') digits, len(regexp_extract_all(t, '{tx.URL.replace(chr(39), chr(39) * 2)}')) u from a),
 x as (select *, length(regexp_replace(core, '[^\p{{L}}]', '', 'g')) letters, length(regexp_replace(regexp_replace(core, '[^\p{{L}}]', '', 'g'), '[^\x{{400}}-\x{{4FF}}]', '', 'g')) cyr, length(regexp_replace(core, '[^A-Za-z]', '', 'g')) lat from b),
 r as ({' union all '.join(f"select '{k}' item, count(*) filter (where {v}) n from x" for k, v in _ITEM_SQL.items())}) select item, n from r where n > 0"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    c = contacts(spark, d)
    items = prep.transaction_items(tx.text_features(F.col("message")), tx.contact_features(*map(F.col, ("name", "email", "phone", "message"))), tx.script_of(F.col("message")), F.col("label"))
    return c.select("id", "name", "message", association.items_of(items).alias("items"))


@query(_ITEMS_SQL)
def transaction_item_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many submissions have each of the 21 items."""
    return _items(spark, d).select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy of each model: five folds that keep templates together, and the split by time, side by side."""
    m, _ = matrix(spark, d)
    folds = materialize(evaluation.grouped_stratified_folds(m, "template", "label"), "folds")
    train, test = by_time(m)
    models = modelling.candidates()
    cv = modelling.cross_validated(models, folds)
    time_ = modelling.held_out(models, train, test).select("model", F.col("balanced_accuracy").alias("by_time"))
    return evaluation.align([cv, time_]).select("model", *[F.round(c, 4).alias(c) for c in ("balanced_accuracy_mean", "balanced_accuracy_std", "by_time")])


@query()
def tree_depth_scan(spark: SparkSession, d: str) -> DataFrame:
    m, _ = matrix(spark, d)
    train, test = by_time(m)
    return modelling.depth_scan(train, test, [2, 4, 6])


@query()
def tree_importances(spark: SparkSession, d: str) -> DataFrame:
    m, names = matrix(spark, d)
    return modelling.importances(classification.tree(m, "features", "label", 4), names, m)


@query()
def subset_controls(spark: SparkSession, d: str) -> DataFrame:
    """The model on messages in Latin letters only, and of 20 to 200 characters only."""
    m, _ = matrix(spark, d)
    n = F.char_length(F.coalesce("message", F.lit("")))
    parts = {"all": F.lit(True), "latin only": F.col("script_latin") == 1, "20 to 200 characters": n.between(20, 200)}
    fit = {"logistic regression": modelling.candidates()["logistic regression"]}
    out = []
    for name, condition in parts.items():
        train, test = by_time(m.where(condition))
        out.append(modelling.held_out(fit, train, test).select(F.lit(name).alias("subset"), "tp", "fn", "fp", "tn", F.round("balanced_accuracy", 4).alias("balanced_accuracy")))
    return reduce(DataFrame.unionByName, out)


@query()
def cross_source(spark: SparkSession, d: str) -> DataFrame:
    """The message model tested on texts of another source: found spam, and false alarms by kind of document."""
    s = table(spark, d, "formtrap_spam_clean").where("message is not null and honeypot_filled is not null").select("message", F.col("honeypot_filled").alias("label"))
    x = table(spark, d, "documents").where("text is not null and doc_kind is not null").select(F.col("text").alias("message"), (F.col("doc_kind") == "spam").cast("int").alias("label"), "doc_kind")
    text_only = lambda df, keep: modelling.vectors(df.select(*keep, *[v.cast("double").alias(k) for k, v in tx.text_features(F.col("message")).items()]), list(tx.text_features(F.col("message"))))
    model = modelling.scaled_logistic(materialize(text_only(s, ["label"]), "source"))
    return modelling.predict(model, text_only(x, ["label", "doc_kind"]), ["label", "doc_kind"]).groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("flagged"))


@query()
def error_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Right and wrong decisions of the later years, with the median length of their messages."""
    m, _ = matrix(spark, d)
    train, test = by_time(m)
    p = modelling.predict(modelling.scaled_logistic(train), test, ["year", "message", "label"])
    return modelling.error_analysis(p, F.col("year"), F.char_length(F.coalesce("message", F.lit(""))))


@query("""with f as (select honeypot_filled y, honeypot_reliable r, contains(message, 'http')::int p from formtrap_spam_clean where honeypot_filled is not null and message is not null),
 u as (select 'as recorded' labels, y, p from f union all select 'usable', y, p from f where r = 1), c as (select labels, count(*) filter (where y = 1 and p = 1) tp, count(*) filter (where y = 1 and p = 0) fn, count(*) filter (where y = 0 and p = 1) fp, count(*) filter (where y = 0 and p = 0) tn from u group by 1)
 select labels, tp, fn, fp, tn, round((coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) + coalesce(tn * 1.0 / nullif(tn + fp, 0), 0)) / 2, 6) balanced_accuracy, round(coalesce(tn * 1.0 / nullif(tn + fp, 0), 0), 6) specificity from c""")
def as_recorded(spark: SparkSession, d: str) -> DataFrame:
    """What trusting every recorded label would say of the web-address rule, beside the usable labels."""
    f = table(spark, d, "formtrap_spam_clean").where("honeypot_filled is not null and message is not null")
    f = f.select(F.col("honeypot_filled").alias("y"), "honeypot_reliable", F.col("message").contains("http").cast("int").alias("p"))
    both = f.withColumn("labels", F.explode(F.array_compact(F.array(F.lit("as recorded"), F.when(F.col("honeypot_reliable") == 1, "usable")))))
    m = evaluation.scored_metrics(both, ["labels"], "y", "p")
    return m.select("labels", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "specificity")])


@query()
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """All features against the first components that hold nine tenths of the variance."""
    m, names = matrix(spark, d)
    train, test = by_time(m)
    _, values, _ = reduction.pca(m.select("id", F.array(*names).alias("x")), "id", "x", len(names), 1)
    _, enough = reduction.explained(values)
    models = {"all features": lambda t: modelling.scaled_logistic(t), "components of 90 %": lambda t: modelling.scaled_logistic(t, components=enough)}
    return modelling.held_out(models, train, test).select("model", F.round("balanced_accuracy", 4).alias("balanced_accuracy"))


@query("""with t as (select vec_id, [x::double for x in embedding] e, (label >= 5)::int y from embeddings), j as (select a.vec_id, b.y, row_number() over (partition by a.vec_id order by round(1 - list_cosine_similarity(a.e, b.e), 8), b.vec_id) r
 from t a join t b on a.vec_id % 100 = 0 and b.vec_id % 100 <> 0) select vec_id, (2 * sum(y) > 5)::int prediction from j where r <= 5 group by 1""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The query set (ids divisible by 100) classified by the five rows of the nearest direction: Euclidean neighbours of unit vectors."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("e", F.transform("e", lambda x: x / F.sqrt(similarity.dot(F.col("e"), F.col("e")))))
    return classification.knn(e.where("vec_id % 100 <> 0"), e.where("vec_id % 100 = 0"), "vec_id", "e", "y", 5).select("vec_id", "prediction")


@query()
def bernoulli_nb(spark: SparkSession, d: str) -> DataFrame:
    m, names = matrix(spark, d)
    binary = [r["column_name"] for r in prep.binary_columns(m, names).where("binary").collect()]
    x = modelling.vectors(m.select("id", "label", *binary), binary)
    return modelling.predict(classification.gaussian_nb(x, "features", "label", "bernoulli"), x, ["id"])


@query()
def mlp_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss of each iteration of a small network."""
    m, names = matrix(spark, d)
    curve = classification.mlp(m, "features", "label", len(names), 8, 15).summary().objectiveHistory
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(curve)], "iteration int, loss double")


@query()
def variance_explained(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative share of variance by component of the matrix, up to nine tenths, with the feature of largest loading."""
    m, names = matrix(spark, d)
    _, values, v = reduction.pca(m.select("id", F.array(*names).alias("x")), "id", "x", len(names), 1)
    share, enough = reduction.explained(values)
    return spark.createDataFrame([(k + 1, float(share[k]), reduction.loadings(v, names, k, 1)[0][0]) for k in range(enough)], "component int, share double, feature string")


def campaigns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(messages, weights, clusters, centroids) of the distinct messages by template."""
    from millrace.plans.mining_queries import distinct_messages

    messages = materialize(distinct_messages(spark, d), "messages")
    weights = materialize(similarity.tfidf(messages, "k", "text", min_df=3, max_df=0.4, stop=("the", "and", "http", "https", "www", "com", "example"), pattern=r"(?U)([^\W\d_]{2,})"), "weights")
    reduced = materialize(reduction.lsa(weights, "k", 10), "lsa")
    starts = [list(r["lsa"]) for r in reduced.orderBy(F.xxhash64("k"), "k").limit(6).collect()]
    centroids, _ = clustering.kmeans(reduced, "lsa", starts, max_iter=10)
    clusters = clustering.assign(reduced, "k", "lsa", centroids)
    return messages, weights, materialize(clusters, "clusters").join(reduced, "k"), centroids


@query()
def campaign_map(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each campaign; -1 for messages without known words, null for rows without a message."""
    _, _, clusters, _ = campaigns(spark, d)
    f = table(spark, d, "formtrap_spam_clean").select(F.lower(F.trim("template_id")).alias("k"), "message")
    mapped = modelling.campaign_of(f, "k", "message", clusters, clusters.select("k", "cluster"))
    return mapped.groupBy("campaign").agg(F.count(F.lit(1)).alias("n"))


@query()
def campaign_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each campaign's terms of highest mean weight, and the template nearest to its centroid."""
    _, weights, clusters, centroids = campaigns(spark, d)
    named = clustering.top_terms(weights, clusters.select("k", "cluster"), "k")
    return named.join(modelling.nearest_member(clusters.select("k", "lsa"), clusters.select("k", "cluster"), "k", "lsa", centroids), "cluster")


@query()
def lsa(spark: SparkSession, d: str) -> DataFrame:
    """Documents reduced to ten directions of their words."""
    stop = ("the", "and", "for", "http", "https", "www")
    w = similarity.tfidf(table(spark, d, "documents"), "doc_id", "text", min_df=3, max_df=0.4, stop=stop, pattern=r"(?U)([^\W\d_]{2,})")
    return reduction.lsa(w, "doc_id", 10)


@query()
def soft_membership(spark: SparkSession, d: str) -> DataFrame:
    """Share of vectors that belong to no component of a mixture with nine tenths or more."""
    from pyspark.ml.clustering import GaussianMixture

    scores, _, _ = reduction.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 3)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = scores.select("vec_id", array_to_vector("scores").alias("features"))
    g = GaussianMixture(k=3, seed=42, maxIter=20).fit(x).transform(x)
    return modelling.soft_membership(g.select("vec_id", vector_to_array("probability").alias("p")), "vec_id", "p")


@query()
def leakage_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over the whole published corpus: raw values of forms, addresses and numbers in masked messages."""
    s = table(spark, d, "submissions").where("raw_payload is not null")
    p = {f: F.col(f"raw_payload.{f}").alias(f) for f in ("name", "email", "phone", "message")}
    raw = s.select(*p.values())
    return prep.leakage(raw.select(tx.mask_pii(F.col("message"), F.col("name")).alias("t")), "t", raw, ["email", "phone"])


@query("""with x as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]{2,}')) term, (doc_kind = 'spam')::int y from documents),
 c as (select term, count(*) filter (where y = 1) a, count(*) filter (where y = 0) b from x where y is not null group by 1), s as (select sum(a) ta, sum(b) tb, count(*) v from c), w as (select term, ln((a + 1.0) / (ta + v)) - ln((b + 1.0) / (tb + v)) w from c, s where a + b >= 30),
 m as (select doc_id, x.term, count(*) * any_value(w.w) contribution from x join w using (term) where doc_id % 100 = 0 group by 1, 2), r as (select *, row_number() over (partition by doc_id order by round(contribution, 9) desc, term) k from m where contribution > 0)
 select doc_id, term, round(contribution, 6) contribution from r where k <= 5""")
def explained_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five terms that speak most for spam, of each document of the query set (ids divisible by 100)."""
    from millrace.plans.mining_queries import _nb

    s, counts, labels, _, _ = _nb(spark, d)
    weights = classification.word_ratios(counts, labels, "doc_id", "y").select("term", F.col("llr").alias("weight"))
    mine = counts.where("doc_id % 100 = 0").select("doc_id", "term", F.col("tf").alias("weight"))
    return classification.explain(mine, weights, "doc_id").withColumn("contribution", F.round("contribution", 6))


@query()
def scoring_service(spark: SparkSession, d: str) -> DataFrame:
    """Probability, label, campaign, terms and rules of every submission."""
    from millrace.plans.mining_queries import _nb

    _, counts, labels, _, _ = _nb(spark, d)
    weights = classification.word_ratios(counts, labels, "doc_id", "y").select("term", F.col("llr").alias("weight"))
    rows = materialize(_items(spark, d), "items")
    sets = association.frequent_itemsets(rows.select(F.col("id").alias("tx"), "items"), "items", 0.1)
    found = association.target_rules(association.rules(sets, 0.5), "honeypot=filled", ["honeypot=filled", "honeypot=empty"])
    c = contacts(spark, d).select("id", F.lower("template").alias("k"), "message")
    _, _, clusters, _ = campaigns(spark, d)
    mapped = modelling.campaign_of(c, "k", "message", clusters, clusters.select("k", "cluster").distinct())
    ids = c.select("id", "k").join(mapped.distinct(), "k", "left")
    return modelling.service(rows, materialize(weights, "weights"), 0.0, ids, materialize(found.select("antecedent", "consequent"), "rules"), F.col("items")).withColumn("terms", F.array_join("terms", " "))
