import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import evaluation, ingest, modelling, prep, reduction, rules, skew

PAYLOAD = "struct<name:string,email:string,subject:string,message:string,phone:string,website_url:string,company_code:string,security_token:string>"


def arrivals(spark):
    """One row for each kind of attack a form meets."""
    ok = ("Ann", "a@b.org", "s", "hello there", None, None, None, "t")
    rows = [
        (1, ok, "Mozilla", "http://x", 9000, {"x-forwarded-for": " 10.0.0.1, 10.0.0.2"}),
        (2, (*ok[:5], "http://spam", "c", None), "python-requests", None, 100, {"cf-connecting-ip": "nonsense", "x-real-ip": "2001:db8::1"}),
        (3, ("", "bad", "s", "x' OR 1=1; <script>", None, None, None, "t"), "curl/8", "", 1500, {}),
        (4, ("Ann", "a@b.org", "s", "z" * 20_000, None, "0", "", "t"), None, "r", None, None),
        (5, None, None, None, None, {"x-forwarded-for": "999.1.1.1"}),
        (6, ("Ann", "a@b.org", "s", "buy " * 10, None, None, None, "t"), "m", "r", 3000, {"x-forwarded-for": "::1"}),
    ]
    return spark.createDataFrame(rows, f"id long, raw_payload {PAYLOAD}, user_agent string, referer string, client_render_time int, request_headers map<string,string>")


def test_arrival(spark):
    df = arrivals(spark)
    got = {r["id"]: r["reason"] for r in ingest.accepted(df).collect()}
    assert got == {1: None, 2: None, 3: "missing name", 4: "too large", 5: "no payload", 6: None}
    hits = {r["id"]: r["h"] for r in df.select("id", ingest.trap_hits().alias("h")).collect()}
    assert hits[1] == [] and hits[2] == ["website_url", "company_code", "security_token_missing"] and hits[4] == []
    f = {r["id"]: r for r in df.select("id", *[v.alias(k) for k, v in ingest.flags().items()]).collect()}
    assert f[2]["bot_user_agent"] and f[2]["extremely_rapid"] and f[2]["no_referer"] and f[2]["honeypot_triggered"]
    assert f[3]["rapid_submission"] and not f[3]["extremely_rapid"] and f[3]["invalid_email"] and set(f[3]["suspicious_pattern_message"]) == {"sql_injection", "xss", "command_injection"}
    assert f[4]["repetitive_content"] and f[6]["repetitive_content"] and not f[1]["repetitive_content"]
    ips = {r["id"]: r["ip"] for r in df.select("id", ingest.client_ip(F.col("request_headers")).alias("ip")).collect()}
    assert ips == {1: "10.0.0.1", 2: "2001:db8::1", 3: "0.0.0.0", 4: "0.0.0.0", 5: "0.0.0.0", 6: "::1"}
    scored = {r["id"]: (r["error"], r["score"]) for r in ingest.score_batch(df, [r for r in rules.catalogue() if r.kind in ("rapid_submit", "pattern_match")]).collect()}
    assert scored[5] == ("no payload", None) and scored[1] == (None, 0) and scored[3][1] >= 100
    assert ingest.trimmed(df).where("id = 1").first()["raw_payload"]["name"] == "Ann"


def test_search_spine_and_columns(spark):
    a = spark.createDataFrame([(1, ["ab_c", "abc"]), (2, []), (3, None)], "id int, v array<string>")
    assert [r[0] for r in a.orderBy("id").select(ingest.json_search(F.col("v"), "abc")).collect()] == ["$[1]", None, None]
    t = dt.datetime(2024, 1, 1, 5, 30)
    s = spark.createDataFrame([(t,), (t + dt.timedelta(hours=2),), (None,)], "ts timestamp")
    assert [r["n"] for r in ingest.spine(s, "ts", "hour", {"n": F.count(F.lit(1))}).orderBy("at").collect()] == [1, 0, 1]
    assert ingest.spine(s.limit(0), "ts", "hour", {"n": F.count(F.lit(1))}).count() == 0
    x, y = spark.range(3).toDF("a"), spark.range(10, 15).toDF("b")
    assert sorted((r["a"], r["b"]) for r in ingest.concat_columns(x, y, "a", "b").collect() if r["a"] is not None) == [(0, 10), (1, 11), (2, 12)]
    assert ingest.histogram(s.select(F.lit(0.3).alias("x")), F.col("x"), 0.5).first()["density"] == 2.0


def test_gate_finds_long_values_beside_punctuation(spark):
    pub = spark.createDataFrame([("He said: anna lee, of 12 Long Green Street, Old Town!",), ("annalee of 12 long",), (None,), ("clean",)], "t string")
    raw = spark.createDataFrame([("Anna Lee", "12 long green street old town"), ("Bert", None)], "name string, place string")
    assert {r["kind"]: r["hits"] for r in prep.leakage(pub, "t", raw, ["place"]).collect()}["value"] == 1
    assert {r["kind"]: r["hits"] for r in prep.leakage(pub, "t", raw, ["name"]).collect()}["value"] == 1
    assert {r["kind"]: r["hits"] for r in prep.leakage(pub.limit(0), "t", raw, ["name"]).collect()}["value"] == 0


def test_folds_keep_groups_and_labels(spark):
    rows = [(i, f"g{i % 40}", int(i % 40 < 10)) for i in range(2000)] + [(5000 + i, None, 1) for i in range(20)]
    df = evaluation.grouped_stratified_folds(spark.createDataFrame(rows, "id long, g string, y int"), "g", "y")
    assert df.where("g is not null").groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    per = df.where("g is not null").groupBy("fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 5 and all(r["p"] == 100 and r["n"] == 400 for r in per)


def test_matrix_and_models(spark):
    rows = [(i, "Ann Lee", "a@gmail.com" if i % 2 else None, "71234567890", f"buy bitcoin http://x.y {i}" if i % 2 else "hello there", i % 2) for i in range(60)] + [(99, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "id long, name string, email string, phone string, message string, label int")
    m, names = prep.model_matrix(df, ("id", "label"))
    assert len(names) == 45 and m.where("isnull(msg_len)").count() == 0
    flags = {r["column_name"]: r["binary"] for r in prep.binary_columns(m, names).collect()}
    assert flags["has_email"] and flags["script_latin"] and not flags["msg_len"]
    x = modelling.vectors(m, names)
    r = {r["model"]: r["balanced_accuracy"] for r in modelling.held_out(modelling.candidates(), x, x).collect()}
    assert r["logistic regression"] == r["decision tree"] == 1.0


def test_lsa_spans_the_singular_directions(spark):
    rng = np.random.default_rng(3)
    a = rng.random((30, 4)) @ rng.random((4, 12))
    w = spark.createDataFrame([(i, f"t{j:02}", float(a[i, j])) for i in range(30) for j in range(12)], "k int, term string, weight double")
    got = {r["k"]: np.array(r["lsa"]) for r in reduction.lsa(w, "k", 4).collect()}
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :4] * s[:4]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.array([got[i] for i in range(30)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-6)
    assert reduction.lsa(w.limit(0), "k", 4).count() == 0


def test_left_join_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else ("hot" if i % 3 else f"k{i}"), 1) for i in range(3000)], "id long, k string, v int")
    look = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9999", 3)], "k string, w int")
    for least in (0, 100_000):  # joined by broadcast, by shuffle
        got = skew.hot_aware_left_join(rows, look, ["k"], least=least)
        assert got.count() == 3000 and got.where("w = 1").count() == rows.where("k = 'hot'").count() and got.where("w = 2").count() == 1
        assert got.where("k is null and w is null").count() == rows.where("k is null").count()


def test_quantiles_of_keys_across_ranges(spark):
    rows = [(f"k{i % 3}" if i % 5 else None, (i * 7919) % 1000 if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long")
    for share in (1, 1000):  # all keys cold, all keys hot
        got = {(r["k"], r["prob"]): r["value"] for r in skew.exact_quantiles(df, "k", "v", [0.0, 0.25, 0.5, 1.0], share=share).collect()}
        for k in ("k0", "k1", "k2"):
            v = sorted(x for y, x in rows if y == k and x is not None)
            for p in (0.0, 0.25, 0.5, 1.0):
                assert got[k, p] == v[max(1, -int(-(p * len(v)) // 1)) - 1]
