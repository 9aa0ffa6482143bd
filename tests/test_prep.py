import datetime as dt

from millrace.operators import prep


def test_cleaning_keeps_first_and_unknown_labels(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, t, "Al", "Al", "Al", None, "a@b.org", "1", "s", "m", "x"), (2, t, "Al", "Al", "Al", None, "a@b.org", "1", "s", "m", "x"), (3, t, None, None, None, None, None, None, None, None, "y"),
        (4, None, "A", "B", None, " ", None, None, None, " hi ", "z"), (5, None, "A", "B", None, None, None, None, None, "hi", "z"), (6, t, None, None, None, "Q R", None, None, "only", None, None),
    ]
    got = {r["id"]: r for r in prep.clean(spark.createDataFrame(rows, prep.RAW)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["name"], got[1]["message"], got[1]["honeypot_filled"]) == ("Al", "s\nm", 1)
    assert (got[2]["name"], got[2]["source_block"], got[2]["honeypot_filled"]) == ("A B", "B_legacy", None)
    assert (got[3]["message"], got[3]["honeypot_filled"]) == ("only", 0)
    f = {r["id"]: r for r in prep.features(prep.clean(spark.createDataFrame(rows, prep.RAW))).collect()}
    assert f[1]["email_domain"] == "other" and f[2]["email_domain"] == "none" and f[2]["year"] is None and f[1]["has_message"] == 1


def test_window_and_evidence(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(days=i), int(i < 20 or i > 60)) for i in range(80)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, honeypot_filled int")
    w = prep.unrecorded_window(df)
    r = w.first()
    assert (r["rows"], r["days"], r["next_rows"]) == (41, 40, None)
    flags = {x["id"]: x["honeypot_reliable"] for x in prep.flag_reliable(df, w).collect()}
    assert flags[0] == 1 and flags[30] == 0 and flags[99] is None
    e = {x["part"]: (x["rows"], x["hits"]) for x in prep.label_evidence(df, w).collect()}
    assert e == {"before": (20, 20), "inside": (41, 0), "after": (19, 19)}


def test_leakage_gate(spark):
    pub = spark.createDataFrame([("hello anna lee there",), ("mail a@b.org",), ("clean",)], "text string")
    raw = spark.createDataFrame([("Anna  Lee", "zz"), (None, "nobody here")], "name string, phone string")
    assert {r["kind"]: r["hits"] for r in prep.leakage(pub, "text", raw, ["name", "phone"]).collect()} == {"value": 1, "email": 1, "phone": 0}
    w = spark.createDataFrame([("clean", 3.0)], "term string, weight double")
    scored = {r["text"]: r["label"] for r in prep.score_messages(pub, "text", "text", w, -1.0).collect()}
    assert scored["clean"] == "spam" and scored["hello anna lee there"] == "legitimate"
