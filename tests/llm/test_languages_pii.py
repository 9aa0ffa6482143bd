import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import languages as lg
from millrace.llm import personal_data as pd_

SAMPLES = {
    "en": ["the house is in the old town and we like it", "we would like to see the house in the town", "is it the old one or the new one in town"],
    "de": ["das haus steht in der alten stadt und wir mögen es", "wir möchten das haus in der stadt sehen", "ist es das alte oder das neue in der stadt"],
    "es": ["la casa está en la ciudad vieja y nos gusta", "queremos ver la casa en la ciudad", "es la vieja o la nueva de la ciudad"],
    "ru": ["дом стоит в старом городе и нам он нравится", "мы хотим увидеть дом в городе"], "uk": ["будинок стоїть у старому місті і він нам подобається", "ми хочемо побачити будинок у місті"],
    "zh": ["房子在老城里，我们很喜欢它。"], "ja": ["その家は古い町にあります。"], "ar": ["البيت في المدينة القديمة"], "hi": ["घर पुराने शहर में है"], "th": ["บ้านอยู่ในเมืองเก่า"],
}


def test_languages(spark):
    samples = spark.createDataFrame([(k, t) for k, ts in SAMPLES.items() for t in ts], "lang string, text string")
    texts = [t for ts in SAMPLES.values() for t in ts]
    want = [[k] for k, ts in SAMPLES.items() for _ in ts]
    texts += [None, "", "123 !!", "We like the old house in the town.\n\nWir möchten das alte haus in der stadt sehen.", "the " * 50_000, "we like thе old tоwn and the house"]
    want += [[], [], [], ["de", "en"], ["en"], ["en"]]
    rows = [("t", i, t, "fr" if i % 2 else None, "h" if i % 3 else None, None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tab string, id long, text string, declared string, host string, suffix string, languages int")
    rows = lg.detect(df, samples).collect()
    got = {r["id"]: r["languages"] for r in rows}
    mixed = next(r for r in rows if r["id"] == len(texts) - 3)
    assert [(texts[-3][x["start"] - 1 : x["start"] - 1 + x["length"]], x["label"]) for x in mixed["stretches"]] == list(zip(texts[-3].split("\n\n"), ["en", "de"]))
    assert all((r["stretches"] == []) == (r["languages"] == []) for r in rows) and all(0 < x["confidence"] <= 1 for r in rows for x in r["stretches"])
    assert [sorted(x["label"] for x in got[i]) for i in range(len(texts))] == want
    assert all(0 < x["confidence"] <= 1 for v in got.values() for x in v)
    assert lg.detect(df.limit(0), samples).count() == 0


def test_small_gains_add_up_to_a_change_of_language():
    """Five short segments, each of little evidence, are a stretch of their own; the shortcut never differs from the path search."""
    model = lg.Model({"x": (0.0, 1.9, -2.0, -2.0, -2.0), "y": (1.5, 0.0, -2.0, -2.0, -2.0)}, {})
    text = "y y y y y y y y. " + "x. " * 5 + "y y y y y y."
    languages, stretches = lg.languages_of(text, model, [0.0] * len(lg.LANGS))
    assert [k for k, _, _ in languages] == ["en", "de"] and [x[2] for x in stretches] == ["en", "de", "en"]
    assert text[stretches[1][0] :][: stretches[1][1]] == "x. x. x. x. x."
    r = random.Random(2)
    for _ in range(3000):
        prior = [-r.random() * lg._PRIOR_CAP * r.choice([0, 1]) for _ in lg.LANGS]
        prior = [p - max(prior) for p in prior]
        found = [([r.gauss(0, r.choice([0.1, 1, 2])) for _ in lg.LANGS], 1) for _ in range(r.randrange(1, 6))]
        whole = [sum(x) + p for x, p in zip(zip(*(e for e, _ in found)), prior)]
        main = whole.index(max(whole))
        if sum(max(e) - e[main] for e, _ in found) + max(prior) - prior[main] < lg.CHANGE:
            assert lg.label_segments(found, prior) == [main] * len(found)


def test_labels_and_scripts(spark):
    df = spark.createDataFrame([("en-GB",), ("ZH_tw",), (" ",), ("und",), (None,)], "l string")
    assert [r["x"] for r in df.select(lg.primary_subtag(F.col("l")).alias("x")).collect()] == ["en", "zh", None, None, None]
    s = spark.createDataFrame([(1, "<NAME> привет"), (2, "hello"), (3, "你好"), (4, "<NUM>"), (5, None)], "id long, pattern string")
    c = spark.createDataFrame([(1, [1, 2, 2], "x"), (2, [3, 4, 4, 9], None), (3, None, None), (4, [5], None)], "id int, signature_ids array<long>, main_script string")
    assert {r["id"]: r["script"] for r in lg.cluster_scripts(c, s).collect()} == {1: "latin", 2: "other"}


NAMES = ["Anna Lee", "Anna Moss", "Anna Park", "Bert Lee", "Bert Hill", "Bert Stone"]


def forms(spark, messages, normalized=None):
    payload = "struct<name:string,email:string,subject:string,message:string>"
    rows = [(i, (NAMES[i % 6], f"u{i}@mail.example", None, m), normalized or (f"{NAMES[i % 6]} | u{i}@mail.example | {m}" if m else None), 1) for i, m in enumerate(messages)]
    rows += [(9000, None, None, 1), (9001, (None, None, "", ""), "", 1)]
    return spark.createDataFrame(rows, f"id long, raw_payload {payload}, normalized_text string, kind int")


def test_personal_items_and_unseen_names(spark):
    filler = ["My name is Anna Zorbik and more.", "My name is Bert Qualm and more.", "My name is Anna Vexil and more.", "My name is Bert Xandor and more."] * 6 + ["we sold 12 red chairs in spring"] * 40
    special = [
        "Write to joe.doe+x@site.example now", "mail joe (at) site (dot) example please", "Call me on +1 212 555 0100 today", "Call me on 020 7946 0012 today", "Call me on 212-555-0199 today",
        "Our tracking number is 8374659201 as sent", "Passport QQ 12 34 56 C was issued", "We live at 12 Marlo Street, Tovik, 12345.", "Wir wohnen in der Talweg 8, 12345 Ort.", "My name is Zelda Morrit and more.",
        "Order KF-92610 and version 2.10.3 of 340 days", "Follow @someone for news", "x" * 50_000,
    ]
    df = forms(spark, filler + ["Call me on +1 212 555 0101 today"] * 12 + special)
    at = len(filler) + 12
    got = {}
    for r in pd_.find(df, "id").where("field = 'message'").collect():
        got.setdefault(r["id"] - at, set()).add(r["kind"])
    want = [{"email"}, {"email"}, {"phone"}, {"phone"}, {"phone"}, None, {"id_number"}, {"address"}, {"address"}, {"name"}, None, None, None]
    assert [got.get(i) for i in range(len(special))] == want
    kinds = {r["kind"] for r in pd_.find(df, "id").where(f"field = 'normalized_text' and id = {at + 10}").collect()}
    assert not kinds  # the form's own name and e-mail don't count
    masked = {(r["id"] - at, r["field"]): r["text"] for r in pd_.mask(df, "id").collect()}
    assert masked[0, "message"] == "Write to <EMAIL> now" and masked[2, "message"] == "Call me on <PHONE> today" and masked[10, "message"] == special[10]
    assert pd_.find(df.limit(0), "id").count() == 0


@pytest.mark.parametrize(("text", "want"), [("plain", "plain"), ("cａll", "call"), ("a​b", "ab"), ("café", "café")])
def test_fold_keeps_places(text, want):
    folded, at = pd_.fold(text)
    assert folded == want and (at is None or len(at) == len(folded) + 1)
