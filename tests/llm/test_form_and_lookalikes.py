import random
import re
import unicodedata
from collections import defaultdict

from millrace.llm import form_duplicates, lookalikes


def reduced(s):
    return "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LMN")


def test_form_duplicates_equal_brute_force(spark):
    r = random.Random(1)
    base = [" | ".join(r.sample(["Anna Lee", "a@b.org", "Hello, World!", "ÜBER uns", "x"], 3)) for _ in range(40)]
    texts = [r.choice([t, t.upper(), t.replace(" ", "  "), " | ".join(reversed(t.split(" | "))), t + "!"]) for t in base for _ in range(3)]
    texts += [None, "", "***", " | ", "same"] + ["hot | copy"] * 60 + ["y" * 200_000, "Y" * 200_000]
    rows = [("t", i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tab string, id long, text string, k1 long")  # an extra column with a name used inside
    got = {(x["id"], x["rep_id"], x["copies"]) for x in form_duplicates.collapse(df, "tab", "id", "text").collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None:
            groups[tuple(sorted(filter(None, map(reduced, t.split("|")))))].append(i)
    assert got == {(i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert form_duplicates.collapse(df.limit(0), "tab", "id", "text").count() == 0
    again = spark.createDataFrame([("t", 5, "a | b"), ("t", 5, "B|A"), ("t", 7, "c"), ("t", 7, "d"), ("t", 9, "D")], "tab string, id long, text string")
    assert sorted((x["id"], x["rep_id"], x["copies"]) for x in form_duplicates.collapse(again, "tab", "id", "text").collect()) == [(5, 5, 2), (5, 5, 2), (7, 7, 2), (9, 7, 2)]


def skeleton(t):
    t = unicodedata.normalize("NFKD", lookalikes._INVISIBLE.sub("", lookalikes._BLANK.sub(" ", t)))
    return "".join(lookalikes.TO["L"].get(c, c) for c in t)


def test_look_alikes_equal_a_skeleton(spark):
    clean = ["please pay the price for a sauce", "привет это проверка сообщения", "Café au lait", "fine print", "", "one  two", "one two", "ONE TWO"]
    swapped = ["рlеase pay the рriсe for а sauсе", "пpивет этo прoверка сooбщения", "Café au lait", "ﬁne pr​int", "ｐlease pay the price for a sauce", "\U0001d429lease pay the price for a sauce"]
    texts = clean + swapped + clean[:2] + [None, "x" * 100_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, r1 int")
    got = {(r["rep_id"], r["id"]) for r in lookalikes.look_alikes(df, "id", "text").where("id <> rep_id").collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None:
            groups[skeleton(t)].append(i)
    want = {(min(g), i) for g in groups.values() if len({texts[i] for i in g}) > 1 for i in g if i != min(g)}
    assert got == want
    assert lookalikes.look_alikes(df.limit(0), "id", "text").count() == 0


def test_repair_needs_the_corpus(spark):
    # the look-alike spelling of a word that nothing in the corpus spells otherwise stays as it is
    df = spark.createDataFrame([(1, "zyхab"), (2, "hello wоrld"), (3, "hello world")], "id long, text string")
    out = {r["id"]: r["text"] for r in lookalikes.unify(df, "id", "text").collect()}
    assert out == {1: "zyхab", 2: "hello world", 3: "hello world"}
    assert re.search("х", out[1])
