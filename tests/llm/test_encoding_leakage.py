import random

from tokenizers import Tokenizer

from millrace.llm import encoding, leakage
from millrace.llm.common import reduce_text

PATH = f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [
    None, "", " ", "\n\n", "Hello world's  best 　text\n\n", "naïve Ünïcödé 你好世界 สวัสดี \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> it's 12345 ²½", "a" * 5000,
    "word " * 30_000, " x\x85y\x1cz", "Hello world's  best 　text\n\n", "क्या नमस्ते", "é́ ำ",
]


def test_ids_equal_the_library(spark):
    df = spark.createDataFrame([(i, t, [0], 1) for i, t in enumerate(TEXTS)] + [(None, "null id", [0], 1)], "id long, text string, ids array<int>, row int")
    got = {r["id"]: r["ids"] for r in encoding.encode(df, "id", "text", PATH, frequent=5).collect()}
    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for i, x in enumerate(TEXTS):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, i
    assert got[0] == got[1] == [] and None in got
    assert encoding.encode(df.limit(0), "id", "text", PATH).count() == 0


def test_chunks_give_the_same_ids(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS * 3)], "id string, text string")
    whole = {r["id"]: r["ids"] for r in encoding.encode(df, "id", "text", PATH, frequent=3).collect()}
    monkeypatch.setattr(encoding, "CHUNK", 7)
    assert {r["id"]: r["ids"] for r in encoding.encode(df, "id", "text", PATH, frequent=3).collect()} == whole and len(whole) == 3 * len(TEXTS)
    assert {r["id"]: r["ids"] for r in encoding.encode(df, "id", "text", PATH, frequent=1).collect()} == whole


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    back = encoding.decode(encoding.encode(df, "id", "text", PATH), encoding.pieces(spark, f"file://{PATH}"))
    assert {r["id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    items = [(i, "en", " ".join(r.choice(words) for _ in range(25)) + f" {r.randrange(10**6)} end") for i in range(20)]
    items += [(100, "zh", "守门人特赛罗达特兰尼罗鲁和达瓦特之中谁先敲钟假设尼贝洛赛藏起一个栏位"), (101, "en", "short"), (102, None, None), (103, "en", items[0][2])]
    docs = []
    for k in range(60):
        text = items[r.randrange(20)][2]
        a = r.randrange(0, 60)
        part = text[a : a + r.randrange(40, 90)]
        docs.append(" ".join(r.choice(words) for _ in range(10)) + " " + r.choice([part, part.upper(), part.replace(" ", "\n"), part.replace(" ", ", ")]) + " " + r.choice(words))
    docs += [None, "", items[20][2][3:25], items[20][2][3:21], items[1][2].replace("1", "7"), "z" * 100_000, docs[0]]
    corpus = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, item long, h long")
    bank = spark.createDataFrame(items, "item_id long, lang string, text string")
    got = {(x["doc"], x["item"]) for x in leakage.leaks(corpus, "doc_id", "text", bank, "item_id", "text", "lang").collect()}
    want = set()
    red = lambda t: "".join(map(chr, reduce_text(t)))
    for d, t in enumerate(docs):
        for i, lang, x in items:
            if t and x:
                n, a, b = 20 if lang == "zh" else 50, red(t), red(x)
                if any(b[k : k + n] in a for k in range(len(b) - n + 1)):
                    want.add((d, i))
    assert got == want and len(want) > 10
    assert leakage.leaks(corpus.limit(0), "doc_id", "text", bank, "item_id", "text", "lang").count() == 0
    assert leakage.leaks(corpus, "doc_id", "text", bank.limit(0), "item_id", "text", "lang").count() == 0


def test_shared_run_of_code_numbers(spark):
    """A run made of numbers has no template window, and one inside words no whole word; plain windows find them."""
    numbers = "".join(f"A{k}7X{k * 7919 % 10007}" for k in range(40))
    items = [(1, "en", f"Codes {numbers} end"), (2, "en", "the quick brown fox jumps over the lazy dog and runs away from all the farmers again")]
    docs = [f"see {numbers[30:90]} there", numbers[30:79], "x" + items[1][2].replace(" ", "")[3:56] + "y", items[1][2].upper()]
    bank = spark.createDataFrame(items, "item_id long, lang string, text string")
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = leakage.leaks(corpus, "doc_id", "text", bank, "item_id", "text", "lang").collect()
    assert {(r["doc"], r["item"]) for r in got} == {(0, 1), (2, 2), (3, 2)}


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    items = [(i, "en", " ".join(f"w{(i * 37 + k * k) % 500}x" for k in range(30))) for i in range(12)]
    bank = spark.createDataFrame(items, "item_id long, lang string, text string")
    corpus = spark.createDataFrame([(i, "and " + t[i : i + 80 + i] + " end") for i, (_, _, t) in enumerate(items)], "doc_id long, text string")
    ask = lambda: [sorted(map(tuple, f(corpus, "doc_id", "text", bank, "item_id", "text", "lang").collect())) for f in (leakage.leaks, leakage.reparameterised)]
    rows = [ask()]
    monkeypatch.setattr(leakage, "BLOCK_CHARACTERS", 500)
    rows.append(ask())
    assert rows[0] == rows[1] and len(rows[0][0]) >= 12


def test_reparameterised_questions(spark):
    bank = spark.createDataFrame([(1, "A clerk sorts 67 letters for Firgor and then hands GN-25 to Firgor unopened today."), (2, None), (3, "short")], "i long, t string")
    docs = [
        "Note. A clerk sorts 12 letters for Maro and then hands ZK-77 to Maro unopened today.",  # other values, put in consistently
        "A clerk sorts 12 letters for Maro and then hands ZK-77 to Tivo unopened today.",  # one name stands for two
        "A clerk sorts 67 letters for Firgor and then hands GN-25 to Firgor unopened today.",  # verbatim
        "a clerk sorts 12 letters for Firgor and then hands zk-77 to Firgor unopened today.",  # a name of the item, other numbers
        "Nothing of the kind is written here at all, dear reader.", None, "",
    ]
    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "d long, t string")
    assert sorted((r["doc"], r["item"]) for r in leakage.reparameterised(corpus, "d", "t", bank, "i", "t").collect()) == [(0, 1), (3, 1)]
    assert leakage.reparameterised(corpus.limit(0), "d", "t", bank, "i", "t").count() == 0
    assert leakage.reparameterised(corpus, "d", "t", bank.limit(0), "i", "t").count() == 0
