import pytest

from millrace.llm.sentences import sentences, split

CASES = [
    "Dr. Smith paid 3.5 dollars on Jan. 14.|It was e.g. from the U.K. and the U.S.|Fine!",
    '"Do not pay them. It is a trap," wrote Ann.|He left.',
    '"Really?" asked the clerk.|Nobody moved...|And so on.',
    "She typed \"Stop!\" 48 times, yet he posted.|(See also vol. 9, p. 9, of the notes.)|Names such as Foo! or Bar? confuse it.",
    "Am 9. März kam Nr. 4 an.|Der Wert stieg z. B. von 2,5 auf 7.25 Punkte.|Gut.",
    "«Не платите. Это ловушка», — написал хозяин.|И. П. Иванов живёт в д. 69 на пл. Мира с 2019 г. и не жалуется.",
    "« Vraiment ? » demanda le gardien.|M. Petit habite au n. 28 de la rue Haute depuis 2019.|Bien.",
    'What did he mean by "hello"? 🙂!|Next one.',
    "Je ne sais pas qui il est.|Elle non plus.|Nous avons fini en av.|Il est tard.",
    "So do I.|He left.|Take vitamin C.|It helps.|I love art.|5 people came.|See Art. 5 of it.",
    "Written by J. R. R. Tolkien and Smith et al. in 1954.|It is from the U.S.|5 people came.",
    "Die Fa. Meier u. Co. in der Langen Str. 138 hat geschlossen.|Der Zug fährt nach z. B. Ulm.",
    "¿Hay clases?|¡¿Quién abrió?!|El Sr. Paz vive en la Avda. Larga núm. 89.",
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    parts = case.split("|")
    text = " ".join(parts)
    assert [text[a : a + n] for a, n in split(text)] == parts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("店员问：“谁在看？”请问价格？“别付钱。这是骗局。”店主写道。", ["店员问：“谁在看？”", "请问价格？", "“别付钱。这是骗局。”店主写道。"]),
        ("店員は「これですか？」と聞きました。本当ですか！？", ["店員は「これですか？」と聞きました。", "本当ですか！？"]),
        ('"सच?" पहरेदार ने पूछा। ठीक है।', ['"सच?" पहरेदार ने पूछा।', "ठीक है।"]),
        ("سأل د. سمير: «من يقرأ هذا؟» انتظرنا... لكن لم يجب.", ["سأل د. سمير: «من يقرأ هذا؟»", "انتظرنا... لكن لم يجب."]),
        ("ดร.สมตรวจ 101 ฉบับ ทำไมไม่ตอบ", ["ดร.สมตรวจ 101 ฉบับ", "ทำไมไม่ตอบ"]),
        ("Dear team,\r\n\r\n> One two\n> three.\n>> Four!\n\n1. First item.\n2. Second item.", ["Dear team,", "One two\n> three.", "Four!", "1. First item.", "2. Second item."]),
        ("", []), ("  \n \n", []), (">\n> >\n", []), ("no end", ["no end"]),
    ],
)
def test_scripts_and_units(text, want):
    assert [text[a : a + n] for a, n in split(text)] == want


def test_language_of_the_place_decides():
    """A foreign passage keeps its own abbreviations, and a label serves where no word tells the language."""
    text = "Ремонт был на ул. Мира.\n\nLa Dra. Paz revisó aprox. 34 mensajes el 3 de marzo.\n\nMme. Petit habite au n. 28 de la rue depuis 2019."
    assert [text[a : a + n] for a, n in split(text)] == text.split("\n\n")
    assert len(split("Gr. Tel. Hr. Maier", "de")) < len(split("Gr. Tel. Hr. Maier", "en"))


@pytest.mark.parametrize("unit", ['He said "no. yes" and left. ', '"a." b ', "(a. B ", ") a. B "])
def test_time_grows_with_length(unit):
    import time

    began = time.time()
    split(unit * (200_000 // len(unit)))
    assert time.time() - began < 10


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hi. \U0001f600 Go on. Bye", 5), (2, None, 5), (3, "", 5), (4, "x. Y " * 20_000, 5), (1, "Hi.", 5)], "id long, text string, sent_len int")
    got = sentences(df, "id", "text").collect()
    assert [(r["sent_start"], r["sent_len"]) for r in got if r["id"] == 1][:1] == [(1, 3)] and {r["id"] for r in got} == {1, 4}
    assert sentences(df.limit(0), "id", "text").count() == 0
