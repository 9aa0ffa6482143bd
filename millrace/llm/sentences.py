"""Problem 10: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles and connecting abbreviations of each language, after which no sentence ends (written without their last period).
NEVER_FINAL = {
    "en": "mr mrs ms dr prof sgt lt gen col capt rev hon messrs approx cf vs viz e.g i.e",
    "de": "hr fr dr prof fa bzgl inkl exkl ca vgl evtl ggf bzw sog zzgl abzgl geb z.b d.h u.a u",
    "es": "sr sra srta sres dr dra prof aprox ud uds p.ej ej",
    "fr": "m mm mme mmes mlle dr prof env cf p.ex",
    "pt": "sr sra srta dr dra prof profa aprox ex p.ex",
    "ru": "ул пл д стр см прим им просп пер тов ср обл т.е т.к",
    "uk": "вул пл буд див прибл ім просп пров обл т.з",
    "ar": "د أ م",
    "hi": "डॉ श्री प्रो",
    "th": "ดร นพ ผศ รศ",
}
#: Abbreviations after which a sentence ends only if the next word is one that begins sentences.
SELDOM_FINAL = {
    "en": "st dept est co",
    "de": "str tel co",
    "es": "av avda tel",
    "fr": "av bd tél",
    "pt": "av r tel",
    "ru": "гр тел",
    "uk": "гр тел",
}
#: Abbreviations after which no sentence ends if a number follows.
BEFORE_NUMBER = {
    "en": "no nos fig figs vol p pp sec ch eq jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr abs kap bd s art abb tab jan feb mär apr jun jul aug sep sept okt nov dez",
    "es": "n núm núms pág págs cap art vol fig tel",
    "fr": "n no p pp art chap vol fig tél",
    "pt": "n nº núm pág págs cap art vol fig tel",
    "ru": "стр с г гл рис п ст кв д к т",
    "uk": "с ст гл рис п р кв д к т",
}
#: English abbreviations that are words too, and count only with a capital.
CAPITAL_BEFORE_NUMBER = {"art", "ex"}
#: Words by which the language of a stretch is told.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with from is are was were be been i you he she it we they this that these my your his her its our their not no do does did have has had will would can could as if when there what who how please yet",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren ich du er sie es wir ihr mein dein sein unser mit von zu zum zur im in am an auf für bei nach aus wie was wer wenn dann als auch noch nur bitte hat wird kann um",
    "es": "el la los las un una y o pero de del al a en con por para no es son era fue yo tú él ella nosotros ellos usted su sus mi que como cuando si ya muy más este esta hay ha ser está",
    "fr": "le la les l un une des du de et ou mais à au aux en dans sur avec pour par ne pas est sont était je tu il elle nous vous ils elles ce cette ces mon ma mes son sa ses notre votre que qui quand si comme très plus a depuis",
    "pt": "o a os as um uma e ou mas de do da dos das em no na nos nas com por para não é são era foi eu tu ele ela nós eles você seu sua meu minha que como quando se já muito mais este esta há tem está",
    "ru": "и в не на я что с по как это мы вы он она они от до за из к у о но а или для здесь был была есть так уже если когда мне нас вас его ее их",
    "uk": "і в не на я що з по як це ми ви він вона вони від за із до у та але або для тут був була є так вже якщо коли мені нас вас його її їх й",
}
#: Words that begin a sentence where a name could stand too.
STARTERS = {
    "en": "the a an he she it we they i you this that these those but and if when then there what who how my your his her our their please in on at next",
    "de": "er sie es wir ihr ich du das die der aber und wenn dann dies diese bitte",
    "es": "él ella nosotros ellos usted yo y pero este esta esto eso hay si cuando no ya",
    "fr": "il elle nous vous ils elles je tu on ce cette c mais et si quand puis",
    "pt": "ele ela nós eles você eu mas e este esta isso há se quando não já",
    "ru": "он она они мы вы я но и это если когда так",
    "uk": "він вона вони ми ви я але і це якщо коли так",
}
#: English words behind which a single letter is a kind, not an initial.
KINDS = set("vitamin vitamins plan hepatitis group class type grade section point option team exhibit appendix figure table part".split())
#: German words before a day or rank number, and months, beside which a number with period is an ordinal.
ORDINAL_BEFORE = set("am der die das dem den des vom zum im bis ab seit jeder jeden jedem beim ein einen".split())
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Languages whose abbreviations are told apart by the words around; those of other scripts cannot be mistaken for them.
_BY_WORDS = tuple(FUNCTION_WORDS)
_LANGS_OF: dict[str, list[str]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _LANGS_OF.setdefault(_w, []).append(_lang)
_ABBREVIATIONS = {"al"} | CAPITAL_BEFORE_NUMBER | {w for t in (NEVER_FINAL, SELDOM_FINAL, BEFORE_NUMBER) for ws in t.values() for w in ws.split()}

_TERMINATORS = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]+")
_CANDIDATES = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]+|(?<=[฀-๿])\s[\s>]*(?=[฀-๿])")
_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\u0085  ])[^\S\r\n\u0085  ]*(?:>[> \t]*)?(?:(?:\r\n|[\n\r\u0085  ])[^\S\r\n\u0085  ]*(?:>[> \t]*)?)*(?=\r\n|[\n\r\u0085  ]|\Z)")
_LEAD = regex.compile(r"(?:\s|(?:(?<=[\n\r\u0085  ])|(?<=^))>[>\s]*)*")
_GAP = regex.compile(r"(?:\s|(?<=[\n\r\u0085  ])>[>\s]*)*")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:\.[\p{L}\p{M}\p{N}]+)*\Z")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_INITIAL = regex.compile(r"\p{Lu}\.")
_LETTER_BEFORE = regex.compile(r"(?<!\p{L})\p{L}\.\s?\Z")
_NUMBER_AT_LINE_START = regex.compile(r"(?:^|[\n\r\u0085  ])[\s>]*\d{1,3}\Z")
_QUOTE = regex.compile(r"""[()\[\]{}（）「」『』【】《》〈〉“”„«»‹›"‟]|(?<=[\s(\[>:]|^)'(?=\S)|(?<=\S)'(?=[\s.,;:!?)\]]|\Z)""")
_PAIRS = dict(zip("([{（「『【《〈“«‹", ")]}）」』】》〉”»›"))
_CLOSERS = {v: k for k, v in _PAIRS.items()}
#: Symbols with an end mark of their own still belong to the sentence before.
_SYMBOL_END = regex.compile(r"[\p{So}\p{Sk}][\p{So}\p{Sk}\p{Cf}\p{M}]*[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]")
_WIDE = set("。！？｡．")
_JA_GOES_ON = set("とっはがをにのもで、")


def _spans(text: str) -> list[tuple[int, int]]:
    """(open, close) of the quotations and brackets of a paragraph, by place of opening; marks without a partner are ignored.

    Spans are nested or apart, never crossing.
    """
    stack: list[tuple[str, int]] = []
    standing: Counter = Counter()
    out = []

    def open_(kind: str, at: int) -> None:
        stack.append((kind, at))
        standing[kind] += 1

    def close(kinds: str, at: int) -> bool:
        if not any(standing[k] for k in kinds):
            return False
        while stack:
            kind, start = stack.pop()
            standing[kind] -= 1
            if kind in kinds:
                out.append((start, at))
                return True
        return False

    for m in _QUOTE.finditer(text):
        c, i = m.group(), m.start()
        if c in "\"'":
            if not close(c, i) and (i == 0 or not text[i - 1].isalnum()):
                open_(c, i)
        elif c == "„":
            open_(c, i)
        elif c in "“‟":
            if not close("„", i):
                open_("“", i)
        elif c == "”":
            close("“„", i)
        elif c in "»›":
            if not close("«‹", i):
                open_("»", i)
        elif c in "«‹":
            if not close("»", i):
                open_(c, i)
        elif c in _PAIRS:
            open_(c, i)
        else:
            close(_CLOSERS[c], i)
    return sorted(out)


@lru_cache(maxsize=256)
def _words(table: str, langs: tuple[str, ...]) -> frozenset[str]:
    """The words of a table for some languages; where the table has further scripts, those too."""
    tables = {"never": NEVER_FINAL, "seldom": SELDOM_FINAL, "number": BEFORE_NUMBER, "start": STARTERS}
    return frozenset(w for lang, ws in tables[table].items() if lang in langs or lang not in _BY_WORDS for w in ws.split())


def _languages(part: str, least: int = 2) -> tuple[str, ...]:
    """The language that most function words of ``part`` are of, or those that tie; none if there are fewer than ``least``."""
    votes = Counter(lang for w in _WORD.findall(part.lower()) for lang in _LANGS_OF.get(w, ()))
    most = max(votes.values(), default=0)
    return tuple(sorted(k for k, n in votes.items() if n == most)) if most >= least else ()


class _Around:
    """The language around a place of a text: that of its sentence, else of its paragraph, else of the text, else the text's label, else any."""

    def __init__(self, text: str, label: str) -> None:
        self.text, self.label = text, label
        self.whole: tuple[str, ...] | None = None
        self.of: tuple[int, tuple[str, ...]] = (-1, ())

    def at(self, paragraph: str, lo: int, start: int, end: int) -> tuple[str, ...]:
        near = _languages(paragraph[max(start, end - 300) : end + 160])
        if near:
            return near
        if self.of[0] != lo:
            self.of = (lo, _languages(paragraph))
        if self.of[1]:
            return self.of[1]
        if self.whole is None:
            self.whole = _languages(self.text) or ((self.label,) if self.label in _BY_WORDS else _languages(self.text, 1) or _BY_WORDS)
        return self.whole


def _abbreviated(before: str, after: str, language: Callable[[], tuple[str, ...]]) -> bool:
    """Whether the period between ``before`` and ``after`` marks an abbreviation or number of the language around rather than the end of a sentence."""
    m = _WORD_BEFORE.search(before[-40:])
    if not m:
        return False
    word = m.group()
    low = word.lower()
    last = low.rpartition(".")[2]
    found = _WORD.match(after)
    next_word = found.group() if found else ""
    digit_next = after[:1].isdecimal()
    if word.isdecimal():
        if _NUMBER_AT_LINE_START.search(before[-12:] if len(before) > 12 else before):
            return True
        if len(word) <= 2:
            previous = regex.search(r"(\p{L}+)\s+\Z", before[-40:][: m.start()])
            return next_word.lower() in MONTHS or bool(previous and previous.group(1).lower() in ORDINAL_BEFORE)
        return False
    if len(word) > 1 and low not in _ABBREVIATIONS and last not in _ABBREVIATIONS:
        return False
    langs = language()
    if low in _words("never", langs):
        return True
    if low == "al":
        return bool(regex.search(r"\bet\s+al\Z", before, regex.I)) and next_word.lower() not in _words("start", langs)
    if digit_next:
        return low in _words("number", langs) or last in _words("number", langs) or (low in CAPITAL_BEFORE_NUMBER and "en" in langs and word[0].isupper()) or low in _words("seldom", langs)
    begins = next_word.lower() in _words("start", langs)
    if low in _words("seldom", langs):
        return not begins
    if len(word) != 1 or not word.isalpha() or "\u3040" <= word <= "\u9fff":
        return False
    if word in "гр" and regex.search(r"\d\s*\Z", before[:-1][-8:]):
        return False
    if _INITIAL.match(after) or not (word.isupper() or word.islower()):
        return True
    # an initial, or the last letter of a spaced abbreviation, stands before a name
    previous = regex.search(r"(\p{L}+)\s+\Z", before[-40:][: m.start()])
    if begins or (previous and previous.group(1).lower() in KINDS):
        return False
    return word.isupper() or bool(_LETTER_BEFORE.search(before[-40:][: m.start()]))


def split(text: str, label: str = "") -> list[tuple[int, int]]:
    """(start, length) of each sentence, in code points from 0. ``label``: the text's language, if its words don't tell."""
    out: list[tuple[int, int]] = []
    around = _Around(text, label)
    at = 0
    for m in _BLANK_LINE.finditer(text):
        if m.start() >= at:
            _paragraph(text, at, m.start(), around, out)
            at = m.end()
    _paragraph(text, at, len(text), around, out)
    return out


def _add(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    part = text[start:end].rstrip()
    while part.endswith(">") and "\n" in part and not part[part.rfind("\n") + 1 :].strip("> \t"):
        part = part[: part.rfind("\n")].rstrip()
    if part.strip("> \t\r\n"):
        out.append((start, len(part)))


def _paragraph(text: str, lo: int, hi: int, language: _Around, out: list[tuple[int, int]]) -> None:
    p = text[lo:hi]
    start = _LEAD.match(p).end()
    spans = _spans(p)
    # the spans around the current place, the innermost last
    around: list[tuple[int, int]] = []
    following = 0
    for m in _CANDIDATES.finditer(p, start):
        i, end = m.start(), m.end()
        while following < len(spans) and spans[following][0] < i:
            while around and around[-1][1] < spans[following][0]:
                around.pop()
            around.append(spans[following])
            following += 1
        while around and around[-1][1] < i:
            around.pop()
        if i < start:
            continue
        run = m.group()
        if run[0].isspace():
            # Thai: a blank between two Thai characters ends a sentence
            if not around:
                _add(text, lo + start, lo + i, out)
                start = end
            continue
        closed_from, depth = None, len(around)
        while depth and ((c := around[depth - 1][1]) == end or (c == end + 1 and p[end].isspace() and p[c] in "»›")):
            closed_from, end = around[depth - 1][0], c + 1
            depth -= 1
        if depth or end >= len(p):
            continue
        nxt = p[end]
        wide = run[-1] in _WIDE
        if _TERMINATORS.match(nxt):
            continue
        if not nxt.isspace() and not wide and not (run[-1] in "।॥؟۔" and nxt.isalpha()):
            continue
        after = _GAP.match(p, end).end()
        if after >= len(p):
            continue
        if _SYMBOL_END.match(p, after):
            continue
        # what the next sentence would begin with
        k = after
        while k < len(p) and (p[k] in _PAIRS or p[k] in "\"'„‚‘”»"):
            k += 1
        c = p[k] if k < len(p) else ""
        at_start = closed_from is not None and closed_from <= start
        if c.islower():
            continue
        if p[after] in "—–-" and regex.match(r"[—–-]+\s*\p{Ll}", p[after : after + 6]):
            continue
        if closed_from is not None:
            cased = c.isupper() or c.istitle() or c in "¿¡"
            if c.isdecimal() and not wide and not at_start and p[closed_from] not in "([{":
                continue
            if not cased and not c.isdecimal() and at_start and p[closed_from] not in "([{（":
                continue
            if c in _JA_GOES_ON and not p[end].isspace():
                continue
            if nxt in "，、,;；:：":
                continue
        if set(run) <= {".", "…"} and run != ".":
            # an ellipsis ends a sentence only before a capital, a number or an opening mark
            if not (c.isupper() or c.istitle() or c.isdecimal() or c in "¿¡"):
                continue
        elif run == "." and closed_from is None and _abbreviated(p[max(0, i - 60) : i], p[k : k + 30], lambda: language.at(p, lo, start, i)):  # noqa: B023
            continue
        _add(text, lo + start, lo + end, out)
        start = after
    _add(text, lo + start, hi, out)


def sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """``id, sent_start, sent_len`` of every sentence of every text: 1-based start and length in code points.

    Boundaries follow the Unicode sentence-break properties (terminators of all scripts, closing marks, letter case of what
    follows), with the abbreviations of the language around suppressed and quotations and brackets kept inside their sentence.
    The language is told by the function words of the sentence, else of the paragraph, else of the text; ``lang_col`` serves
    where they tell nothing. A blank line ends a unit. Null, empty and blank texts have no row; each text is handled on its
    own, whatever its length, in time that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, sizes = [], [], []
            for t, label in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                found = split(t, label) if t else []
                n.append(len(found))
                starts += [a + 1 for a, _ in found]
                sizes += [b for _, b in found]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["id", "sent_start", "sent_len"])

    label = F.lower(F.regexp_extract(F.coalesce(lang_col, F.lit("")), r"^\s*(\p{L}+)", 1)) if lang_col else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), label.alias("l")).where("t is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sent_start long, sent_len long")
