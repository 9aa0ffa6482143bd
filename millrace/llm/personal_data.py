"""Problem 1: personal information inside free text, found by bootstrapped contextual extraction."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookalikes import _BLANK, _INVISIBLE, suspects
from millrace.operators.skew import LEAST_HOT, hot_aware_join
from millrace.session import materialize, release

FIELDS = ("subject", "message", "normalized_text")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-zÀ-ɏ]")
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}
#: Rounds of scoring on the graph of patterns and instances, the score from which an instance is accepted, and the weight, in
#: instances, of the next wider pattern.
ROUNDS, ACCEPT, SUPPORT = 4, 0.5, 8
#: What is sent to every task is bounded by shares: a given name stands before at least one NAMES-th of all pairs of names, a context
#: before one CONTEXTS-th of all names in texts, a frequent word is one WORDS-th of all words. So there are never more of them.
NAMES, CONTEXTS, WORDS = 200_000, 100_000, 150_000
#: A first name counts as given if it stands before this many different surnames in the forms' name fields.
SURNAMES = 3
#: Share of texts from which on a word is no surname.
FREQUENT = 2e-4

_EMAIL = re.compile(
    r"""(?<![\w.+'-])[\w.+'-]++\s{0,2}(?:@|[(\[{]\s{0,2}at\s{0,2}[)\]}])(?:\s{0,2}[\w-]+(?:(?:\.|\s{0,2}[(\[{]\s{0,2}(?:dot|punkt|punto|point|точка)\s{0,2}[)\]}]\s{0,2})[\w-]+)+"""
    r"""|(?<=\w@)[\w-]{4,})""", re.I)  # fmt: skip
_URL = re.compile(r"https?[:/]+[^\s<>\"\])]+|www\.[^\s<>\"\])]+", re.I)
_GAP = r"\s{0,3}[().\-/]{0,2}\s{0,3}"
_NUMBER = re.compile(
    r"(?<![\w@.,/:=$€£+-])(?:[A-Za-z]{2}\s{0,3}\d\d\s{0,3}\d\d\s{0,3}\d\d\s{0,3}[A-Da-d](?!\w)|[A-Za-z]\d[A-Za-z]\d{5,8}(?!\w)|[A-Za-z]{1,2}\d{6,10}(?!\w)"
    rf"|[(]?\+?[(]?\d(?:{_GAP}\d){{5,17}}(?:-?[A-Za-z](?!\w)|(?![\w]))(?:\s{{0,3}}ext\.?\s{{0,3}}\d{{1,5}})?)", re.I)  # fmt: skip
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_PAIR = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Words for kinds of streets. Numbers beside them make a street address.
STREETS = {
    "before": "street st road rd lane ln avenue ave drive dr boulevard blvd close gardens hill court ct square way terrace crescent place grove park row mews walk",
    "fr": "rue avenue place boulevard bd chemin impasse allée quai route cours square passage",
    "es": "calle avenida avda plaza paseo camino ronda carretera travesía c/ pza",
    "de": "straße strasse str weg gasse allee platz ring damm ufer steig stieg",
    "ru": "улица ул проспект пр-т пр просп переулок пер площадь пл шоссе ш бульвар б-р набережная наб вулиця вул провулок",
}
_alt = {k: "|".join(sorted(map(re.escape, v.split()), key=len, reverse=True)) for k, v in STREETS.items()}
_W = r"[^\W\d_][\w'’-]*"
_ADDRESS = re.compile(
    rf"(?:(?:flat|apt|unit|suite|apartment)\.?\s+\w{{1,5}}\s*[,;-]?\s+)?\b\d{{1,5}}[a-z]?\s+(?P<mid>(?:{_W}\s+){{1,2}}?)(?:{_alt['before']})\b(?!-\d)\.?(?:\s*[,;-]?\s*(?:apt|flat|unit|suite)\.?\s+\w{{1,5}})?(?:\s+in\s+{_W}|\s*[,;-]?\s+{_W}(?:\s*[,;-]?\s+(?:[a-z]{{1,2}}\d{{1,2}}\s+\d[a-z]{{2}}|\d{{4,6}}))?)?"
    rf"|\b\d{{1,5}}(?:\s+(?:bis|ter))?\s*,?\s+(?:{_alt['fr']})\s+(?:d[eu]s?\s+|la\s+|l['’])*{_W}(?:\s*[,;-]?\s+\d{{5}}\s+{_W})?"
    rf"|\b(?:{_alt['es']})\.?\s+(?:de\s+|la\s+|del\s+)*{_W}\s*[,;-]?\s*(?:n[.ºo°úm]*\s*)?\d{{1,5}}\b(?:\s*[,;-]?\s+\d{{1,2}}\s?[oºª.]\s?[a-z]?\b)?(?:\s*[,;-]?\s+\d{{5}}\s+{_W})?"
    rf"|\b[^\W\d_]{{3,}}(?:[\s-]?(?:{_alt['de']}))\b\.?\s+\d{{1,4}}[a-z]?\b(?:\s*[,;-]?\s+\d{{5}}\s+{_W})?"
    rf"|(?:\bг\.?\s*{_W}\s*[,;-]?\s+)?\b(?:{_alt['ru']})\b\.?\s*{_W}\s*[,;-]?\s*(?:д|дом|буд)?\b\.?\s*\d{{1,4}}[а-я]?\b(?:\s*[,;-]?\s*(?:кв|квартира)\.?\s*\d{{1,4}})?",
    re.I,
)

#: Cheap tests that let most texts skip the long patterns.
_STREET_WORDS = frozenset(w for k in ("before", "fr", "es", "ru") for w in STREETS[k].replace("/", " ").split())
_STREET_ENDS = tuple(STREETS["de"].split())
_MAYBE_NUMBER = re.compile(r"\d(?:[\s().\-/A-Za-z]{0,6}\d){5}")
_MAYBE_AT = re.compile(r"[(\[{]\s{0,2}at\s{0,2}[)\]}]", re.I)

#: Written forms of numbers that are personal on their face (national identity, passport, insurance and tax numbers).
ID_SHAPES = tuple(re.compile(p, re.I) for p in (
    r"[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d]", r"\d{3}-\d{2}-\d{4}", r"\d{1,2}\.\d{3}\.\d{3}-?[a-z]", r"\d{8}-?[a-z]", r"[a-z]{2}\d{6,7}", r"[a-z]\d[a-z\d]\d{6}",
    r"\d{2} \d{3} \d{3} \d{3}", r"\d{4} \d{4} \d{4}", r"\d{2} \d{2} \d{6}",
))
PHONE_SHAPES = tuple(re.compile(p, re.I) for p in (r"\(?\+\d[\d ().\-/]{7,}( ?ext\.? ?\d+)?", r"\(\d{3}\) ?\d{3}[- ]\d{4}", r"00[ -]?\d{2,3}[ -]\d[\d -]{6,}", r"0\d{2,4}/\d{5,}", r"\d{3}([.-])\d{3}\1\d{4}"))
#: Written forms that are no personal number: dates, network addresses, book numbers.
OTHER_SHAPES = tuple(re.compile(p) for p in (r"\d{4}-\d\d?-\d\d?", r"\d\d?[./]\d\d?[./]\d{4}", r"(\d{1,3}\.){3}\d{1,3}", r"97[89]([- ]?\d){7,10}"))


def fold(text: str) -> tuple[str, list[int] | None]:
    """``text`` with one form for each character and repaired look-alikes, and the place of each of its characters in the original."""
    if not _INVISIBLE.search(text) and (text.isascii() or (unicodedata.is_normalized("NFKC", text) and not _MIXED.search(text))):
        return text, None
    at: list[int] | None = None
    plain = text
    if _INVISIBLE.search(text):
        at = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        plain = "".join([text[i] for i in at])
        at.append(len(text))
    folded = unicodedata.normalize("NFKC", _BLANK.sub(" ", plain))
    if len(folded) != len(plain):
        # ligatures, composed accents and the like: go by units of a character and its marks
        out: list[str] = []
        places: list[int] = []
        for m in re.finditer("[\\s\\S][\u0300-\u036f\u3099\u309a]*", plain):
            unit = unicodedata.normalize("NFKC", _BLANK.sub(" ", m.group()))
            out.append(unit)
            places += [m.start() if at is None else at[m.start()]] * len(unit)
        folded, at = "".join(out), [*places, len(text)]
    if not _MIXED.search(folded):
        return folded, at
    swaps = dict(suspects(folded))
    if swaps:
        folded = re.sub(r"[^\W\d_]+", lambda m: r if len(r := swaps.get(m.group(), m.group())) == len(m.group()) else m.group(), folded)
    return folded, at


def own_parts(text: str, name: str | None, mail: str | None) -> list[tuple[int, int]]:
    """Spans of ``normalized_text`` that are the form's own name and e-mail."""
    reduce_ = lambda s: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s or "").lower())
    mine = {reduce_(name), reduce_(mail)} - {""}
    spans, parts, at = [], [], 0
    for p in re.split(r"(\s\|\s)", text):
        parts.append((p, at))
        at += len(p)
    parts = parts[::2]
    mails = [i for i, (p, _) in enumerate(parts) if _EMAIL.fullmatch(p.strip())]
    for i, (p, start) in enumerate(parts):
        short = len(p.split()) <= 3 and not re.search(r"[.!?:,;]\s", p.strip())
        beside = (i + 1 == mails[0] or (mails[0] == 0 and i == len(parts) - 1)) if mails else (i == 0 and len(parts) > 2)
        if reduce_(p) in mine or (i in mails[:1]) or (not name and short and beside and len(parts) > 1):
            spans.append((start, start + len(p)))
    return spans


class _Contexts:
    """The two words, and the word, before a place of a text; numbers count as one word."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words: list[str] | None = None

    def before(self, at: int) -> tuple[str, str]:
        if self.words is None:
            found = list(_WORDS.finditer(self.text))
            self.words = ["#" if m.group().isdigit() else m.group().lower() for m in found]
            self.ends = [m.end() for m in found]
        k = bisect_right(self.ends, at)
        return " ".join(self.words[max(0, k - 2) : k]), " ".join(self.words[max(0, k - 1) : k])


def shape_of(value: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", value)))


def form_of(kind: str, value: str) -> tuple[str, str]:
    """(written form, seed) of an e-mail or street address: what its notation is, and whether that shows its kind beyond doubt.

    An e-mail address does with a whole domain and no blanks around its sign, a street address with a second number (of a flat or place) or a place in front.
    """
    if kind == "email":
        plain = re.sub(r"\s*[(\[{]\s*\w{3,6}\s*[)\]}]\s*", ".", re.sub(r"\s*[(\[{]\s*at\s*[)\]}]\s*", "@", value, flags=re.I))
        form = re.sub(r"[\w+'-]+", "w", re.sub(r"\s+", "", plain))
        return form, kind if not re.search(r"\s", plain) and "." in plain.rpartition("@")[2] else ""
    low = value.lower()
    words = _WORDS.findall(low)
    street = next((w for w in words if w in _STREET_WORDS or w.endswith(_STREET_ENDS)), "")
    street = next((e for e in _STREET_ENDS if street.endswith(e)), street)
    return f"{'9' if low[:1].isdigit() else ''} {street}", kind if len(re.findall(r"\d+", low)) > 1 or re.match(r"г\b", low) else ""


def seed_of(value: str) -> str:
    v = re.sub(r"\s+", " ", value.strip())
    for kind, shapes in (("other", OTHER_SHAPES), ("id_number", ID_SHAPES), ("phone", PHONE_SHAPES)):
        if any(p.fullmatch(v) for p in shapes):
            return kind
    return ""


def direct_items(text: str, words: list[str], frequent: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of e-mail and street addresses, which show by themselves, and of web addresses (kind ``url``).

    ``words`` are those of ``text`` in lower case; ``frequent`` ones are no street names.
    """
    out = [("url", *m.span()) for m in _URL.finditer(text)] if "://" in text or "www." in text or "http" in text.lower() else []
    taken = [(a, b) for _, a, b in out]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    if "@" in text or _MAYBE_AT.search(text):
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            spaced = re.search(r"\s@|@\s", m.group())
            if free(a, b) and not (spaced and not re.search(r"\s@\s", m.group())):
                out.append(("email", a, b))
                taken.append((a, b))
    if not _STREET_WORDS.isdisjoint(words) or any(w.endswith(_STREET_ENDS) for w in words):
        for m in _ADDRESS.finditer(text):
            if free(*m.span()) and not any(w.lower() in frequent for w in (m["mid"] or "").split()):
                out.append(("address", *m.span()))
                taken.append(m.span())
    return out


def given_names(forms: DataFrame, name_col: str) -> DataFrame:
    """``w``: first words of form names that stand before at least SURNAMES different second words, and before one NAMES-th of all pairs."""
    words = F.split(F.lower(F.trim(F.regexp_replace(F.col(name_col), r"\s+", " "))), " ")
    pairs = forms.select(words.alias("w")).where("size(w) = 2").select(F.col("w")[0].alias("w"), F.col("w")[1].alias("s")).where(r"w rlike '^\\p{L}{2,}$' and s rlike '^\\p{L}{3,}$'").distinct()
    firsts = materialize(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "pii-firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    return firsts.where((F.col("n") >= SURNAMES) & (F.col("n") * NAMES >= total)).select("w")


def find(df: DataFrame, id_col: str, payload: str = "raw_payload", normalized: str = "normalized_text") -> DataFrame:
    """``id, field, kind, start, length`` of each personal item, in code points of the unchanged field (from 0).

    Seeds: given names of the forms' own name fields, and numbers whose written form or digits (the forms' phone fields) show
    their kind. The words around seeds are patterns; patterns and instances (contexts, written forms, given names) score each
    other for ROUNDS rounds in Spark, on counts of equal instances, and patterns that score high bring in instances never seen
    as seeds. E-mail and street addresses whose notation shows them beyond doubt are seeds too; others need a context or a
    notation that seeds have. Null and empty fields give nothing; a null payload leaves
    ``normalized_text``, of which the parts that repeat the form's name and e-mail are left out. Repeated ids give repeated rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(f"{payload}.name").alias("name"), F.col(f"{payload}.email").alias("email"), F.col(f"{payload}.subject").alias("subject"),
                     F.col(f"{payload}.message").alias("message"), F.col(normalized).alias("normalized_text"))
    names = frozenset(r["w"] for r in given_names(df.select(F.col(f"{payload}.name").alias("n")), "n").collect())
    texts = df.select(F.col(f"{payload}.subject").alias("a"), F.col(f"{payload}.message").alias("b"))
    b_names = spark.sparkContext.broadcast(names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # frequent words, and the contexts in which given names stand before another word
        words: Counter = Counter()
        contexts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            k = ["w"] * len(words) + ["c"] * len(contexts)
            out = pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([*words, *contexts], pa.string()), pa.array([*words.values(), *contexts.values()], pa.int64())], ["k", "v", "n"])
            words.clear()
            contexts.clear()
            return out

        known = b_names.value
        for batch in batches:
            for col in batch.columns:
                for t in col.to_pylist():
                    if not t:
                        continue
                    found = _PAIR.findall(t.lower())
                    words.update(set(found))
                    for i, w in enumerate(found[:-1]):
                        if w in known and i:
                            contexts[" ".join(found[max(0, i - 2) : i])] += 1
            if len(words) > 300_000:
                yield flush()
        yield flush()

    learned = materialize(texts.mapInArrow(learn, "k string, v string, n long"), "pii-words").groupBy("k", "v").agg(F.sum("n").alias("n"))
    learned = materialize(learned, "pii-counts")
    least = max(20, int(FREQUENT * rows.count()))
    totals = {r["k"]: r["n"] for r in learned.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    common = frozenset(r["v"] for r in learned.where(F.expr(f"k = 'w' and n >= {least}") & (F.col("n") * WORDS >= totals.get("w", 0))).collect()) - names
    contexts = frozenset(r["v"] for r in learned.where(F.expr("k = 'c' and n >= 3") & (F.col("n") * CONTEXTS >= totals.get("c", 0))).collect())
    b_common, b_contexts = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(contexts)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, frequent, places = b_names.value, b_common.value, b_contexts.value
        lasts = frozenset(c.rpartition(" ")[2] for c in places)
        for batch in batches:
            out: list[tuple] = []
            for i, name, mail, *fields in zip(*(c.to_pylist() for c in batch.columns)):
                for field, original in zip(FIELDS, fields):
                    if not original:
                        continue
                    text, at = fold(original)
                    blocked = own_parts(text, name, mail) if field == "normalized_text" else []
                    place = (lambda k: k) if at is None else at.__getitem__
                    inside = lambda a, b: any(a < y and b > x for x, y in blocked)  # noqa: E731, B023

                    def add(cls: str, a: int, b: int, l2: str = "", l1: str = "", form: str = "", seed: str = "") -> None:
                        out.append((i, field, cls, place(a), place(b) - place(a), l2, l1, form, seed))  # noqa: B023

                    taken = list(blocked)
                    context = _Contexts(text)
                    low = _PAIR.findall(text.lower())
                    for kind, a, b in direct_items(text, low, frequent):
                        if not inside(a, b):
                            taken.append((a, b))
                            if kind != "url":
                                add(kind, a, b, *context.before(a), *form_of(kind, text[a:b]))
                    for m in _NUMBER.finditer(text) if _MAYBE_NUMBER.search(text) else ():
                        a, b = m.span()
                        v = m.group()
                        digits = sum(c.isdigit() for c in v)
                        if digits < 6 or any(a < y and b > x for x, y in taken) or re.fullmatch(r"[A-Za-z]{2}-\d{3,6}", v):
                            continue
                        taken.append((a, b))
                        add("number", a, b, *context.before(a), shape_of(v), seed_of(v))
                    pairs = [k for k, w in enumerate(low[:-1]) if w in given or (k and low[k - 1] in lasts)]
                    if not pairs:
                        continue
                    found = [m.span() for m in _PAIR.finditer(text)]
                    if len(found) != len(low):
                        low = [text[a:b].lower() for a, b in found]
                        pairs = range(len(low) - 1)
                    for k in pairs:
                        w, s = low[k], low[k + 1]
                        if len(s) < 3 or s in frequent or not text[found[k][1] : found[k + 1][0]].isspace():
                            continue
                        l2 = " ".join(low[max(0, k - 2) : k])
                        seeded = w in given
                        if not seeded and (l2 not in places or w in frequent or len(w) < 3):
                            continue
                        a, b = found[k][0], found[k + 1][1]
                        if any(a < y and b > x for x, y in taken):
                            continue
                        add("name", a, b, l2, w, w, "name" if seeded else "")
            cols = list(zip(*out)) if out else [()] * 9
            kinds = [batch.column("id").type, pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "field", "cls", "start", "length", "l2", "l1", "form", "seed"])

    id_type = rows.schema["id"].dataType.simpleString()
    items = rows.mapInArrow(candidates, f"id {id_type}, field string, cls string, start int, length int, l2 string, l1 string, form string, seed string")
    items = materialize(items, "pii-items")
    keys = ["cls", "l2", "l1", "form", "seed"]
    equal = materialize(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "pii-equal")
    scored = materialize(score(equal).where("kind is not null").select(*keys, "n", "kind"), "pii-scored")
    release(equal)
    return hot_aware_join(items, scored, keys, "n", max(items.count(), 1)).select("id", "field", "kind", "start", "length")


def score(equal: DataFrame) -> DataFrame:
    """``kind`` (or null) of each class of equal instances, by ROUNDS rounds of scoring between instances and their patterns.

    Patterns are the two words before an instance, the word before it and its written form (of a name: its first word). A
    pattern's score for a kind is the share of that kind among the instances it holds, one more counted as of none. An instance
    gets the score of the two words before it, smoothed by that of the word before it, smoothed by that of its written form, each
    wider pattern counting as SUPPORT instances. A seed gets the share of its kind among the seeds of its context, what it shows by
    itself counting as SUPPORT seeds more, so that it loses its kind only where others are usual. A pair of words gets the higher score of the words before it and of its
    first word, which may become a given name that no form has shown.
    """
    kinds = tuple(PLACEHOLDERS)
    state = equal
    for k in kinds:
        state = state.withColumn(k, F.when(F.col("seed") == k, 1.0).otherwise(0.0))
    rows = max(equal.count(), 1)
    state = materialize(state, "pii-round")
    # which instances a pattern holds stays the same, so patterns with a burden of them are looked for once
    held = {c: state.groupBy("cls", c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for c in ("l2", "l1", "form")}
    for _ in range(ROUNDS):
        scores = state
        for column in ("l2", "l1", "form"):
            total = F.sum("n") + 1.0
            measures = [total.alias(f"{column}_n"), *[(F.sum(F.col(k) * F.col("n")) / total).alias(f"{column}_{k}") for k in kinds]]
            if column == "l2":
                measures += [F.sum(F.when(F.col("seed") != "", F.col("n")).otherwise(0)).alias("seeds"), *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).alias(f"seeds_{k}") for k in kinds]]
            pattern = state.groupBy("cls", column).agg(F.count(F.lit(1)).alias("_rows"), *measures)
            joined = hot_aware_join(scores, pattern, ["cls", column], "_rows", rows) if held[column] > LEAST_HOT else scores.join(pattern, ["cls", column])
            scores = joined.drop("_rows")
        for k in kinds:
            wide = (F.col("l1_n") * F.col(f"l1_{k}") + SUPPORT * F.col(f"form_{k}")) / (F.col("l1_n") + SUPPORT)
            near = (F.col("l2_n") * F.col(f"l2_{k}") + SUPPORT * wide) / (F.col("l2_n") + SUPPORT)
            name = F.greatest(F.col(f"l2_{k}"), F.col(f"form_{k}"))
            shown = (SUPPORT + F.col(f"seeds_{k}")) / (SUPPORT + F.col("seeds"))
            new = F.when((F.col("cls") == "name") & (F.col("seed") == k), 1.0).when(F.col("seed") == k, shown).when(F.col("seed") != "", 0.0).when(F.col("cls") == "name", name).otherwise(near)
            scores = scores.withColumn(f"new_{k}", new)
        old, state = state, materialize(scores.select(*equal.columns, *[F.col(f"new_{k}").alias(k) for k in kinds]), "pii-round")
        release(old)
    best = F.greatest(*[F.col(k) for k in kinds])
    kind = F.when(best < ACCEPT, None)
    for k in kinds:
        kind = kind.when(F.col(k) == best, k)
    return state.withColumn("kind", kind)


def mask(df: DataFrame, id_col: str, payload: str = "raw_payload", normalized: str = "normalized_text") -> DataFrame:
    """``id, field, text``: each non-null field with its personal items replaced by placeholders, all else unchanged; ids must be unique."""
    found = find(df, id_col, payload, normalized)
    spans = found.groupBy("id", "field").agg(F.sort_array(F.collect_set(F.struct("start", "length", "kind"))).alias("spans"))
    fields = F.explode(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(F.col(f"{payload}.subject"), F.col(f"{payload}.message"), F.col(normalized))))
    texts = df.select(F.col(id_col).alias("id"), fields.alias("field", "text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for s in spans_ or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], PLACEHOLDERS[s["kind"]]]
                        at = s["start"] + s["length"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("field"), pa.array(out, pa.string())], ["id", "field", "text"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.join(spans, ["id", "field"], "left").mapInArrow(run, f"id {id_type}, field string, text string")
