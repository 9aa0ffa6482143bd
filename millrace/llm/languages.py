"""Problem 2: missing, wrong and mixed languages of texts; scripts of clusters."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookalikes import fold_forms, suspects
from millrace.operators.skew import hot_aware_join
from millrace.session import materialize, release

#: The languages that are told apart, by the script they are written in.
LATIN, CYRILLIC = ("en", "de", "es", "fr", "pt"), ("ru", "uk")
LANGS = (*LATIN, *CYRILLIC, "zh", "ja", "ar", "hi", "th")
#: The labelled samples that are read at most (those of the smallest hash), the bound of a classifier fitted on a sample.
MAX_SAMPLES = 20_000
#: A word enters the model if it makes up at least one VOCABULARY-th of all words of settled records (each counted once a
#: record), of which there are VOCABULARY at most in any corpus, and if LEAST_RECORDS settled records hold it.
VOCABULARY, LEAST_RECORDS = 60_000, 20
#: Log-odds that a change of language between neighbouring segments must be worth.
CHANGE = 4.0
#: Known words, and log-odds over the text's main language, that a further language needs.
FURTHER_WORDS, FURTHER_ODDS = 3, 4.0
#: Weight, in records, of the next wider prior when a host's or suffix's own counts are smoothed.
SMOOTHING = 10.0
_PRIOR_CAP = math.log(50)

#: Common words of each language, counted as one more labelled sample each.
COMMON = {
    "en": "the a of and to in is you that it for on with as i this be at have from or your money free here need daily hello",
    "de": "der die das und ist nicht ich sie mit für auf den ein eine von zu wir geld arbeit ohne alle hier schnelles",
    "es": "el la los las de que y en un una por con no su para dinero gratis aquí rápido todos hola trabajo",
    "fr": "le la les de des et en un une pour avec ne pas que vous nous argent gratuit ici rapide tous bonjour travail",
    "pt": "o a os as de que e em um uma por com não para dinheiro grátis aqui rápido todos olá trabalho",
    "ru": "и в не на я что с по как это мы вы от за доход деньги работа для здесь заказ вопрос",
    "uk": "і в не на я що з по як це ми ви від за дохід гроші робота для тут замовлення запитання",
}
#: The most that one word speaks against a language.
LEAST = -2.5
_COMMON = {lang: set(COMMON.get(lang, "").split()) for lang in LANGS}

_URL = re.compile(r"(?:https?[:/]+|www\.)[!-~]+", re.I)
_MAIL = re.compile(r"(?<![!-~])[!-?A-~]+@[!-~]+")
_TAG = re.compile(r"<[^<>]{0,300}>|\[/?url[^\]]*\]", re.I)
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CYR = re.compile("[Ѐ-ԯ]")
_LAT = re.compile("[A-Za-zÀ-ɏ]")
_SEGMENT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？｡।؟])|[\r\n]+|\s\|\s")
#: Addresses written out to hide them.
_AT = re.compile(r"[\[({]\s{0,2}at\s{0,2}[\])}]", re.I)
_HIDDEN = re.compile(r"(?<![\w.+'-])[\w.+'-]++\s{0,2}[\[({]\s{0,2}at\s{0,2}[\])}]\s{0,2}[\w-]+(?:\s{0,2}(?:\.|[\[({]\s{0,2}\w{3,6}\s{0,2}[\])}])\s{0,2}[\w-]+)*", re.I)
_NOISE = re.compile("[<\\[({@]|http|www[.]", re.I)
#: Letters of scripts other than Latin that the model knows.
_OTHER = re.compile("[Ѐ-ԯ؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-鿿ｦ-ﾟ]")
_UNIQUE = (("ja", re.compile("[぀-ヿｦ-ﾟ]")), ("ar", re.compile("[؀-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")))
_HAN = re.compile("[㐀-鿿]")
_UK, _RU = re.compile("[іїєґІЇЄҐ]"), re.compile("[ыэъёЫЭЪЁ]")

class Model(NamedTuple):
    """Log-odds of words by language: of LATIN, and of CYRILLIC."""

    latin: dict[str, tuple[float, ...]]
    cyrillic: dict[str, tuple[float, ...]]


def clean(text: str, swaps: dict[str, str] | None = None) -> str:
    """Character forms folded, look-alike letters of mixed tokens replaced, and addresses and markup blanked.

    ``swaps``: the replacements, if ``text`` is a part of a larger one by which they are told.
    """
    if not text.isascii():
        text = fold_forms(text)
        if _MIXED.search(text):
            swaps = dict(suspects(text)) if swaps is None else swaps
            text = _WORD.sub(lambda m: swaps.get(m.group(), m.group()), text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if "http" in text or "www." in text or "HTTP" in text or "Http" in text:
        text = _URL.sub(" ", text)
    if _AT.search(text):
        text = _HIDDEN.sub(" ", text)
    return _MAIL.sub(" ", text) if "@" in text else text


def words_of(segment: str) -> list[str]:
    low = segment.lower()
    return _WORD.findall(low.replace("’", "'") if "’" in low else low)


def segments_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, cleaned) of each segment of ``text`` that isn't blank: a sentence, a line or a part of a form."""
    swaps: dict[str, str] | None = {}
    if not text.isascii() and _MIXED.search(folded := fold_forms(text)):
        swaps = dict(suspects(folded))
    plain = text.isascii() and not _NOISE.search(text)
    at = 0
    for m in _SEGMENT.finditer(text):
        if m.start() > at and not (part := text[at : m.start()]).isspace():
            yield at, m.start(), part if plain else clean(part, swaps)
        at = m.end()
    if at < len(text) and not (part := text[at:]).isspace():
        yield at, len(text), part if plain else clean(part, swaps)


def weights(counts: dict[str, Counter], least: int) -> Model:
    """Log-odds of each word for each language of its script against the average of them; words of fewer than ``least`` are left out."""
    model = Model({}, {})
    for family, known in zip((LATIN, CYRILLIC), model):
        totals = [sum(counts.get(lang, Counter()).values()) + 1.0 for lang in family]
        vocabulary: Counter = Counter()
        for lang in family:
            vocabulary.update(counts.get(lang, Counter()))
        size = len(vocabulary) + 1.0
        for w, n in vocabulary.items():
            if n < least:
                continue
            p = [(counts.get(lang, Counter()).get(w, 0) + 0.02) / (t + 0.02 * size) for lang, t in zip(family, totals)]
            mean = sum(p) / len(p)
            # a word never seen in a language speaks against it within bounds; a common word of a language never does
            known[w] = tuple(max(math.log(x / mean), 0.0 if w in _COMMON[lang] else LEAST) for lang, x in zip(family, p))
    return model


def evidence(segment: str, model: Model) -> tuple[list[float], int]:
    """Log-likelihood of each language, and the number of words (or characters of a script of its own) it rests on."""
    if segment.isascii() or not _OTHER.search(segment):
        return _latin(segment, model)
    found = {lang: len(p.findall(segment)) for lang, p in _UNIQUE}
    kana, han = found["ja"], len(_HAN.findall(segment))
    cyr, lat = len(_CYR.findall(segment)), len(_LAT.findall(segment))
    others = max(found["ar"], found["hi"], found["th"])
    if others and others >= max(lat, cyr, kana, han) * 0.5:
        best = max(("ar", "hi", "th"), key=found.__getitem__)
        return [0.0 if lang == best else -3.0 * min(others, 20) for lang in LANGS], others
    if (kana + han) * 2.5 >= max(lat, cyr) and kana + han:
        ja = 2.0 * kana - 0.3 * han
        n = kana + han
        return [(0.0 if ja <= 0 else -min(ja, 40.0)) if lang == "zh" else (0.0 if ja > 0 else max(ja, -40.0)) if lang == "ja" else -3.0 * min(n, 20) for lang in LANGS], n
    if cyr <= lat:
        return _latin(segment, model)
    words = words_of(segment)
    known = [v for v in map(model.cyrillic.get, words) if v]
    ru, uk = map(sum, zip(*known)) if known else (0.0, 0.0)
    d = 1.5 * (len(_RU.findall(segment)) - len(_UK.findall(segment)))
    n = max(len(known), min(len(words), 3))
    return [ru + d if lang == "ru" else uk if lang == "uk" else -2.0 * min(cyr, 20) for lang in LANGS], n


def _latin(segment: str, model: Model) -> tuple[list[float], int]:
    known = [v for v in map(model.latin.get, words_of(segment)) if v]
    if not known:
        return [0.0] * len(LANGS), 0
    return [*map(sum, zip(*known)), *[-2.0 * len(known)] * (len(LANGS) - len(LATIN))], len(known)


def label_segments(found: list[tuple[list[float], int]], prior: list[float]) -> list[int]:
    """The most likely language of each segment when a change costs CHANGE (Viterbi)."""
    score = [p + e for p, e in zip(prior, found[0][0])]
    back = []
    for ev, _ in found[1:]:
        best = max(range(len(score)), key=score.__getitem__)
        jump = score[best] - CHANGE
        step = [k if s >= jump else best for k, s in enumerate(score)]
        score = [max(s, jump) + e for s, e in zip(score, ev)]
        back.append(step)
    at = max(range(len(score)), key=score.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def _confidence(ev: list[float], prior: list[float], at: int) -> float:
    shifted = [e + p for e, p in zip(ev, prior)]
    top = max(shifted)
    return math.exp(shifted[at] - top) / sum(math.exp(x - top) for x in shifted)


def languages_of(text: str, model: Model, prior: list[float]) -> tuple[list[tuple[str, float, int]], list[tuple[int, int, str, float]]]:
    """The languages and the stretches of ``text``.

    Languages: (language, confidence, letters) of each that at least one whole segment is in, largest first. Stretches: (start,
    length, language, confidence) of each run of segments of one language, in code points of ``text`` from 0; they cover the
    text but for blanks around them, segments without words going with the stretch before them.
    """
    found: list[list] = []
    for a, b, part in segments_of(text):
        ev, n = evidence(part, model)
        if n or not found:
            found.append([a, b, ev, n, len(part)])
        else:
            found[-1][1] = b
    if len(found) > 1 and not found[0][3]:
        found[1][0] = found[0][0]
        del found[0]
    if not found or not found[0][3]:
        return [], []
    whole = [sum(x) + p for x, p in zip(zip(*(ev for _, _, ev, _, _ in found)), prior)]
    main = whole.index(max(whole))
    # whatever other languages could gain over all segments and the prior is less than a change costs: there is none
    gain = sum(max(ev) - ev[main] for _, _, ev, _, _ in found) + max(prior) - prior[main]
    path = [main] * len(found) if gain < CHANGE else label_segments([(ev, n) for _, _, ev, n, _ in found], prior)
    runs: list[list] = []
    for (a, b, ev, n, size), at in zip(found, path):
        if runs and runs[-1][0] == at:
            runs[-1][2:] = [b, [x + y for x, y in zip(runs[-1][3], ev)], runs[-1][4] + n, runs[-1][5] + size]
        else:
            runs.append([at, a, b, ev, n, size])
    stretches = []
    total: dict[int, list] = {}
    for at, a, b, ev, n, size in runs:
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        stretches.append((a, len(part.strip()), LANGS[at], _confidence(ev, prior, at)))
        t = total.setdefault(at, [[0.0] * len(LANGS), 0, 0, []])
        t[:3] = [[x + y for x, y in zip(t[0], ev)], t[1] + n, t[2] + size]
        t[3].append((ev, n))
    order = sorted(total, key=lambda k: (-total[k][1], k))
    main = order[0]
    languages = []
    for at in order:
        ev, n, size, parts = total[at]
        if at == main or any(m >= FURTHER_WORDS and e[at] - e[main] >= FURTHER_ODDS for e, m in parts):
            languages.append((LANGS[at], _confidence(ev, prior, at), size))
    return languages, stretches


def base_model(samples: DataFrame, lang_col: str, text_col: str) -> Model:
    """The word model of at most MAX_SAMPLES labelled samples; words of a single sample are left out."""
    counts: dict[str, Counter] = {lang: Counter() for lang in LANGS}
    bounded = samples.select(F.lower(lang_col).alias("l"), F.col(text_col).alias("t")).dropna().orderBy(F.xxhash64("l", "t"), "t").limit(MAX_SAMPLES)
    for r in bounded.collect():
        if r["l"] in counts:
            counts[r["l"]].update(set(words_of(clean(r["t"]))))
    for lang, words in COMMON.items():
        counts[lang].update(dict.fromkeys(words.split(), 2))
    return weights(counts, 2)


def primary_subtag(label):
    """A declared label without case and region; null for blank and undetermined ones."""
    low = F.lower(F.regexp_extract(label, r"^[\s_-]*(\p{L}+)", 1))
    return F.when(~low.isin("", "und", "unknown", "none", "null", "mul", "zxx"), low)


_LANGUAGES = "array<struct<label:string,confidence:double,letters:int>>"
_STRETCHES = "array<struct<start:int,length:int,label:string,confidence:double>>"


def detect(records: DataFrame, samples: DataFrame, lang_col: str = "lang", sample_text: str = "text") -> DataFrame:
    """``tab, id, languages, stretches`` of ``records`` (``tab, id, text, declared, host, suffix``).

    ``languages``: array of (label, confidence, letters); ``stretches``: array of (start, length, label, confidence), the runs
    of sentences of one language, in code points of the unchanged text from 1.

    Evidence is fused as log-probabilities. Text: words of each script's languages, first counted in the labelled ``samples``,
    then over all records that these settle beyond doubt (words with a share of at least one VOCABULARY-th), and letters of a
    script. Priors, by grouped aggregation over the settled records: the declared language, the suffix of the address and the
    host, each smoothed by the next wider group (host by suffix, suffix by all). They settle short texts; long ones settle
    themselves. Texts without words, null and blank ones get empty arrays; null hosts, suffixes and labels form groups.
    """
    spark = records.sparkSession
    first = spark.sparkContext.broadcast(base_model(samples, lang_col, sample_text))
    rows = records.select("tab", F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("declared", F.lit("")).alias("declared"),
                          F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    rows = materialize(rows, "language-texts")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = first.value
        counts: Counter = Counter()
        keys: Counter = Counter()
        for batch in batches:
            for text, declared, host, suffix in zip(*(batch.column(k).to_pylist() for k in ("text", "declared", "host", "suffix"))):
                parts = [part for _, _, part in segments_of(text)]
                segments = [evidence(s, model) for s in parts]
                n = sum(k for _, k in segments)
                if n < 4:
                    continue
                tops = {e.index(max(e)) for e, k in segments if k >= 2}
                ev = [sum(x) for x in zip(*(e for e, _ in segments))]
                ranked = sorted(ev, reverse=True)
                if len(tops) != 1 or ranked[0] - ranked[1] < 5:
                    continue
                lang = LANGS[ev.index(ranked[0])]
                keys[(declared, host, suffix, lang)] += 1
                if lang in LATIN or lang in CYRILLIC:
                    counts.update((w, lang) for w in {w for part in parts for w in words_of(part)})
            if len(counts) + len(keys) > 400_000:
                yield _flush(counts, keys)
        yield _flush(counts, keys)

    settled = materialize(rows.mapInArrow(settle, "kind string, word string, host string, suffix string, lang string, n long"), "settled")
    words = settled.where("kind = 'w'").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    per_word = materialize(words.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all") >= LEAST_RECORDS), "words")
    everything = settled.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    learned: dict[str, Counter] = {lang: Counter() for lang in LANGS}
    for r in per_word.where(F.col("all") * VOCABULARY >= everything).collect():  # VOCABULARY rows at most
        for x in r["by"]:
            learned[x["lang"]][r["word"]] += x["n"]
    more = weights(learned, LEAST_RECORDS)
    second = spark.sparkContext.broadcast(Model(*(a | b for a, b in zip(first.value, more))))

    facts = settled.where("kind = 'k'").select(F.col("word").alias("declared"), "host", "suffix", "lang", "n")
    overall = {r["lang"]: r["n"] for r in facts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    whole = sum(overall.values()) or 1
    base = [(overall.get(lang, 0) + 1.0) / (whole + len(LANGS)) for lang in LANGS]
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("double") for lang in LANGS]
    base_col, base_log = F.array(*map(F.lit, base)), F.array(*[F.lit(math.log(b)) for b in base])

    def smoothed(counts: str, n: str, wider: Column | str) -> Column:
        return F.zip_with(counts, wider, lambda c, p: (c + SMOOTHING * p) / (F.col(n) + SMOOTHING))

    # few distinct groups beside the records; all of this stays in tables
    suffixes = facts.groupBy("suffix").agg(F.array(*by_lang).alias("s"), F.sum("n").alias("sn")).select("suffix", smoothed("s", "sn", base_col).alias("s"))
    hosts = facts.groupBy("host", "suffix").agg(F.array(*by_lang).alias("h"), F.sum("n").alias("hn")).join(suffixes, "suffix").select("host", "suffix", smoothed("h", "hn", F.col("s")).alias("h"))
    labels = facts.groupBy("declared").agg(F.array(*by_lang).alias("d"), F.sum("n").alias("dn")).select("declared", smoothed("d", "dn", base_col).alias("d"))
    groups = materialize(rows.groupBy("declared", "host", "suffix").agg(F.count(F.lit(1)).alias("n")), "language-groups")
    known = groups.join(hosts, ["host", "suffix"], "left").join(labels, "declared", "left")
    # independent evidence given the language: product of the two, divided by the overall share once
    log = lambda c: F.coalesce(F.transform(c, lambda x: F.log(x)), base_log)
    prior = F.zip_with(F.zip_with(log("d"), log("h"), lambda x, y: x + y), base_log, lambda x, y: x - y)
    known = materialize(known.select("declared", "host", "suffix", "n", prior.alias("prior")), "language-priors")
    total = known.agg(F.sum("n")).first()[0] or 0
    release(settled, per_word, groups)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())])),
                 pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))]
        model = second.value
        for batch in batches:
            languages, stretches = [], []
            for text, prior_ in zip(batch.column("text").to_pylist(), batch.column("prior").to_pylist()):
                top = max(prior_)
                found, runs = languages_of(text, model, [max(p - top, -_PRIOR_CAP) for p in prior_])
                languages.append([dict(zip(("label", "confidence", "letters"), x)) for x in found])
                stretches.append([dict(zip(("start", "length", "label", "confidence"), (a + 1, *x))) for a, *x in runs])
            yield pa.RecordBatch.from_arrays([batch.column("tab"), batch.column("id"), pa.array(languages, kinds[0]), pa.array(stretches, kinds[1])], ["tab", "id", "languages", "stretches"])

    joined = hot_aware_join(rows, known, ["declared", "host", "suffix"], "n", total)
    return joined.select("tab", "id", "text", "prior").mapInArrow(label, f"tab string, id long, languages {_LANGUAGES}, stretches {_STRETCHES}")


def _flush(counts: Counter, keys: Counter) -> pa.RecordBatch:
    kinds = ["w"] * len(counts) + ["k"] * len(keys)
    word = [w for w, _ in counts] + [d for d, _, _, _ in keys]
    host = [None] * len(counts) + [h for _, h, _, _ in keys]
    suffix = [None] * len(counts) + [s for _, _, s, _ in keys]
    lang = [x for _, x in counts] + [x for _, _, _, x in keys]
    n = [*counts.values(), *keys.values()]
    counts.clear()
    keys.clear()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, word, host, suffix, lang)] + [pa.array(n, pa.int64())], ["kind", "word", "host", "suffix", "lang", "n"])


def pattern_script(pattern):
    """cyrillic, latin, other or none by the letters of a pattern outside ``<...>`` tokens; null for null."""
    letters = F.regexp_replace(F.regexp_replace(pattern, r"<[^<>]*>", ""), r"[^\p{L}]+", "")
    n = F.char_length(letters)
    cyrillic = n - F.char_length(F.regexp_replace(letters, r"[\x{400}-\x{4FF}]+", ""))
    latin = n - F.char_length(F.regexp_replace(letters, "[A-Za-z]+", ""))
    return F.when(n == 0, "none").when(cyrillic * 2 > n, "cyrillic").when(latin * 2 > n, "latin").when(n > 0, "other")


def cluster_scripts(clusters: DataFrame, signatures: DataFrame) -> DataFrame:
    """``id, main_script, script`` of each cluster with a known signature: the script of most of its signatures.

    Ties go to latin, cyrillic, other, none in this order. Ids without a signature and null patterns don't count; repeated
    ids in a cluster count once.
    """
    scripts = signatures.select(F.col("id").alias("sid"), pattern_script(F.col("pattern")).alias("script")).dropna()
    members = clusters.select("id", F.explode(F.array_distinct("signature_ids")).alias("sid"))
    votes = members.join(scripts, "sid").groupBy("id", "script").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, ("latin", "cyrillic", "other", "none"))), F.col("script"))
    best = votes.groupBy("id").agg(F.max_by("script", F.struct("n", -rank)).alias("script"))
    return clusters.select("id", "main_script").join(best, "id")
