"""Problem 7: texts that look the same but differ in their characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import digest, hot_aware_join, members_of_groups
from millrace.session import materialize

#: Letters drawn alike, in Latin, Cyrillic and Greek ("-": that script has none).
ALIKE = """
aа- cс- eе- iі- jј- oоο pрρ sѕ- xх- yу- hһ- dԁ- qԛ- wԝ- lӏ- v-ν
AАΑ BВΒ CС- EЕΕ HНΗ IІΙ JЈ- KКΚ MМΜ OОΟ PРΡ SЅ- TТΤ XХΧ YУΥ Z-Ζ QԚ- WԜ- N-Ν
""".split()
SCRIPTS = "LCG"
#: Letter -> its forms in the other scripts, by target script.
TO: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
for _row in ALIKE:
    for _i, _target in enumerate(SCRIPTS):
        for _letter in _row:
            if _row[_i] != "-" and _letter != "-" and _letter != _row[_i]:
                TO[_target].setdefault(_letter, _row[_i])
_AMBIGUOUS = {s: {x for r in ALIKE if r[i] != "-" and sum(c != "-" and c != r[i] for c in r) for x in r[i]} for i, s in enumerate(SCRIPTS)}

_LATIN, _CYRILLIC, _GREEK = "A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff", "\u0400-\u052f", "\u0370-\u03ff\u1f00-\u1fff"
_MARK = "\u0300-\u036f"
_TOKEN = re.compile(f"[{_LATIN}{_CYRILLIC}{_GREEK}][{_LATIN}{_CYRILLIC}{_GREEK}{_MARK}]*")
_HAS = {"L": re.compile(f"[{_LATIN}]"), "C": re.compile(f"[{_CYRILLIC}]"), "G": re.compile(f"[{_GREEK}]")}
#: Characters that show nothing: format characters, fillers, variation selectors and controls other than tab and line ends.
_INVISIBLE = re.compile(
    "[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e"
    "\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]"
)
_BLANK = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")


def script_of(letter: str) -> str | None:
    return next((s for s, p in _HAS.items() if p.match(letter)), None)


def fold_forms(text: str) -> str:
    """Width and style forms, ligatures, accents, blanks and invisible characters brought to one form; letters are kept."""
    if text.isascii() and not _INVISIBLE.search(text):
        return text
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", _BLANK.sub(" ", text)))


def _votes(letters: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in letters:
        s = script_of(c)
        if s and c not in _AMBIGUOUS[s]:
            out[s] = out.get(s, 0) + 1
    return out


def suspects(text: str) -> list[tuple[str, str]]:
    """(token, candidate) for tokens of folded ``text`` that mix scripts, or are drawn alike in the script of the rest of the text.

    The script of a token is the one of most letters that no other script has; if it has none, that of the whole text, then
    Latin, Cyrillic, Greek. A candidate replaces the letters of other scripts; without a look-alike for each there is none.
    """
    present = [s for s in SCRIPTS if _HAS[s].search(text)]
    if len(present) < 2:
        return []
    decomposed = unicodedata.normalize("NFD", text)
    whole: dict[str, int] | None = None
    out: dict[str, str] = {}
    for m in _TOKEN.finditer(decomposed):
        token = m.group()
        mine = {s for s in present if _HAS[s].search(token)}
        if len(mine) == 1 and not all(c in _AMBIGUOUS[next(iter(mine))] or _MARK[0] <= c <= _MARK[2] for c in token):
            continue
        if whole is None:
            whole = _votes(decomposed)
        votes = _votes(token)
        order = sorted(SCRIPTS, key=lambda s: (-votes.get(s, 0), -whole.get(s, 0), SCRIPTS.index(s)))
        if len(mine) == 1:
            order = order[:1]
        for target in order:
            changed = "".join(c if script_of(c) in (None, target) else TO[target].get(c, "\0") for c in token)
            if "\0" not in changed:
                if changed != token:
                    out[unicodedata.normalize("NFC", token)] = unicodedata.normalize("NFC", changed)
                break
    return list(out.items())


def apply_repairs(text: str, repairs: dict[str, str]) -> str:
    """Folded ``text`` with whole tokens replaced."""
    parts, at = [], 0
    decomposed = unicodedata.normalize("NFD", text)
    for m in _TOKEN.finditer(decomposed):
        new = repairs.get(unicodedata.normalize("NFC", m.group()))
        if new is not None:
            parts += [decomposed[at : m.start()], new]
            at = m.end()
    return unicodedata.normalize("NFC", "".join([*parts, decomposed[at:]]))


def unify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, r1, r2``: each non-null text in its one form; r1, r2 stand for the original string.

    First the forms of characters are folded. Then look-alike letters are repaired by token: a token that mixes scripts (or
    is drawn alike throughout and stands in a text of another script) gets the letters of its own script, if the result is a word
    of the corpus: it occurs anywhere as a token that needs no repair. Case, punctuation, line ends and the number of
    blanks stay. Empty texts stay empty; ids may repeat.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("t", pa.string()), ("c", pa.string())]))
        for batch in batches:
            texts = [fold_forms(t) for t in batch.column("text").to_pylist()]
            found = [[{"t": a, "c": b} for a, b in suspects(t)] or None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), batch.column("r1"), batch.column("r2"), pa.array(found, kind)], ["id", "text", "r1", "r2", "suspects"])

    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    r1, r2 = digest(F.col("text"))
    id_type = base.schema["id"].dataType.simpleString()
    columns = f"id {id_type}, text string, r1 long, r2 long"
    folded = materialize(base.select("id", "text", r1.alias("r1"), r2.alias("r2")).mapInArrow(fold, f"{columns}, suspects array<struct<t:string,c:string>>"), "folded")
    doubtful = folded.where("suspects is not null").select("r1", "r2", "text", F.explode("suspects").alias("s")).select("r1", "r2", F.col("s.t").alias("t"), F.col("s.c").alias("c"))
    spellings = materialize(doubtful.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n")), "spellings")
    wanted = spellings.select("c").distinct()
    # words of the corpus, as 64-bit hashes; a token that needs repair itself is no word
    letters = r"[\p{L}\p{M}]+"
    words = folded.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(letters), F.lit(0)))).alias("w")).select(F.xxhash64("w").alias("w")).distinct()
    known = wanted.join(words, F.xxhash64("c") == F.col("w")).select("c")
    accepted = materialize(spellings.join(known, "c").select("t", "c", "n"), "accepted")
    total = spellings.agg(F.sum("n")).first()[0] or 0
    one = doubtful.select("r1", "r2", "t", "c").distinct()
    repairs = hot_aware_join(materialize(one, "doubtful"), accepted, ["t", "c"], "n", total).groupBy("r1", "r2").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("repairs"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [apply_repairs(t, dict(r)) if r else t for t, r in zip(batch.column("text").to_pylist(), batch.column("repairs").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), batch.column("r1"), batch.column("r2")], ["id", "text", "r1", "r2"])

    mended = folded.where("suspects is not null").drop("suspects").join(repairs, ["r1", "r2"], "left").select("id", "text", "r1", "r2", "repairs").mapInArrow(repair, columns)
    return folded.where("suspects is null").drop("suspects").unionByName(mended)


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, rep_id, copies`` of every text of a set that comes out in one form but is written in at least two ways.

    ``rep_id`` is the smallest id; the representative has a row too. Null texts take no part.
    """
    keyed = unify(df, id_col, text_col).select("id", *digest(F.col("text")), "r1", "r2")
    several = (F.min("r1") < F.max("r1")) | (F.min("r2") < F.max("r2"))
    groups = members_of_groups(keyed, ["k1", "k2"], "id", [several.alias("several")], keep=["r1", "r2"])
    return groups.where("several").select("id", "rep_id", "copies")
