"""Problem 9: evaluation texts that leak into a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import code_points, keep_table
from millrace.session import materialize

#: A shared run of reduced characters of this length is a leak; by language of the item, else RUN.
RUN, RUN_BY_LANG = 50, {"zh": 20}
#: Words of a template window and how many of them must be plain; a Chinese character is a word of its own.
WORDS, PLAIN = 5, 3
WORDS_BY_LANG = {"zh": 10}
#: Length of the plain windows beside them. Of an item every (RUN - PLAIN_WINDOW + 1)-th one is kept, so that any shared run holds one.
PLAIN_WINDOW = {50: 32, 20: 16}
#: Characters of items that are sent out at once; a larger set of items is searched in several passes over the corpus.
BLOCK_CHARACTERS = 20_000_000
#: Share of an item's template windows that a re-parameterised question has.
SHARE = 0.5
#: Characters of documents that are handled at once.
CHUNK = 1_000_000
#: Units that may follow a number.
UNITS = (
    """metre metres meter meters centimetre centimetres millimetre millimetres kilometre kilometres km cm mm kilo kilos kilogram kilograms kg gram grams g litre litres second seconds minute
    minutes hour hours day days week weeks month months year years dollar dollars euro euros percent kb mb gb segundos segundo minutos horas días semanas meses años pesos metros centímetros
    sekunden minuten stunden tage wochen monate jahre meter zentimeter секунд секунды минут часов дней недель месяцев лет рублей метров""".split()
)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1))
_PLACEHOLDERS = np.array([_NUMBER, _UNIT, _NAME])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _table(test) -> np.ndarray:
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


class _Kinds:
    """For each code point, whether it is a digit, a character that is a word of its own, or an end of a sentence."""

    digit: np.ndarray | None = None

    @classmethod
    def load(cls) -> type[_Kinds]:
        if cls.digit is None:
            cls.alone = np.zeros(0x110000, bool)
            cls.alone[0x3400:0xA000] = True
            cls.alone[0x20000:0x32000] = True
            cls.end = np.zeros(0x110000, bool)
            cls.end[[ord(c) for c in ".!?。！？\n:;¿¡"]] = True
            cls.digit = _table(str.isdecimal)
        return cls


class Texts(NamedTuple):
    """Texts as one array of reduced characters and one of canonical words.

    ``chars`` with ``of`` (the text each belongs to); for words: ``word`` (hash of the canonical form: numbers, units behind numbers and
    names are placeholders), ``value`` (hash of the word itself), ``begin`` (place of its first character) and ``word_of``.
    """

    chars: np.ndarray
    of: np.ndarray
    word: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    word_of: np.ndarray


def _hash_words(texts: list[str]) -> np.ndarray:
    return np.unique(analyse(texts, None, np.empty(0, np.uint64)).value)


def analyse(texts: list[str], units: np.ndarray | None, names: np.ndarray) -> Texts:
    """:class:`Texts` of ``texts``.

    A word is a run of letters and marks, a run of digits, or one Chinese character. A name is a word of the sorted hashes
    ``names``, or one with a capital at its start only that doesn't begin a sentence. Numbers, and names, that follow each other are one.
    """
    kinds = _Kinds.load()
    lower = [t.lower() for t in texts]
    same = [len(a) == len(b) for a, b in zip(texts, lower)]
    low = code_points("\n".join(lower) + "\n")
    own = low if not all(same) and not any(same) else code_points("\n".join(a if k else b for a, b, k in zip(texts, lower, same)) + "\n")
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    keep = keep_table()[low]
    at = np.flatnonzero(keep)
    chars = low[at]
    of = np.repeat(np.arange(len(texts)), lengths)[at]
    if not len(at):
        none = np.empty(0, np.uint64)
        return Texts(chars, of, none, none, np.empty(0, np.int64), np.empty(0, np.int64))
    digit, alone = kinds.digit[chars], kinds.alone[chars]
    starts = np.ones(len(at), bool)
    starts[1:] = (at[1:] != at[:-1] + 1) | (digit[1:] != digit[:-1]) | alone[1:] | alone[:-1]
    begin = np.flatnonzero(starts)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    x = _mixed((chars.astype(np.uint64) + np.uint64(1)) * _A) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
    value = _mixed(np.add.reduceat(_mixed(x), begin))
    # kinds of words; a word alone has the value that the last step gives it
    single = _mixed(value)
    number = digit[begin]
    upper = (low != own)[at]
    capital = upper[begin] & (np.add.reduceat(upper.astype(np.int64), begin) == 1)
    ends = np.cumsum(kinds.end[low])[at]
    last = np.r_[begin[1:] - 1, len(at) - 1]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (ends[begin[1:]] != ends[last[:-1]]) | (of[begin[1:]] != of[begin[:-1]])
    name = (capital & ~fresh) | _among(single, names)
    unit = np.zeros(len(begin), bool)
    if units is not None:
        unit[1:] = number[:-1] & _among(single[1:], units)
    name &= ~number & ~unit
    word = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    word_of = of[begin]
    # placeholders of one kind that follow each other become one, whose value is that of all of them
    again = np.zeros(len(begin), bool)
    again[1:] = (word[1:] == word[:-1]) & (number | name)[1:] & (word_of[1:] == word_of[:-1])
    first = np.flatnonzero(~again)
    order = np.arange(len(begin)) - np.repeat(first, np.diff(np.r_[first, len(begin)]))
    value = np.add.reduceat(_mixed(value * (np.uint64(2) * order.astype(np.uint64) + np.uint64(1))), first)
    return Texts(chars, of, word[first], value, begin[first], word_of[first])


def _among(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """For each place a hash of the next ``size`` values; those that would go beyond the end are left out."""
    total = len(x) - size + 1
    if total <= 0:
        return np.empty(0, np.uint64)
    h, have, out, done = x, 1, None, 0
    while True:
        if size & have:
            part = h[done : done + total]
            out = part if out is None else _mixed(out * _C + part)
            done += have
        if done == size:
            return _mixed(out)
        h = _mixed(h[:-have] * _A + h[have:] * _C)
        have *= 2


def windows(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, template, exact) of each window of ``words`` canonical words within one text of which enough are plain."""
    template, exact = _runs(texts.word, words), _runs(texts.value, words)
    n = len(template)
    plain = np.cumsum(np.r_[0, ~np.isin(texts.word, _PLACEHOLDERS)])
    good = (texts.word_of[:n] == texts.word_of[words - 1 :][:n]) & ((plain[words:] - plain[:-words])[:n] * WORDS >= PLAIN * words)
    at = np.flatnonzero(good)
    return at, template[at], exact[at]


def plain_windows(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of ``size`` reduced characters within one text."""
    h = _runs(_mixed((texts.chars.astype(np.uint64) + np.uint64(1)) * _A), size)
    at = np.flatnonzero(texts.of[: len(h)] == texts.of[size - 1 :][: len(h)])
    return at, h[at]


class Index:
    """A sorted table of window hashes with what each stands for; a bit table answers most look-ups in one step."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.columns = keys[order], [c[order] for c in columns]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys >> np.uint64(44)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``x``, row of the table) of every match."""
        at = np.flatnonzero(self.bits[x >> np.uint64(44)])
        lo, hi = (np.searchsorted(self.keys, x[at], side) for side in ("left", "right"))
        n = hi - lo
        where = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(n) else np.empty(0, np.int64)
        return np.repeat(at, n), where


class Bank:
    """Items as they are searched for: their texts, template windows and plain windows."""

    def __init__(self, ids: list[int], texts: list[str], langs: list[str]) -> None:
        self.ids = np.array(ids, np.int64)
        self.units = _hash_words([" ".join(UNITS)])
        # words with a capital within a sentence, unless the items have them in lower case too, are names whatever their case elsewhere
        plain = analyse(texts, self.units, np.empty(0, np.uint64))
        small = _hash_words([" ".join(w for w in t.split() if w == w.lower()) for t in texts])
        self.names = np.setdiff1d(plain.value[plain.word == _NAME], small)
        self.texts = analyse(texts, self.units, self.names)
        kind = np.array([next((i for i, k in enumerate(RUN_BY_LANG) if (x or "").lower().startswith(k)), -1) for x in langs], np.int64)
        keys = list(RUN_BY_LANG)
        self.least = np.array([RUN if k < 0 else RUN_BY_LANG[keys[k]] for k in kind], np.int64)
        size = np.array([WORDS if k < 0 else WORDS_BY_LANG.get(keys[k], WORDS) for k in kind], np.int64)
        self.template: dict[int, Index] = {}
        self.plain: dict[int, Index] = {}
        self.total = np.zeros(len(ids), np.int64)
        for n in sorted(set(size.tolist())):
            at, template, exact = windows(self.texts, n)
            mine = size[self.texts.word_of[at]] == n
            at, template, exact = at[mine], template[mine], exact[mine]
            self.total += np.bincount(self.texts.word_of[at], minlength=len(ids))
            self.template[n] = Index(template, at, exact)
        for n in sorted(set(self.least.tolist())):
            at, h = plain_windows(self.texts, PLAIN_WINDOW[n])
            item = self.texts.of[at]
            first = np.searchsorted(self.texts.of, item)
            mine = (self.least[item] == n) & ((at - first) % (n - PLAIN_WINDOW[n] + 1) == 0)
            self.plain[n] = Index(h[mine], at[mine])


def shared_run(a: Texts, p: np.ndarray, b: Texts, q: np.ndarray, most: int) -> np.ndarray:
    """Length of the run of equal characters around places ``p`` of ``a`` and ``q`` of ``b``, counted up to ``most`` to either side."""
    out = np.zeros(len(p), np.int64)
    steps = np.arange(most)
    for lo in range(0, len(p), 20_000):
        i, j = p[lo : lo + 20_000, None], q[lo : lo + 20_000, None]
        length = 0
        for x, y in ((i + steps, j + steps), (i - 1 - steps, j - 1 - steps)):
            inside = (x >= 0) & (y >= 0) & (x < len(a.chars)) & (y < len(b.chars))
            x, y = np.clip(x, 0, len(a.chars) - 1), np.clip(y, 0, len(b.chars) - 1)
            equal = inside & (a.chars[x] == b.chars[y]) & (a.of[x] == a.of[i]) & (b.of[y] == b.of[j])
            length = length + np.where(equal.all(1), most, np.argmin(equal, 1))
        out[lo : lo + 20_000] = length
    return out


def _changed(doc: np.ndarray, item: np.ndarray) -> int | None:
    """How many slot values of an item (``item``) have another value in the document; None if a value stands for two, or two for one."""
    pairs = set(zip(item.tolist(), doc.tolist()))
    if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
        return None
    return sum(a != b for a, b in pairs)


def search(texts: list[str], bank: Bank) -> list[tuple[int, int, str, bool, float, int, int, int]]:
    """(text, item, kind, by template, share, changed, begin, end) of what each text has of each item.

    Windows of canonical words are looked up in the bank's; a window whose slots have the item's own values, and every sampled
    plain window, is extended to the run of equal characters around it: the pair is ``verbatim`` (once a pair) if the run is long
    enough. The words of a text that have such a pair's own values are a stretch of kind ``same``. Matches of a template that are
    in line (same distance of places) and make up SHARE of the item's windows, with slot values that stand for each other one to
    one and of which ``changed`` differ, are a stretch of kind ``other``.
    """
    t = analyse(texts, bank.units, bank.names)
    most = int(bank.least.max(initial=RUN))
    found: dict[tuple[int, int], bool] = {}
    lines: list[np.ndarray] = []
    for n, index in bank.template.items():
        at, template, exact = windows(t, n)
        hit, row = index.hits(template)
        at, exact, place = at[hit], exact[hit], index.columns[0][row]
        doc, item = t.word_of[at], bank.texts.word_of[place]
        equal = exact == index.columns[1][row]
        long_ = shared_run(t, t.begin[at[equal]], bank.texts, bank.texts.begin[place[equal]], most) >= bank.least[item[equal]]
        found |= dict.fromkeys(zip(doc[equal][long_].tolist(), item[equal][long_].tolist()), True)
        lines.append(np.stack([doc, item, at - place, at, place, np.full(len(at), n), equal], 1))
    for n, index in bank.plain.items():
        at, h = plain_windows(t, PLAIN_WINDOW[n])
        hit, row = index.hits(h)
        at, place = at[hit], index.columns[0][row]
        doc, item = t.of[at], bank.texts.of[place]
        long_ = shared_run(t, at, bank.texts, place, most) >= bank.least[item]
        for pair in zip(doc[long_].tolist(), item[long_].tolist()):
            found.setdefault(pair, False)
    out = [(d, i, "verbatim", by, 1.0, 0, 0, 0) for (d, i), by in found.items()]
    hits = np.concatenate(lines) if lines else np.empty((0, 7), np.int64)
    hits = hits[np.lexsort((hits[:, 3], hits[:, 2], hits[:, 1], hits[:, 0]))]
    first = np.flatnonzero(np.r_[True, (hits[1:, :3] != hits[:-1, :3]).any(1)]) if len(hits) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(hits)])
    enough = sizes >= SHARE * np.maximum(bank.total[hits[first, 1]], 1) if len(hits) else np.empty(0, bool)
    for lo, size, many in zip(first.tolist(), sizes.tolist(), enough.tolist()):
        line = hits[lo : lo + size]
        d, i, _, begin, place, n, _ = line[0].tolist()
        if (d, i) in found:
            if line[:, 6].any():
                same = line[line[:, 6] == 1]
                out.append((d, i, "same", True, 1.0, 0, int(same[0, 3]), int(same[-1, 3]) + n))
            continue
        if not many:
            continue
        span = np.unique((line[:, 3:4] + np.arange(n)).ravel())
        mine = span + place - begin
        slot = np.isin(t.word[span], _PLACEHOLDERS) & (t.word[span] == bank.texts.word[mine])
        changed = _changed(t.value[span][slot], bank.texts.value[mine][slot])
        if changed:
            out.append((d, i, "other", True, size / int(bank.total[i]), changed, begin, int(line[-1, 3]) + n))
    return out


_HITS = "doc long, key long, item long, kind string, by_template boolean, share double, changed int, begin int, end int"


def hits(corpus: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, lang_col: str) -> DataFrame:
    """What :func:`search` finds, by document; ``key`` stands for the document and its text.

    The items are the query set: they are sent to every task in blocks of about BLOCK_CHARACTERS characters, and all documents are
    read once a block, wherever they lie, without a shuffle. Null and empty texts, and rows with a null id, give nothing.
    """
    spark = corpus.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"), F.coalesce(lang_col, F.lit("")).alias("lang")).where("text is not null and item is not null")
    items = materialize(items, "leak-items")
    texts = corpus.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text <> ''").withColumn("key", F.xxhash64("doc", "text"))
    blocks = -(-int(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARACTERS)
    found = spark.createDataFrame([], _HITS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        if not rows:
            continue
        bank = spark.sparkContext.broadcast(Bank([r["item"] for r in rows], [r["text"] for r in rows], [r["lang"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], bank=bank) -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc", "key", "item", "kind", "by_template", "share", "changed", "begin", "end"]
            for batch in batches:
                ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                pieces = batch.column("text").to_pylist()
                ends = np.cumsum([len(x) for x in pieces])
                cut = np.unique(np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK)) + 1).tolist()
                for lo, hi in zip([0, *cut], [*cut, len(pieces)]):
                    at, item, *rest = list(zip(*search(pieces[lo:hi], bank.value))) or [()] * 8
                    place = np.array(at, np.int64) + lo
                    columns = [pa.array(ids[place], pa.int64()), pa.array(keys[place], pa.int64()), pa.array(bank.value.ids[np.array(item, np.int64)])]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, rest, kinds)], names)

        found = found.unionByName(texts.select("doc", "key", "text").mapInArrow(run, _HITS))
    return found


def leaks(corpus: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, lang_col: str) -> DataFrame:
    """``doc, item, by_template`` for each document and each item with which it shares a run of RUN reduced characters (by language of the item).

    ``by_template`` is false where only a plain window led to the passage: it has too few whole words. Empty texts, nulls and
    blocks are as in :func:`hits`; repeated ids give one row a pair.
    """
    found = hits(corpus, doc_col, text_col, items, item_col, item_text, lang_col).where("kind = 'verbatim'")
    return found.groupBy("doc", "item").agg(F.max("by_template").alias("by_template"))


def reparameterised(corpus: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, lang_col: str | None = None) -> DataFrame:
    """``doc, item, changed``: documents that ask an item's question with other numbers, units or names, each put in consistently.

    Where several stretches of a document overlap, what stands there verbatim counts, then the largest share of an item's windows,
    the fewest changes, the smallest item. Names need their capitals and spaces between words, unless the items have them: texts in
    one case or in Chinese match by numbers, units and the names of the items only.
    """
    items = items.withColumn("_lang", F.col(lang_col) if lang_col else F.lit(""))
    found = hits(corpus, doc_col, text_col, items, item_col, item_text, "_lang").where("kind <> 'verbatim'")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        kept = []
        order = rows.assign(own=rows["kind"] != "same", share=-rows["share"]).sort_values(["own", "share", "changed", "item", "begin"])
        for r in order.itertuples():
            if not r.own or all(r.end <= a or r.begin >= b for a, b in taken):
                taken.append((r.begin, r.end))
                if r.own:
                    kept.append((r.doc, r.item, r.changed))
        return pd.DataFrame(kept, columns=["doc", "item", "changed"])

    # a group is what one text has of all items
    chosen = found.groupBy("key").applyInPandas(best, "doc long, item long, changed int")
    return chosen.groupBy("doc", "item").agg(F.min("changed").alias("changed"))
