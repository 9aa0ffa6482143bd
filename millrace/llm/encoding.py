"""Problem 8: encoding of a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import materialize, release

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: The split pattern of this tokenizer family (contractions, words, numbers, other signs, white space).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: A word that makes up at least one FREQUENT-th of all words is looked up in a broadcast table of at most 2 * FREQUENT words,
#: whatever the corpus; so no other word is a hot key.
FREQUENT = 200_000
#: Words of a chunk of texts, whose rare words are asked for together; a longer text is a chunk of its own.
CHUNK = 1_000_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a rank file; a word is encoded alone, as the split is done before."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece`` (bytes) of the vocabulary; as many rows as the file has."""
    lines = spark.read.text(path).where("value <> ''").select(F.split("value", " ").alias("p"))
    return lines.select(F.col("p")[1].cast("int").alias("id"), F.unbase64(F.col("p")[0]).alias("piece"))


def _packed(path: str) -> np.dtype:
    """Ids are shuffled as two bytes where the vocabulary allows it; the largest value marks a hole."""
    return np.dtype("<u2") if encoder(path).n_vocab < 0xFFFF else np.dtype("<u4")


def _encode_all(words: list[str], path: str) -> list[bytes]:
    kind, enc = _packed(path), encoder(path)._core_bpe
    return [np.array(enc.encode_single_piece(w.encode("utf-8", "replace")), kind).tobytes() for w in words]


def frequent_words(texts: DataFrame, frequent: int) -> list[str]:
    """At most 2 * ``frequent`` words of ``texts`` (column ``words``), among them every one with a share of one ``frequent``-th or more.

    A task reports the words that make up one (2 * frequent)-th of its own words. A word that all tasks together don't report that
    often has less than this share where it was not reported, and less than it where it was: together less than one frequent-th.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = 0, []

        def merged() -> pa.Table:
            return pa.concat_tables(kept).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

        for batch in batches:
            both = batch.column("words").flatten().value_counts()
            total += len(batch.column("words").flatten())
            kept.append(pa.table({"w": both.field("values"), "n": both.field("counts")}))
            if sum(map(len, kept)) > 2_000_000:
                kept = [merged()]
        if kept:
            all_ = merged()
            often = all_.filter(pc.greater_equal(pc.multiply(all_["n"], 2 * frequent), total))
            yield from often.append_column("total", pa.array([0] * len(often), pa.int64())).to_batches()
            yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["w", "n", "total"])

    reported = materialize(texts.select("words").mapInArrow(count, "w string, n long, total long"), "word-counts")
    total = reported.agg(F.sum("total")).first()[0] or 0
    counted = reported.where("n > 0").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * frequent) >= total)
    words = [r["w"] for r in counted.collect()]
    release(reported)
    return words


def encode(df: DataFrame, id_col: str, text_col: str, path: str, frequent: int = FREQUENT) -> DataFrame:
    """``id, ids`` for each row: the token ids of the text, without special tokens; an empty list for null and empty texts.

    Texts are split into words by the tokenizer's own pattern in Spark. Words with a share of one ``frequent``-th, most of any
    corpus, are looked up in a broadcast table of bounded size, where their texts lie. Of all others, each chunk of texts asks for
    every distinct word once, with its places. The words asked for are brought together by word; each partition is a table of its
    distinct words, each encoded once, from which ids go back to their chunk and are put in by place. No text is cut; repeated ids give a row each, a null id too.
    """
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORDS), F.lit(0)).alias("words")
    texts = df.select(F.col(id_col).alias("id"), words)
    top = frequent_words(texts, frequent)
    known = texts.sparkSession.sparkContext.broadcast((top, _encode_all(top, path)))
    kind = _packed(path)
    hole = np.iinfo(kind).max
    id_type = texts.schema["id"].dataType.simpleString()
    columns = ["chunk", "w", "places", "ids", "packed", "sizes"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk of texts becomes one row of ids, with a hole for each rare word, and one row for each distinct rare word
        table_words, table_ids = known.value
        place = dict(zip(table_words, range(len(table_words))))
        flat = np.frombuffer(b"".join(table_ids) + hole.to_bytes(kind.itemsize, "little"), kind)
        lengths = np.array([len(b) // kind.itemsize for b in table_ids] + [1], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        last = len(table_words)
        for batch in batches:
            counts = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            cut = np.unique(np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK)) + 1).tolist()
            for lo, hi in zip([0, *cut], [*cut, len(counts)]):
                if lo >= hi:
                    continue
                lists = batch.column("words").slice(lo, hi - lo)
                coded = lists.flatten().dictionary_encode()
                entry = np.fromiter((place.get(w, last) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                word = coded.indices.to_numpy()
                at = entry[word]
                n = lengths[at]
                total = np.concatenate([[0], np.cumsum(n)])
                ids = flat[np.repeat(begins[at] - total[:-1], n) + np.arange(total[-1])]
                sizes = np.diff(total[np.concatenate([[0], np.cumsum(counts[lo:hi])])]).astype(np.int32)
                # the places of each rare word, as numbers of holes
                rare = word[at == last]
                order = np.argsort(rare, kind="stable")
                distinct, first = np.unique(rare[order], return_index=True)
                places = _binary(order.astype(np.uint32), np.append(first[1:], len(order))[: len(distinct)] * 4)
                chunk, asked = batch.column("row")[lo].as_py(), len(distinct)
                own = [pa.concat_arrays([pa.array([x], pa.binary()), pa.nulls(asked, pa.binary())]) for x in (_to_bytes(batch.column("id").slice(lo, hi - lo)), ids.tobytes(), sizes.tobytes())]
                words_ = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(distinct)).cast(pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(asked + 1, chunk, np.int64)), words_, pa.concat_arrays([pa.nulls(1, pa.binary()), places]), *own], columns)

    half = texts.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "words")
    half = materialize(half.mapInArrow(look_up, "chunk long, w string, places binary, ids binary, packed binary, sizes binary"), "half-encoded")

    def encode_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words come sorted, so a word is met in one run; the last one of a batch is kept for the next
        kept: dict[str, bytes] = {}
        for batch in batches:
            coded = batch.column("w").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [w for w in distinct if w not in kept]
            table = kept | dict(zip(new, _encode_all(new, path)))
            ids = pa.array([table[w] for w in distinct], pa.binary()).take(coded.indices)
            kept = {w: table[w] for w in [batch.column("w")[-1].as_py()]} if len(coded) else kept
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("places"), ids], ["chunk", "places", "packed"])

    asked = half.where("w is not null").select("chunk", "w", "places").repartition("w").sortWithinPartitions("w")
    told = asked.mapInArrow(encode_rare, "chunk long, places binary, packed binary")
    parts = half.where("w is null").select("chunk", "ids", "sizes", "packed").unionByName(told, allowMissingColumns=True)

    def fill_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a chunk come together, its ids with holes first
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(chunk)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(chunk)]):
                if kept and lo < hi and kept[0].column("chunk")[0].as_py() != chunk[lo]:
                    yield _filled(kept, kind)
                    kept = []
                if lo < hi:
                    kept.append(batch.slice(lo, hi - lo))
        if kept:
            yield _filled(kept, kind)

    # one key, by which rows can be sorted without comparing them
    turn = F.col("chunk") * 2 + F.col("places").isNotNull().cast("int")
    together = parts.withColumn("turn", turn).repartition("chunk").sortWithinPartitions("turn")
    return together.select("chunk", "ids", "sizes", "packed", "places").mapInArrow(fill_in, f"id {id_type}, ids array<int>")


def _to_bytes(column: pa.Array) -> bytes:
    """A column as one value: lists beside many rows are slow to send."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``, up to the byte ``ends`` each."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all items, items of each value) of a column of packed numbers."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(items.tobytes(), kind), np.diff(offsets) // kind.itemsize


def _filled(batches: list[pa.RecordBatch], kind: np.dtype) -> pa.RecordBatch:
    """The texts of a chunk, from the row of the chunk itself and those of the answers for its rare words."""
    own = batches[0].slice(0, 1)
    doc_ids, sizes, packed = (own.column(c)[0].as_py() for c in ("ids", "sizes", "packed"))
    answers = [b for b in (batches[0].slice(1), *batches[1:]) if len(b)]
    ids, sizes = np.frombuffer(packed, kind), np.frombuffer(sizes, np.int32).astype(np.int64)
    at = np.flatnonzero(ids == np.iinfo(kind).max)
    length = np.ones(len(ids), np.int64)
    start = np.zeros(len(ids), np.int64)
    pool = np.empty(0, kind)
    if answers:
        pool, n = _values(pa.concat_arrays([b.column("packed") for b in answers]), kind)
        places, many = _values(pa.concat_arrays([b.column("places") for b in answers]), np.dtype(np.uint32))
        n = n.astype(np.int64)
        place = at[places]
        length[place] = np.repeat(n, many)
        start[place] = np.repeat(np.cumsum(n) - n, many)
    # own ids lie before the answers in one array
    source = np.concatenate([ids, pool])
    begin = np.arange(len(ids))
    begin[at] = len(ids) + start[at]
    upto = np.concatenate([[0], np.cumsum(length)])
    flat = source[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])].astype(np.int32)
    offsets = upto[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    doc_ids = pa.ipc.open_stream(doc_ids).read_all().column(0).combine_chunks()
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])


def decode(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, text`` of rows ``id, ids`` with unique ids: each token is joined to its piece of ``vocabulary`` and put in order.

    The vocabulary has a fixed size and is broadcast. An empty list gives an empty text; bytes that aren't UTF-8 are replaced.
    """
    tokens = encoded.select("id", F.posexplode("ids").alias("pos", "t"))
    joined = tokens.join(F.broadcast(vocabulary.select(F.col("id").alias("t"), F.hex("piece").alias("h"))), "t")
    texts = joined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("p"))
    texts = texts.select("id", F.decode(F.unhex(F.array_join(F.col("p.h"), "")), "UTF-8").alias("text"))
    return encoded.select("id").join(texts, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))
