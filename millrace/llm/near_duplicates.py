"""Problem 6: groups of records that share most of their content (chosen-path set similarity join)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import reduced
from millrace.operators.graph import minimum_labels
from millrace.operators.skew import HOT_SHARE, digest, heavy_keys, hot_aware_join
from millrace.session import materialize, release

#: Similarity is taken over runs of SHINGLE characters of the reduced text; texts shorter than MIN_LENGTH take no part.
SHINGLE, THRESHOLD, MIN_LENGTH = 8, 0.6, 120
#: Children of a record at each node, the deepest level, and the share of pairs at THRESHOLD that must meet in a final node even
#: if every node on their way is too large to be compared.
CHILDREN, LEVELS, RECALL = 2, 5, 0.99
#: Nodes of up to NODE records are compared in full. Larger ones are, if their pairs of different classes are at most LEAF for
#: each record or no level is left, block by block (blocks of about BLOCK records); else they go down a level.
NODE, LEAF, BLOCK = 1024, 8, 64
#: A record with more partners than PART is split when texts are fetched; nodes are compared in chunks of about CHUNK rows.
PART, CHUNK = 20_000, 100_000
#: Minwise values of a record, and the share of pairs at THRESHOLD that the comparison of signatures may lose.
BINS, LOST = 64, 1e-4


def survival(levels: int, similarity: float = THRESHOLD) -> float:
    """Probability that two records of this similarity meet at a node ``levels`` levels down one tree.

    They share each of the CHILDREN children of a node they share independently with that probability.
    """
    s = 1.0
    for _ in range(levels):
        s = 1 - (1 - similarity * s) ** CHILDREN
    return s


#: Independent trees, as many as RECALL needs.
TREES = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(LEVELS)))
assert TREES <= 8 and TREES * LEVELS * CHILDREN <= BINS and (LEVELS - 1) * CHILDREN * 8 <= 64


def least_equal() -> int:
    """How many of the BINS four-bit signatures of a pair must be equal: a pair at THRESHOLD has fewer with probability LOST at most."""
    p, below = THRESHOLD + (1 - THRESHOLD) / 16, 0.0
    for k in range(BINS + 1):
        below += math.comb(BINS, k) * p**k * (1 - p) ** (BINS - k)
        if below > LOST:
            return k
    return BINS


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONES = 0x1111111111111111
#: A signature: sixteen minwise values in each word.
_SIGNATURE = ("s0", "s1", "s2", "s3")
_RECORD = ("did", *_SIGNATURE)


def _spread(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of runs, each combined with that of the run ``step`` further on (zero beyond the end)."""
    nxt = np.zeros_like(h)
    nxt[:-step] = h[step:]
    h = (h * np.uint64(0xBF58476D1CE4E5B9 + 2 * step)) ^ (nxt * np.uint64(0x94D049BB133111EB))
    return h ^ (h >> np.uint64(31))


def run_hashes(cps: np.ndarray, size: int) -> np.ndarray:
    """For each position a 64-bit hash of the next ``size`` (a multiple of 8) code points, those beyond the end being zeros."""
    h = (cps.astype(np.uint64) + np.uint64(1)) * _ODD
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4):
        h = _spread(h, step)
    eight = h
    for k in range(8, size, 8):
        nxt = np.zeros_like(h)
        nxt[:-k] = eight[k:]
        h = (h ^ nxt) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h * _ODD


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a reduced text, as sorted hashes."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(run_hashes(cps, SHINGLE)[: max(0, len(cps) - SHINGLE + 1)])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of all distinct shingles of either side."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return shared / (both - shared)


def minwise(texts: list[str]) -> np.ndarray:
    """BINS minwise values of each text: the smallest hash of the shingles of each hash class, borrowed from the next class where one is empty."""
    out = np.full((len(texts), BINS), _TOP)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cut = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // 1_000_000 + 1) * 1_000_000)
    for lo, hi in zip([0, *cut], [*cut, len(texts)]):
        if lo >= hi:
            continue
        n = sizes[lo:hi]
        h = run_hashes(np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32), SHINGLE)
        of = np.repeat(np.arange(hi - lo), n)
        within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        inside = within <= np.repeat(n - SHINGLE, n)
        h, of = h[inside], of[inside]
        table = np.full((hi - lo) * BINS, _TOP)
        np.minimum.at(table, of * BINS + (h >> np.uint64(58)).astype(np.int64), h << np.uint64(6))
        out[lo:hi] = table.reshape(-1, BINS)
    empty = out == _TOP
    own = out.copy()
    for step in range(1, BINS):
        if not empty.any():
            break
        from_ = np.roll(own, -step, axis=1)
        fill = empty & (from_ != _TOP)
        out[fill] = (from_ * _ODD + np.uint64(step))[fill]
        empty &= ~fill
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sketches(docs: DataFrame) -> DataFrame:
    """``did, s0..s3, nodes, further``: a record's signature, its nodes of the first level (the lowest three bits tell the tree), and for each tree what chooses its children further down."""
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    seven = np.uint64(7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = minwise(batch.column("text").to_pylist())
            group = batch.column("g").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            four = (m * _ODD) >> np.uint64(60)
            signature = [(four[:, k : k + 16] << shifts).sum(1, dtype=np.uint64) for k in range(0, BINS, 16)]
            # eight bits of each token tell the children of one node apart well enough
            low = m & np.uint64(0xFF)
            nodes, further = np.empty((len(m), TREES * CHILDREN), np.uint64), np.zeros((len(m), TREES), np.uint64)
            for tree in range(TREES):
                at = tree * LEVELS * CHILDREN
                for k in range(at + CHILDREN, at + LEVELS * CHILDREN):
                    further[:, tree] = (further[:, tree] << np.uint64(8)) | low[:, k]
                for c in range(CHILDREN):
                    node = (m[:, at + c] ^ group) * _ODD + np.uint64(at + c)
                    nodes[:, tree * CHILDREN + c] = (node & ~seven) | np.uint64(tree)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (nodes, further)]
            yield pa.RecordBatch.from_arrays([batch.column("did"), *[pa.array(x.view(np.int64)) for x in signature], *lists], [*_RECORD, "nodes", "further"])

    found = docs.select("did", F.xxhash64("group").alias("g"), "text").mapInArrow(run, f"{', '.join(f'{k} long' for k in _RECORD)}, nodes array<long>, further array<long>")
    return materialize(found, "sketches")


def _alike(x: str, y: str) -> Column:
    """Whether enough of the four-bit minwise signatures of ``x`` and ``y`` are equal for a similar pair."""

    def unequal(s: str) -> Column:
        bits = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(_ONES)))

    return sum(map(unequal, _SIGNATURE), F.lit(0)) <= BINS - least_equal()


Rows = dict[str, np.ndarray]


def _alike_rows(r: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    unequal = np.zeros(len(i), np.uint8)
    for s in _SIGNATURE:
        bits = r[s][i] ^ r[s][j]
        bits |= bits >> np.uint64(2)
        bits |= bits >> np.uint64(1)
        bits &= np.uint64(_ONES)
        unequal += np.bitwise_count(bits)
    return unequal <= BINS - least_equal()


def leaders(r: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each record with the first leader of its node that it is alike; a record alike none is a leader. Rows are sorted by node."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.arange(len(r["node"]))
    while len(active):
        node = r["node"][active]
        first = np.ones(len(active), bool)
        first[1:] = node[1:] != node[:-1]
        lead = active[np.flatnonzero(first)][np.cumsum(first) - 1]
        alike = _alike_rows(r, active, lead)
        hit = alike & ~first
        out.append((r["did"][lead[hit]], r["did"][active[hit]]))
        active = active[~alike & ~first]
        node = r["node"][active]
        same = node[1:] == node[:-1]
        several = np.zeros(len(active), bool)
        several[1:] |= same
        several[:-1] |= same
        active = active[several]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def strangers(r: Rows) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a node that are alike and have different labels. Rows are sorted by node."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    node = r["node"]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(node)])
    mixed = np.minimum.reduceat(r["label"], starts) < np.maximum.reduceat(r["label"], starts) if len(node) else np.empty(0, bool)
    left = np.repeat(np.where(mixed, starts + sizes, starts), sizes) - np.arange(len(node))
    at, shift = np.flatnonzero(left > 1), 1
    while len(at):
        pairs = at[r["label"][at] != r["label"][at + shift]]
        pairs = pairs[_alike_rows(r, pairs, pairs + shift)]
        out.append((r["did"][pairs], r["did"][pairs + shift]))
        shift += 1
        at = at[left[at] > shift]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def _within_nodes(rows: DataFrame, compare: Callable[[Rows], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``a, b, node`` of ``rows`` (``node, did, s0..s3, ...``): pairs that ``compare`` finds in nodes of up to NODE records, with a null node.

    Rows of larger nodes come out as they are, with their ``did`` as ``a`` and that of the node's smallest record as ``b``. They are
    handed on as they come and never kept, so a task holds NODE rows of one node at most, and a chunk of small nodes.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Rows] = []
        large: tuple[int, int] | None = None

        def out(a: np.ndarray, b: np.ndarray, node: np.ndarray | None = None) -> pa.RecordBatch:
            nodes = pa.nulls(len(a), pa.int64()) if node is None else pa.array(node)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nodes], ["a", "b", "node"])

        for batch in chain(batches, [None]):
            if batch is not None:
                new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
                kept.append(new | {k: new[k].view(np.uint64) for k in _SIGNATURE})
                if sum(len(x["node"]) for x in kept) < CHUNK:
                    continue
            if not kept:
                continue
            r = {k: np.concatenate([x[k] for x in kept]) for k in names}
            kept = []
            if large is not None:
                k = int(np.searchsorted(r["node"], large[0], "right"))
                yield out(r["did"][:k], np.full(k, large[1]), r["node"][:k])
                r = {x: v[k:] for x, v in r.items()}
                large = None if len(r["node"]) else large
            node = r["node"]
            if not len(node):
                continue
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sizes = np.diff(np.r_[starts, len(node)])
            # the last node may go on in the next batch
            if batch is not None and sizes[-1] <= NODE:
                kept = [{x: v[starts[-1] :] for x, v in r.items()}]
                r = {x: v[: starts[-1]] for x, v in r.items()}
                starts, sizes = starts[:-1], sizes[:-1]
            elif batch is not None:
                large = (int(node[-1]), int(r["did"][starts[-1]]))
            big = np.repeat(sizes > NODE, sizes)
            if big.any():
                yield out(r["did"][big], np.repeat(r["did"][starts], sizes)[big], r["node"][big])
            yield out(*compare({x: v[~big] for x, v in r.items()}))

    return rows.repartition("node").sortWithinPartitions("node", "did").mapInArrow(run, "a long, b long, node long")


def _hot_nodes(rows: DataFrame) -> DataFrame | None:
    """``node, low``: nodes of more than NODE records that hold at least one HOT_SHARE-th of ``rows``, with their smallest record; None if there is none."""
    heavy = [r["node"] for r in heavy_keys(rows, "node", share=1 / HOT_SHARE).where(F.col("weight") > NODE).select("node").collect()]  # HOT_SHARE at most
    return rows.where(F.col("node").isin(heavy)).groupBy("node").agg(F.min(F.struct(*_RECORD)).alias("low")) if heavy else None


def first_rows(sketch: DataFrame) -> DataFrame:
    """``node, did, s0..s3``: every record under each of its nodes of the first level."""
    return sketch.select(F.explode("nodes").alias("node"), *_RECORD)


def _stars(sketch: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of alike records of a first-level node, one for each record at most: with the first leader it is alike, in a large node with the smallest record."""
    rows = first_rows(sketch)
    hot = _hot_nodes(rows)
    pairs = []
    if hot is not None:
        hot = materialize(hot, "hot-nodes")
        stars = rows.join(F.broadcast(hot), "node").where("did <> low.did").select("low", F.struct(*_RECORD).alias("r")).where(_alike("low", "r"))
        pairs.append(stars.select(F.col("low.did").alias("a"), F.col("r.did").alias("b")))
        rows = rows.join(F.broadcast(hot.select("node")), "node", "left_anti")
    found = materialize(_within_nodes(rows, leaders), "leaders")
    pairs.append(found.where("node is null").select("a", "b"))
    sig = sketch.select(*_RECORD)
    big = found.where("node is not null and a <> b").select(F.col("b").alias("low"), "a").distinct()
    for side in ("low", "a"):
        big = big.join(sig.select(F.col("did").alias(side), F.struct(*_RECORD).alias(f"{side}_r")), side)
    pairs.append(big.where(_alike("low_r", "a_r")).select(F.col("low").alias("a"), F.col("a").alias("b")))
    stars = materialize(reduce(DataFrame.union, pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    release(found)
    return stars


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of each node of ``rows`` (``node, did, s0..s3, label, c, m, main``) that have different labels and may be similar.

    Larger nodes are cut into blocks, and every two blocks meet, except two of the node's largest class, which is one already.
    """
    mains, others = F.ceil(F.col("m") / BLOCK), F.ceil((F.col("c") - F.col("m")) / BLOCK)
    is_main, small = F.col("label") == F.col("main"), F.col("c") <= BLOCK
    h = F.xxhash64("did")
    block = F.when(small, F.lit(0)).when(is_main, F.pmod(h, mains)).otherwise(mains + F.pmod(h, others)).cast("int")
    meets = F.sequence(F.when(~small & is_main, mains).otherwise(0).cast("int"), F.when(small, F.lit(0)).otherwise(mains + others - 1).cast("int"))
    rows = rows.select("node", "label", *_RECORD, block.alias("block"), F.explode(meets).alias("other"))
    rows = rows.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.struct(*_RECORD, "label", "block").alias("r"))
    lists = rows.groupBy("node", "lo", "hi").agg(F.collect_list("r").alias("l"))
    first = lists.select("lo", "hi", F.posexplode("l").alias("i", "x"), "l")
    both = first.select("lo", "hi", "x", F.explode(F.slice("l", F.col("i") + 2, F.greatest(F.size("l") - F.col("i") - 1, F.lit(0)))).alias("y"))
    both = both.where("x.label <> y.label and (lo = hi or x.block <> y.block)").where(_alike("x", "y"))
    return both.select(F.least("x.did", "y.did").alias("a"), F.greatest("x.did", "y.did").alias("b"))


def _open_pairs(sketch: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a < b`` that meet in a node, have different labels (``node, label``; a record without one is its own) and may be similar, each once.

    Nodes of up to NODE records are compared in full, where they are of more than one class. A larger node is compared block by
    block if its pairs of different classes are at most LEAF for each record; in others every record goes on to CHILDREN children
    by its tokens of the next level. After LEVELS levels nodes are compared in full, whatever their size.
    """
    known = sketch.select(*_RECORD, "nodes", "further").join(labels.withColumnRenamed("node", "_n"), F.col("did") == F.col("_n"), "left")
    known = materialize(known.withColumn("label", F.coalesce("label", "did")).drop("_n"), "open")
    rows = known.select(F.explode("nodes").alias("node"), *_RECORD, "label")
    used, found = [known], []
    for level in range(1, LEVELS + 1):
        hot = _hot_nodes(rows)
        large = []
        if hot is not None:
            hot = F.broadcast(materialize(hot, "hot-nodes").select("node"))
            large.append(rows.join(hot, "node").select("node", "did"))
            rows = rows.join(hot, "node", "left_anti")
        compared = materialize(_within_nodes(rows, strangers), "met")
        used.append(compared)
        found.append(compared.where("node is null").select("a", "b"))
        large.append(compared.where("node is not null").select("node", F.col("a").alias("did")))
        large = materialize(reduce(DataFrame.union, large).join(known, "did").select("node", *_RECORD, "label", "further"), "large")
        used.append(large)
        total = large.count()
        if not total:
            break
        size = F.col("m").cast("double")
        classes = large.groupBy("node", "label").agg(F.count(F.lit(1)).alias("m"))
        nodes = classes.groupBy("node").agg(F.sum("m").alias("c"), F.count(F.lit(1)).alias("k"), F.max("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("main"), F.sum(size * size).alias("q"))
        mixed = materialize(hot_aware_join(large, materialize(nodes.where("k > 1").drop("k"), "split"), ["node"], "c", total), "mixed")
        used.append(mixed)
        few = (F.col("c").cast("double") * F.col("c") - F.col("q")) / 2 <= LEAF * F.col("c") if level < LEVELS else F.lit(True)
        found.append(materialize(_cross_pairs(mixed.where(few)), "met"))
        used.append(found[-1])
        if level == LEVELS or mixed.where(~few).isEmpty():
            break
        tree = F.col("node").bitwiseAND(7)
        bits = F.get("further", tree.cast("int"))
        tokens = [F.shiftrightunsigned(bits, 8 * ((LEVELS - 1 - level) * CHILDREN + c)).bitwiseAND(0xFF) + 256 * c for c in range(CHILDREN)]
        children = mixed.where(~few).select("node", *_RECORD, "label", F.explode(F.array(*tokens)).alias("t"))
        rows = materialize(children.select(F.xxhash64("node", "t").bitwiseAND(~7).bitwiseOR(tree).alias("node"), *_RECORD, "label"), "level")
        used.append(rows)
    met = reduce(DataFrame.union, [f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for f in found]).distinct()
    met = materialize(met, "open-pairs")
    release(*used)
    return met


def _salts(pairs: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with ``part_side``, and ``side, parts``: the partners of one record are cut into parts of about PART."""
    parts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    parts = materialize(parts, f"parts-{side}")
    other = "b" if side == "a" else "a"
    salted = hot_aware_join(pairs, parts, [side], "n", max(pairs.count(), 1))
    return salted.withColumn(f"part_{side}", F.pmod(F.xxhash64(other), "parts").cast("int")).drop("n", "parts"), parts


def similar_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the materialized ``pairs`` whose texts have a similarity of THRESHOLD or more, computed exactly from all shingles.

    Texts are fetched by a shuffle for each side, in which a record with many partners is split.
    """
    used = []
    both = pairs
    for side in ("a", "b"):
        both, parts = _salts(both, side)
        used.append(parts)
    both = materialize(both, "salted")
    used.append(both)
    for side, parts in zip(("a", "b"), used):
        texts = docs.select(F.col("did").alias(side), F.col("text").alias(f"t{side}")).join(parts, side)
        texts = texts.select(side, f"t{side}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{side}"))
        both = both.join(texts, [side, f"part_{side}"])
    both = both.select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(did: int, text: str) -> np.ndarray:
            if did not in kept:
                if len(kept) > 4000:
                    kept.clear()
                kept[did] = shingles(text)
            return kept[did]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = [similarity(of(i, x), of(j, y)) >= THRESHOLD for i, j, x, y in zip(a, b, ta, tb)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = materialize(both.mapInArrow(verify, "a long, b long"), "links")
    release(*used)
    return links


def near_duplicates(df: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """``group, id, rep_id, links`` of each record of a set of at least two that is closed under similarity within ``group``.

    ``rep_id`` is the set's smallest id; ``links`` counts the similar texts found directly. Records with equal reduced text are
    one record in the search and come out as members all the same. Null texts and texts of fewer than MIN_LENGTH reduced
    characters have no row.
    """
    rows = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), reduced(F.col(text_col)).alias("text")).where(F.char_length("text") >= MIN_LENGTH)
    rows = materialize(rows.select("*", *digest(F.col("group"), F.col("text"))), "reduced")
    docs = rows.groupBy("group", "k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    docs = materialize(docs.withColumn("did", F.monotonically_increasing_id()), "docs")
    # the records of a node are compared with its leaders
    sketch = sketches(docs)
    pairs = _stars(sketch)
    links = similar_pairs(pairs, docs)
    labels = materialize(minimum_labels(links), "labels")
    # then all records of a node that are not of one class by now
    met = _open_pairs(sketch, labels)
    release(sketch)
    more = materialize(met.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    release(met, pairs)
    if not more.isEmpty():
        links = links.union(similar_pairs(more, docs))
        release(labels)
        labels = materialize(minimum_labels(links), "labels")
    release(more)
    degree = links.select(F.explode(F.array("a", "b")).alias("did")).groupBy("did").agg(F.count(F.lit(1)).alias("links"))
    known = docs.select("did", "group", "k1", "k2", "first_id", "copies").join(labels, docs["did"] == labels["node"], "left").drop("node")
    known = materialize(known.join(degree, "did", "left").withColumn("label", F.coalesce("label", "did")), "known")
    sets = known.groupBy("label").agg(F.min("first_id").alias("rep_id"), F.sum("copies").alias("size")).where("size > 1")
    named = known.join(sets, "label").select("group", "k1", "k2", "copies", "rep_id", F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "named")
    total = named.agg(F.sum("copies")).first()[0] or 0
    return hot_aware_join(rows.select("group", "id", "k1", "k2"), named, ["group", "k1", "k2"], "copies", total).select(F.col("group").alias(group), "id", "rep_id", "links")
