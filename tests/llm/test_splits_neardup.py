import random
from collections import defaultdict

import pytest

from millrace.llm import near_duplicates as nd
from millrace.llm import splits


def union(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return find


def test_tied_groups_and_splits(spark):
    r = random.Random(2)
    rows = [(i, f" T{r.randrange(60)} " if r.random() < 0.7 else r.choice([None, "", "  "]), r.choice(["a", "b", None])) for i in range(150) for _ in range(r.choice([1, 1, 2]))]
    rows += [(1000 + i, "HOT", "a") for i in range(90)] + [(None, "t1", "a"), (1, "T1", "b"), (1, "T1", "b")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, tpl string, s string, e string")
    key = lambda t: (t or "").strip().lower()
    ids = {i for i, t, _ in rows if i is not None and key(t)}
    by = defaultdict(set)
    for i, t, _ in rows:
        if i is not None and key(t):
            by[key(t)].add(i)
    find = union([(min(g), x) for g in by.values() for x in g], ids)
    low = defaultdict(list)
    for t, g in by.items():
        low[find(min(g))].append(t)
    got = {x["id"]: (x["group_key"], x["members"]) for x in splits.tied_groups(df, "id", "tpl").collect()}
    size = defaultdict(int)
    for i in ids:
        size[find(i)] += 1
    assert got == {i: (min(low[find(i)]), size[find(i)]) for i in ids}
    out = splits.assign_splits(df, "id", "tpl", "s").collect()
    assert len(out) == len({i for i, _, _ in rows if i is not None})
    where = defaultdict(set)
    for x in out:
        where[x["group_key"] or x["id"]].add(x["split"])
    assert all(len(s) == 1 for s in where.values())
    assert splits.tied_groups(df.limit(0), "id", "tpl").count() == 0 and splits.assign_splits(df.limit(0), "id", "tpl", "s").count() == 0


def test_split_shares_with_uneven_groups_and_rare_labels(spark):
    """Large groups and a rare label pull no split away from its share of all ids."""
    r = random.Random(8)
    rows, i = [], 0
    for size in [230, 120, 90, 60, 40, 30] + [r.choice([1, 1, 2, 3]) for _ in range(1800)]:
        rows += [(i + k, f"t{i}", r.choice(["x"] * 12 + ["y"] * 3 + ["z"])) for k in range(size)]
        i += size
    df = spark.createDataFrame(rows, "id long, tpl string, s string")
    got = {x["split"]: x["count"] / len(rows) for x in splits.assign_splits(df, "id", "tpl", "s").groupBy("split").count().collect()}
    assert all(abs(got[k] - v) < 0.01 for k, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_split_shares(spark):
    df = spark.range(4000).selectExpr("id", "concat('t', id div 2) tpl", "case when id % 4 = 0 then 'x' else 'y' end s")
    n = {(r["split"], r["s"]): r["count"] for r in splits.assign_splits(df, "id", "tpl", "s").join(df, "id").groupBy("split", "s").count().collect()}
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        for s, total in (("x", 1000), ("y", 3000)):
            assert abs(n[split, s] / total - share) < 0.02


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(45)]
        for _ in range(r.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    hot = [r.choice(words) for _ in range(60)]
    for k in range(60):  # a family too large for one node at any level
        copy = list(hot)
        copy[k % 60] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", "short text", " ".join(r.choice(words) for _ in range(20_000))]
    df = spark.createDataFrame([("t", i, t, 7) for i, t in enumerate(texts)], "tab string, id long, text string, did int")
    got = {x["id"]: x["rep_id"] for x in nd.near_duplicates(df, "tab", "id", "text").collect()}
    clean = {i: "".join(c for c in t.lower() if c.isalnum()) for i, t in enumerate(texts) if t}
    clean = {i: c for i, c in clean.items() if len(c) >= nd.MIN_LENGTH}
    sets = {i: {c[k : k + 8] for k in range(len(c) - 7)} for i, c in clean.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    find = union(links, sets)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    want = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    assert sum(want.get(i) != got.get(i) for i in set(want) | set(got)) <= 0.01 * len(want)
    assert nd.near_duplicates(df.limit(0), "tab", "id", "text").count() == 0


def linked(texts):
    """Brute force: the smallest index of each text's set."""
    sets = [{t[k : k + 8] for k in range(len(t) - 7)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    find = union(links, range(len(sets)))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


@pytest.mark.parametrize("node", [1024, 10])
def test_near_duplicates_of_one_node_are_all_compared(spark, monkeypatch, node):
    """Similar records that meet in a single node, whose smallest record is unlike them, are found; in small and large nodes."""
    r = random.Random(9)
    new = lambda n: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(n))
    for families in (2, 90):
        texts = [new(200)] + [t for _ in range(families) for base in [new(240)] for t in (base, base[:60] + new(20) + base[80:])]
        texts += [base[:k] + "z" + base[k + 1 :] for base in [new(300)] for k in range(families)]
        df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, id long, text string")
        from pyspark.sql import functions as F

        def one_node(sketch):
            return sketch.select(F.lit(1).cast("long").alias("node"), *nd._RECORD)

        def one_node_sketches(docs, make=nd.sketches):
            return make(docs).withColumn("nodes", F.array(F.lit(1).cast("long")))

        monkeypatch.setattr(nd, "first_rows", one_node)
        monkeypatch.setattr(nd, "sketches", one_node_sketches)
        monkeypatch.setattr(nd, "NODE", node)
        monkeypatch.setattr(nd, "LEVELS", 1)
        assert {x["id"]: x["rep_id"] for x in nd.near_duplicates(df, "tab", "id", "text").collect()} == linked(texts)


def test_near_duplicates_just_above_the_threshold(spark):
    """Isolated pairs whose edits are spread evenly (one in 34 characters: similarity 0.61 to 0.65) are all found."""
    r = random.Random(5)
    texts = []
    for k in range(300):
        base = [r.choice("abcdefghijklmnopqrst") for _ in range(240 if k % 2 else 480)]
        copy = list(base)
        for i in range(33, len(base), 34):
            copy[i] = "z"
        texts += ["".join(base), "".join(copy)]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, id long, text string")
    want = {i: i - i % 2 for i in range(len(texts))}
    assert all(nd.similarity(nd.shingles(texts[i]), nd.shingles(texts[i + 1])) >= nd.THRESHOLD for i in range(0, len(texts), 2))
    assert {x["id"]: x["rep_id"] for x in nd.near_duplicates(df, "tab", "id", "text").collect()} == want


def test_near_duplicates_under_a_common_sentence(spark, monkeypatch):
    """Many unlike records share a sentence, so that their nodes go down several levels; the pairs among them are found."""
    r = random.Random(6)
    new = lambda n: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(n))
    footer = new(120)
    monkeypatch.setattr(nd, "NODE", 16)
    texts = [t + footer for _ in range(150) for base in [new(180)] for t in (base, base[:90] + "z" + base[91:])]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, id long, text string")
    assert {x["id"]: x["rep_id"] for x in nd.near_duplicates(df, "tab", "id", "text").collect()} == linked(texts)


def test_trees_and_signatures_keep_their_recall():
    """Values of a pair agree as often as its similarity says, signatures of similar pairs pass, and the trees give the recall stated."""
    r = random.Random(3)
    texts = []
    for _ in range(400):
        base = [r.choice("abcdefghijklmnopqrst") for _ in range(r.choice([130, 400, 2000]))]
        copy = list(base)
        for i in range(33, len(base), 34):
            copy[i] = "z"
        texts += ["".join(base), "".join(copy)]
    m = nd.minwise(texts)
    equal = (m[::2] == m[1::2]).mean()
    real = sum(nd.similarity(nd.shingles(a), nd.shingles(b)) for a, b in zip(texts[::2], texts[1::2])) / 400
    assert abs(equal - real) < 0.02 and len(set(m[::2].ravel().tolist())) > 0.5 * m[::2].size
    assert 1 - (1 - nd.survival(nd.LEVELS)) ** nd.TREES >= nd.RECALL and 1 - (1 - nd.survival(1)) ** nd.TREES > 0.9998
    assert nd.least_equal() < nd.BINS * (nd.THRESHOLD + (1 - nd.THRESHOLD) / 16)
