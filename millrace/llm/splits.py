"""Problem 5: train, validation and test splits that keep related records together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import minimum_labels
from millrace.operators.skew import HOT_SHARE, hot_aware_join
from millrace.session import materialize


def entity_key(column: Column) -> Column:
    """An entity's name without outer blanks and letter case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def tied_groups(df: DataFrame, id_col: str, entity_col: str) -> DataFrame:
    """``id, group_key, members`` for each distinct id that has an entity: the smallest entity of its tied set and the set's ids.

    Labels spread over the bipartite record-entity graph: an entity takes the smallest label of its records, a record that of
    its entities. A record with one entity can pass nothing on, so only records with several entities take part in the rounds;
    all others read their entity's label at the end. Hot entities are joined hot-aware. Null ids and ids without an entity have
    no row.
    """
    pairs = df.select(F.col(id_col).alias("id"), entity_key(F.col(entity_col)).alias("e")).dropna().distinct()
    pairs = materialize(pairs, "record-entity")
    low = pairs.groupBy("id").agg(F.min("e").alias("a"), F.max("e").alias("z")).where("a <> z")
    links = pairs.join(low, "id").select("a", F.col("e").alias("b")).where("a <> b").distinct()
    labels = minimum_labels(links)
    sizes = pairs.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    entities = sizes.join(labels, sizes["e"] == labels["node"], "left").select("e", "n", F.coalesce("label", "e").alias("group_key"))
    entities = materialize(entities, "entity-label")
    joined = hot_aware_join(pairs, entities, ["e"], "n", max(pairs.count(), 1))
    ids = materialize(joined.groupBy("id").agg(F.min("group_key").alias("group_key")), "tied-ids")
    members = materialize(ids.groupBy("group_key").agg(F.count(F.lit(1)).alias("members")), "tied-sizes")
    return hot_aware_join(ids, members, ["group_key"], "members", max(ids.count(), 1))


def assign_splits(
    df: DataFrame, id_col: str, entity_col: str, stratum_col: str, shares: Mapping[str, float] | None = None, buckets: int = 4096
) -> DataFrame:
    """``id, group_key, split`` for each distinct non-null id: groups of :func:`tied_groups` never cross a split.

    Ids without an entity are groups of their own. Groups with more than a thousandth of the ids stand alone (fewer than a
    thousand); the others fall by hash into ``buckets`` parcels. Parcels and large groups, described by their counts of each
    label of ``stratum_col`` (its smallest value for an id; ``buckets + 1000`` rows at most, with the thousand largest labels),
    are then placed largest first where the split stays closest to its share of every label. Ties go to the first split.
    """
    shares = dict(shares or {"train": 0.8, "validation": 0.1, "test": 0.1})
    every = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(stratum_col).cast("string")).alias("s"))
    tied = tied_groups(df, id_col, entity_col)
    ids = every.join(tied, "id", "left").select(
        "id", F.coalesce("s", F.lit("")).alias("s"), "group_key", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("group_key", F.concat(F.lit("id "), F.col("id").cast("string"))).alias("g")
    )
    ids = materialize(ids, "split-ids")
    total = ids.count()
    parcel = F.when(F.col("members") * HOT_SHARE > total, F.concat(F.lit("g "), F.col("g"))).otherwise(F.concat(F.lit("p "), F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("string")))
    ids = ids.withColumn("parcel", parcel)
    labels = [r["s"] for r in ids.groupBy("s").count().orderBy(F.desc("count"), "s").limit(HOT_SHARE).collect()]
    counts: dict[str, dict[str, int]] = {}
    for r in ids.withColumn("s", F.when(F.col("s").isin(labels[:HOT_SHARE]), F.col("s"))).groupBy("parcel", "s").count().collect():
        counts.setdefault(r["parcel"], {})[r["s"]] = r["count"]
    whole: dict = {}
    for c in counts.values():
        for s, n in c.items():
            whole[s] = whole.get(s, 0) + n
    have = {k: dict.fromkeys(whole, 0) for k in shares}
    placed = []
    for name, c in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), x[0])):

        def gain(split: str, c: dict = c) -> float:
            # fall of the distance (chi-square) from the split's share of all ids, and of each label
            size, got = shares[split], sum(have[split].values())
            want = size * total
            change = len(whole) * ((got + sum(c.values()) - want) ** 2 - (got - want) ** 2) / max(want, 1)
            for s, n in c.items():
                goal = size * whole[s]
                change += ((have[split][s] + n - goal) ** 2 - (have[split][s] - goal) ** 2) / max(goal, 1)
            return change

        best = min(shares, key=gain)
        for s, n in c.items():
            have[best][s] += n
        placed.append((name, best))
    where = df.sparkSession.createDataFrame(placed, "parcel string, split string")
    return ids.join(F.broadcast(where), "parcel").select("id", "group_key", "split")
