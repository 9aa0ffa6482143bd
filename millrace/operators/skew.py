"""Operators for keys of which a few hold most rows: hot-aware joins, group representatives, exact per-key quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

#: A key is hot if it holds more than one HOT_SHARE-th of the rows, so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 1000
#: Fewer rows than this are no burden for a task, whatever their share.
LEAST_HOT = 100_000


def hot_aware_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """``rows`` inner-joined to ``lookup`` (unique on ``keys``; column ``count`` has the rows of each key).

    Keys with more than total/share rows are fewer than ``share``, whatever the data: they are joined by broadcast, so their
    rows stay where they are. The others are joined by a shuffle in which no key exceeds total/share rows. Null keys match
    nothing. ``total`` is at least the sum of all counts (a smaller one that makes more keys hot than ``share`` is an error).
    ``lookup`` is read up to three times, ``rows`` twice if there are hot keys; both should be cheap to read.
    """
    keys = list(keys)
    is_hot = F.col(count) * share > total
    n = lookup.where(is_hot).count()
    if n == 0:
        return rows.join(lookup, keys)
    if n > share:
        raise ValueError(f"{n} keys hold more than 1/{share} of {total} rows each: total is too small")
    hot = F.broadcast(lookup.where(is_hot))
    cold = lookup.where(~is_hot)
    few = rows.join(hot, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return few.unionByName(rest)


def hot_aware_left_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, least: int = LEAST_HOT) -> DataFrame:
    """Every row of ``rows`` with the columns of ``lookup`` (unique on ``keys``), null where it has no such key.

    Keys with more than one share-th of the rows, fewer than ``share``, and more than ``least`` rows are joined by broadcast; rows with
    a null key match nothing and are not shuffled either. ``rows`` is read up to four times and should be cheap to read.
    """
    keys = list(keys)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    marked = rows.where(~null).withColumn("_hk", F.xxhash64(*keys))
    counts = marked.groupBy("_hk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    total = marked.count() if not counts.isEmpty() else 0
    hot = [r["_hk"] for r in counts.where(F.col("n") * share > total).collect()] if total else []  # fewer than share
    lookup = lookup.dropDuplicates(keys).withColumn("_hk", F.xxhash64(*keys))
    is_hot = F.col("_hk").isin(hot) if hot else F.lit(False)
    cold = marked.where(~is_hot).drop("_hk").join(lookup.where(~is_hot).drop("_hk"), keys, "left")
    out = cold.unionByName(rows.where(null), allowMissingColumns=True)
    if hot:
        out = out.unionByName(marked.where(is_hot).drop("_hk").join(F.broadcast(lookup.where(is_hot).drop("_hk")), keys, "left"))
    return out


def members_of_groups(rows: DataFrame, keys: Sequence[str], id_col: str, extra: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Every row of a group of at least two rows, with ``rep_id`` (the group's smallest id), ``copies`` and ``extra`` aggregates.

    Groups are formed by partial aggregation; members find their group by :func:`hot_aware_join`, so that a group with a
    third of all rows is never gathered. Groups whose key has a null are left out.
    """
    keys = list(keys)
    rows = materialize(rows.select(*keys, id_col, *keep), "members")
    groups = materialize(
        rows.dropna(subset=keys).groupBy(*keys).agg(F.min(id_col).alias("rep_id"), F.count(F.lit(1)).alias("copies"), *extra).where("copies > 1"), "groups"
    )
    return hot_aware_join(rows, groups, keys, "copies", max(rows.count(), 1))


def digest(*columns: Column) -> list[Column]:
    """Two 64-bit integers that together stand for the values of ``columns`` (128 bits, seeds differ)."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(0x5EED), *columns).alias("k2")]


def key_profile(df: DataFrame, key: str, weight: Column | None = None, distinct: str | None = None, time: str | None = None) -> DataFrame:
    """One row a key: ``rows``, ``weight``, ``share`` of all weight and, if asked, ``first``, ``last`` and ``forms``.

    All measures are mergeable, so each map task hands on one row a key; distinct forms are counted in two steps, first to
    one row a (key, form). Rows with a null key count in the total of ``share`` but have no row of their own.
    """
    w = F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(1)
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(F.lit(0) + w).cast("long").alias("weight")]
    if time:
        aggs += [F.min(time).alias("first"), F.max(time).alias("last")]
    if distinct:
        step = df.groupBy(key, F.xxhash64(distinct).alias("_f"), F.col(distinct).isNull().alias("_n")).agg(*aggs)
        outer = [F.sum("rows").alias("rows"), F.sum("weight").alias("weight")]
        outer += [F.min("first").alias("first"), F.max("last").alias("last")] if time else []
        grouped = step.groupBy(key).agg(*outer, F.count_if(~F.col("_n")).alias("forms"))
    else:
        grouped = df.groupBy(key).agg(*aggs)
    grouped = materialize(grouped, "key-profile")
    total = grouped.agg(F.sum("weight")).first()[0] or 0
    share = F.col("weight") / F.lit(float(total)) if total else F.lit(0.0)
    return grouped.where(F.col(key).isNotNull()).withColumn("share", share.cast("double"))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], bins: int = 256, share: int = HOT_SHARE) -> DataFrame:
    """Exact per-key quantiles (``key, prob, value``) of an integer column: the value of rank ceil(prob * n), 1 at least.

    Keys with at most total/share rows are ranked by running counts over a global order of key and value, cut into ranges, so that
    no key is in one task as a whole. Hot keys, of which there are fewer than ``share``,
    are solved by distributed selection: each round counts the values of every open interval in ``bins`` equal bins by partial
    aggregation, keeps the bin that holds the rank, and ends when bins are one value wide; values of a hot key are never
    gathered. A 64-bit range takes at most eight rounds. Null values take no part; a key without values has no row.
    """
    spark = df.sparkSession
    rows = materialize(df.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_v")).dropna(), "quantile-rows")
    counts = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    ps = sorted(set(probs))
    prob_col = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("prob")
    hot = counts.where(F.col("_n") * share > total)  # fewer than share
    cold_rows = rows.join(F.broadcast(hot.select("_key")), "_key", "left_anti")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cold_rows.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c")).repartitionByRange(parts, "_key", "_v").withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "quantile-ranges")
    # a key has one row for each range it lies in
    w = Window.partitionBy("_key")
    pieces = ranged.groupBy("_key", "_p").agg(F.sum("_c").alias("_m"))
    before = F.coalesce(F.sum("_m").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_key", "_p", before.alias("_before"), F.sum("_m").over(w).alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_key", "_p").orderBy("_v")) + F.col("_before")
    ranked = ranged.join(pieces, ["_key", "_p"]).select("_key", "_v", "_c", "_n", upto.alias("_r"))
    rank = F.greatest(F.ceil(F.col("prob") * F.col("_n")), F.lit(1)).cast("long")
    cold = ranked.select("*", prob_col).where((F.col("_r") >= rank) & (F.col("_r") - F.col("_c") < rank)).select("_key", "prob", F.col("_v").alias("value"))

    # Driver state: one interval for each (hot key, prob), fewer than share * len(probs).
    state = {(r["_key"], p): [r["_lo"], r["_hi"], max(1, -int(-(p * r["_n"]) // 1))] for r in hot.collect() for p in ps}
    key_type = df.schema[key].dataType.simpleString()
    hot_rows = materialize(rows.join(F.broadcast(hot.select("_key")), "_key"), "quantile-hot") if state else None
    while open_ := {k: v for k, v in state.items() if v[0] < v[1]}:
        todo = [(k, p, Decimal(lo), Decimal(hi), Decimal(-(-(hi - lo + 1) // bins))) for (k, p), (lo, hi, _) in open_.items()]
        todo = spark.createDataFrame(todo, f"_key {key_type}, prob double, lo decimal(20,0), hi decimal(20,0), width decimal(20,0)")
        joined = hot_rows.join(F.broadcast(todo), "_key").where("_v between lo and hi")
        binned = joined.select("_key", "prob", F.floor((F.col("_v").cast("decimal(20,0)") - F.col("lo")) / F.col("width")).cast("long").alias("bin"))
        found: dict = {}
        for r in binned.groupBy("_key", "prob", "bin").agg(F.count(F.lit(1)).alias("n")).collect():  # at most bins rows an interval
            found.setdefault((r["_key"], r["prob"]), []).append((r["bin"], r["n"]))
        for k, (lo, hi, want) in open_.items():
            width, seen = -(-(hi - lo + 1) // bins), 0
            for b, n in sorted(found[k]):
                if seen + n >= want:
                    state[k] = [lo + b * width, min(hi, lo + (b + 1) * width - 1), want - seen]
                    break
                seen += n
    solved = spark.createDataFrame([(k, p, v[0]) for (k, p), v in state.items()], f"_key {key_type}, prob double, value long")
    return cold.unionByName(solved).withColumnRenamed("_key", key)


def heavy_keys(df: DataFrame, key: str, weight: str | None = None, share: float = 0.02, bins: int = 4096) -> DataFrame:
    """``key, weight, share`` of every key that holds at least ``share`` of all rows, or of the sum of ``weight``; exact.

    The histogram of hashed keys is refined round by round with mergeable counts: a bin that holds less than ``share`` of the
    total can hold no such key and is dropped, so at most 1/share bins stay, and each is split into ``bins`` bins of the next
    round until it holds one hash. Only then are rows counted by key, so the long tail of keys is never shuffled, and no more
    than bins/share counts reach the driver. Null keys count in the total but are not reported; null weights count as 0, and
    weights must not be negative. An empty table or a total of 0 gives no rows.
    """
    w = F.coalesce(F.col(weight).cast("decimal(20,0)"), F.lit(0)) if weight else F.lit(1)
    rows = df.select(F.col(key), w.cast("decimal(20,0)").alias("_w"), F.shiftrightunsigned(F.xxhash64(key), 4).alias("_h"))
    total = rows.agg(F.sum("_w")).first()[0] or 0
    empty = rows.select(key, F.col("_w").cast("long").alias("weight"), F.lit(0.0).alias("share")).limit(0)
    if not total:
        return empty
    bits = max(1, bins.bit_length() - 1)
    rows = rows.where(F.col(key).isNotNull())
    at, found, shift = rows, [], 60
    while at is not None and shift > 0:
        shift = max(0, shift - bits)
        binned = at.groupBy(F.shiftrightunsigned("_h", shift).alias("b")).agg(F.sum("_w").alias("w"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        heavy = binned.where(F.col("w") >= F.lit(float(share)) * F.lit(float(total))).collect()
        found += [r["lo"] for r in heavy if r["lo"] == r["hi"]]
        mixed = [r["b"] for r in heavy if r["lo"] != r["hi"]]
        at = rows.where(F.shiftrightunsigned("_h", shift).isin(mixed)) if mixed else None
    if not found:
        return empty
    counted = rows.where(F.col("_h").isin(found)).groupBy(key).agg(F.sum("_w").cast("long").alias("weight"))
    return counted.withColumn("share", F.col("weight") / F.lit(float(total))).where(F.col("share") >= share)
