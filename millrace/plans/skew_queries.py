"""Problem 4: a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import skew
from millrace.plans.registry import query
from millrace.sources.tables import table

#: A key is reported if it holds at least this share of all rows (or of all occurrences).
REPORTED_SHARE = 0.02


@query(
    """
select 'ip' key_name, ip key_value from submissions where ip is not null group by ip having count(*) >= 0.02 * (select count(*) from submissions)
union all
select 'signature_hash', signature_hash from signatures where signature_hash is not null group by signature_hash having sum(occurrence) >= 0.02 * (select sum(occurrence) from signatures)"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ips = skew.heavy_keys(table(spark, d, "submissions").select("ip"), "ip", None, REPORTED_SHARE)
    hashes = skew.heavy_keys(table(spark, d, "signatures").select("signature_hash", "occurrence"), "signature_hash", "occurrence", REPORTED_SHARE)
    return ips.select(F.lit("ip").alias("key_name"), F.col("ip").alias("key_value")).unionByName(
        hashes.select(F.lit("signature_hash").alias("key_name"), F.col("signature_hash").alias("key_value"))
    )


@query(
    """
select ip, count(*) as rows, cast(epoch_us(min(created_at)) as bigint) first_us, cast(epoch_us(max(created_at)) as bigint) last_us,
  count(distinct normalized_text) forms from submissions where ip is not null group by ip"""
)
def p4_ip_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last time and distinct texts of every ip."""
    s = table(spark, d, "submissions").select("ip", "created_at", "normalized_text")
    p = skew.key_profile(s, "ip", distinct="normalized_text", time="created_at")
    return p.select("ip", "rows", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "forms")


@query(
    """
with v as (select ip, server_received_ms v, row_number() over (partition by ip order by server_received_ms) r, count(*) over (partition by ip) n
  from submissions where ip is not null and server_received_ms is not null), p as (select unnest([0.25, 0.5, 0.95]) prob)
select ip, cast(prob as double) prob, v as value from v, p where r = greatest(cast(ceil(cast(prob as double) * n) as bigint), 1)"""
)
def p4_ip_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartile, median and 95th percentile of the arrival time of every ip."""
    return skew.exact_quantiles(table(spark, d, "submissions"), "ip", "server_received_ms", [0.25, 0.5, 0.95])


@query(
    """
select signature_hash, sum(coalesce(occurrence, 0))::bigint weight, round(sum(coalesce(occurrence, 0)) / (select sum(occurrence) from signatures), 9) as share
from signatures where signature_hash is not null group by signature_hash"""
)
def p4_occurrence_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each signature's share of all occurrences."""
    p = skew.key_profile(table(spark, d, "signatures").select("signature_hash", "occurrence"), "signature_hash", F.col("occurrence"))
    return p.select("signature_hash", "weight", F.round("share", 9).alias("share"))
