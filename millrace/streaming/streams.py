"""Structured Streaming forms of ingest, scoring, rate limits, timelines and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import signature_hash, template_v2
from millrace.operators import rules
from millrace.operators.ingest import accepted  # noqa: F401


def scored(stream: DataFrame) -> DataFrame:
    """Each row under the rules that need nothing but the row itself."""
    own = [r for r in rules.catalogue() if r.kind not in ("repeated_pattern", "cluster_match", "rate_limit", "model_score")]
    return rules.score(stream, own)


def timeline(stream: DataFrame, ts: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Rows and trap hits by tumbling window of event time; rows later than ``delay`` are left out."""
    trapped = F.count_if(F.size("honeypot_hits") > 0)
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("total"), trapped.alias("honeypot_triggered")).select(F.col("w.start").alias("start"), "total", "honeypot_triggered")


def sliding_rate(stream: DataFrame, key: str, ts: str, width: str = "10 minutes", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows of each key in sliding windows: the bounded-state form of the rate limit."""
    return stream.withWatermark(ts, delay).groupBy(key, F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("recent")).select(key, F.col("w.end").alias("until"), "recent")


def exact_rate(stream: DataFrame, key: str, ts: str, row_id: str, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """``key, row_id, recent``: the exact trailing count of each row, itself included, by a buffer of recent times for each key.

    The state of a key holds its times in order, back to ``minutes`` before the watermark: no row that is still taken looks further
    back. It goes once the watermark has passed them all. A row counts those seen so far, of its own batch or an earlier one; rows
    without key or time are left out.
    """
    span = minutes * 60 * 1_000_000

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_us", row_id])
        new = rows["_us"].to_numpy(np.int64)
        times = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], np.int64), new]), kind="stable")
        recent = np.searchsorted(times, new, "right") - np.searchsorted(times, new - span, "left")
        kept = times[np.searchsorted(times, mark - span, "left") :] if mark > 0 else times
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(max((int(times[-1]) + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(rows), row_id: rows[row_id].to_numpy(), "recent": recent})

    kinds = {n: t for n, t in stream.dtypes}
    typed = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay).select(key, row_id, ts, F.unix_micros(ts).alias("_us"))
    return typed.groupBy(key).applyInPandasWithState(count, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, recent long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def signatures(stream: DataFrame, text: str, ts: str) -> DataFrame:
    """Occurrence, first and last event time of each template; update mode, the same after a replay."""
    rows = stream.where(F.col(text).isNotNull()).select(ts, template_v2(F.col(text)).alias("pattern")).where("pattern <> ''")
    return rows.groupBy(signature_hash(F.col("pattern")).alias("signature_hash"), "pattern").agg(F.count(F.lit(1)).alias("occurrence"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def quiet_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key, closed by a gap without rows."""
    return stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("rows")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run all that is there into an in-memory table and stop; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def into_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a Parquet folder, exactly once."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_batch(df: DataFrame, write, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """``write(batch, number)`` for each micro-batch: upserts, events and metrics."""
    return df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
