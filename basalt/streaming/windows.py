"""Event-time windows in batch and as Structured Streaming, change application by micro-batch, and schedules as triggers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load
from basalt.sources.shared import shared_folder


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables have TIMESTAMP_NTZ."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, *keys: str) -> DataFrame:
    """start, keys, n and total of events(ts, value) by fixed windows."""
    return sliding(events, size, size, *keys)


def sliding(events: DataFrame, size: str, slide: str, *keys: str) -> DataFrame:
    grouped = _timed(events).groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """start, end, keys and n of runs of events with pauses shorter than gap."""
    grouped = _timed(events).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n")


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A file-source stream of one table of a data directory."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed_stream(events: DataFrame, size: str, lateness: str, *keys: str) -> DataFrame:
    """Tumbling windows of a stream; rows later than lateness are dropped, and state with them."""
    marked = _timed(events).withWatermark("ts", lateness)
    return marked.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def deduplicated_stream(events: DataFrame, lateness: str, *keys: str) -> DataFrame:
    return _timed(events).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, into an in-memory table: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, appended to a Parquet table in the shared folder: windows are written once the watermark has passed their end."""
    folder = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """CDC: every micro-batch goes to apply(batch, number); a retried batch has the same number, so apply can skip it."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_EVERY = re.compile(r"EVERY\s+(\d+)\s+(SECOND|MINUTE|HOUR|DAY|WEEK)S?$", re.I)


def schedule_trigger(schedule: str) -> dict:
    """EVERY n unit as a processing-time trigger, ONE TIME as availableNow."""
    if schedule.strip().upper() in ("ONE TIME", "ONCE"):
        return {"availableNow": True}
    m = _EVERY.match(schedule.strip())
    if not m:
        raise ValueError(f"not a schedule: {schedule}")
    return {"processingTime": f"{m[1]} {m[2].lower()}s"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


OPERATORS["window_tumbling"] = Operator(lambda spark, d: tumbling(_events(spark, d), "1 hour", "event_type").withColumn("total", F.round("total", 4)),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "2.12")
OPERATORS["window_sliding_time"] = Operator(lambda spark, d: sliding(_events(spark, d), "2 hours", "1 hour").withColumn("total", F.round("total", 4)),
    "SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, value FROM events, (VALUES (0), (1)) v(k)) GROUP BY start", "2.12")
OPERATORS["window_session"] = Operator(lambda spark, d: sessions(_events(spark, d), "30 minutes", "user_id"),
    "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s", "2.12")
OPERATORS["stream_daily_counts"] = Operator(
    lambda spark, d: run_to_table(windowed_stream(event_stream(spark, d), "1 day", "1 hour", "event_type"), "stream_daily_counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", "2.12")
