"""Append-only event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.functions.ids import stable_id

EVENT_COLUMNS = ["event_id", "event_type", "event_version", "occurred_at", "payload_json", "payload_sha256"]


def event_rows(df: DataFrame, event_type: str | Column, payload_columns: list[str] | None, occurred_at: Column,
               payload_json: Column | None = None) -> DataFrame:
    """Ledger rows of a frame: payload as JSON, its hash, version 1 and a derived id."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    payload = payload_json if payload_json is not None else F.to_json(F.struct(*payload_columns))
    return df.select(
        kind.alias("event_type"), F.lit(1).alias("event_version"), occurred_at.alias("occurred_at"),
        payload.alias("payload_json"),
    ).withColumn("payload_sha256", F.sha2("payload_json", 256)).select(
        stable_id("event", event_type=F.col("event_type"), occurred_at=(F.col("occurred_at"), "time"),
                  payload_sha256=F.col("payload_sha256")).alias("event_id"),
        *EVENT_COLUMNS[1:],
    )


def append_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT_COLUMNS).write.mode("append").parquet(path)


def write_events_jsonl(events: DataFrame, path: str) -> None:
    """One JSON object per line; the payload is an object, not quoted text."""
    payload = F.try_parse_json("payload_json").alias("payload")
    line = F.to_json(F.struct("event_id", "event_type", "event_version", F.col("occurred_at").cast("string").alias("occurred_at"), payload))
    events.select(line.alias("value")).write.mode("append").text(path)
