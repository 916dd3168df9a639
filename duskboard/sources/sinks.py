"""Outputs: agendas by page. Curated events go to versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Writes every (locale, list) agenda to its own folder, in reading order inside each file."""
    (
        df.hint("rebalance", "locale", "list_slug", "logical_date")
        .sortWithinPartitions("locale", "list_slug", "logical_date", "time_key", "event_id", "session_pos")
        .write.mode("overwrite")
        .partitionBy("locale", "list_slug")
        .format(fmt)
        .save(path)
    )
