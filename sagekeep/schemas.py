"""Schemas of the property graph's tables, and checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMES = "t_valid timestamp, t_invalid timestamp, t_created timestamp, t_expired timestamp"

#: Columns of each table, as they are written (the text of a schema needs no session).
TABLES: dict[str, str] = {
    "memories": (
        "id string, content string, content_embedding array<float>, content_hash string, created_at timestamp, "
        f"metadata string, kind string, {_TIMES}, temporal_stability string, last_seen_at timestamp, reinforce_count int"
    ),
    "entities": (
        "id string, entity_type string, canonical_name string, norm_key string, created_at timestamp, "
        "embedding array<float>, expired_at timestamp, merged_into string, chunk_id string"
    ),
    "edges": (
        "edge_id string, from_node string, to_node string, edge_type string, weight double, confidence double, "
        f"evidence string, {_TIMES}"
    ),
    "memory_events": (
        "event_id string, memory_id string, event_type string, occurred_at timestamp, source string, actor string, "
        "artifact_ref string, payload string"
    ),
    "chunks": (
        "chunk_id string, source_id string, start_char long, length_chars long, sequence_no int, created_at timestamp"
    ),
    "sources": (
        "source_id string, source_type string, created_at timestamp, ingested_at timestamp, source_hash string, "
        "metadata string, path string, agent string, session_id string"
    ),
}

#: What must be unique, and among which rows.
KEYS = {
    "memories": [("id", None), ("content_hash", None)],
    "entities": [("id", None), ("norm_key", "expired_at IS NULL")],
    "edges": [("edge_id", None)],
    "memory_events": [("event_id", None)],
    "chunks": [("chunk_id", None)],
    "sources": [("source_id", None)],
}


def repeated_keys(df: DataFrame, key: str, among: str | None = None) -> DataFrame:
    """Keys that stand in more than one row, with their number; empty for a table that keeps its constraint."""
    rows = df.filter(among) if among else df
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each constraint: table, key, and how many keys break it."""
    report = None
    for name, frame in tables.items():
        for key, among in KEYS[name]:
            broken = repeated_keys(frame, key, among).agg(F.count(F.lit(1)).alias("broken"))
            row = broken.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_name"), "broken")
            report = row if report is None else report.unionByName(row)
    return report


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` in order, missing ones null, others dropped."""
    fields = T.StructType.fromDDL(TABLES[table]).fields
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    )
