"""Pieces of the SQL that checks the queries: the views of the tables, and values bound the same way on both sides."""

from __future__ import annotations

#: The moment that ages are measured to, and the length of the vectors.
MOMENT, DIM = "2026-01-01 00:00:00", 64

MEMORIES = """m AS (
  SELECT * REPLACE (coalesce(kind, 'MEMORY') AS kind, coalesce(temporal_stability, 'unknown') AS temporal_stability,
                    coalesce(reinforce_count, 0) AS reinforce_count)
  FROM memories WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen_at DESC NULLS LAST, reinforce_count DESC NULLS LAST) = 1)"""


def _distinct(name: str, table: str, key: str, order: str, replace: str = "") -> str:
    return (
        f"{name} AS (SELECT * {replace} FROM {table} WHERE {key} IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC NULLS LAST) = 1)"
    )


VIEWS = {
    "m": MEMORIES,
    "e": _distinct("e", "entities", "id", "created_at"),
    "g": _distinct("g", "edges", "edge_id", "t_created", "REPLACE (coalesce(weight, 1.0) AS weight)"),
    "v": _distinct("v", "memory_events", "event_id", "occurred_at"),
    "c": _distinct("c", "chunks", "chunk_id", "created_at"),
    "s": _distinct("s", "sources", "source_id", "ingested_at"),
}


def query(views: str, body: str, *more: str) -> str:
    """``body`` with the named views (one letter each) and further common tables before it."""
    return "WITH " + ",\n".join([*(VIEWS[v] for v in views), *more]) + "\n" + body


#: The query vector: that of the smallest id of a summary that has a usable one.
QUERY_VECTOR = f"""q AS (SELECT content_embedding::DOUBLE[] AS qv FROM m
  WHERE len(content_embedding) = {DIM} AND CASE WHEN len(content_embedding) = {DIM} THEN list_dot_product(content_embedding, content_embedding) > 0 END ORDER BY id LIMIT 1)"""


def similarity(column: str, query_column: str = "qv") -> str:
    """Cosine of two vectors of which only usable ones are compared."""
    return (
        f"CASE WHEN len({column}) = {DIM} THEN CASE WHEN list_dot_product({column}, {column}) > 0 "
        f"THEN list_cosine_similarity({column}::DOUBLE[], {query_column}) END END"
    )


DAYS = f"(epoch_us(TIMESTAMPTZ '{MOMENT}+00') - epoch_us({{0}})) / 86400000000.0"

#: Reinforcement multiplier of each memory with reinforcing events.
STRENGTH = f"""w AS (
  SELECT memory_id AS id, exp(-({DAYS.format("occurred_at")}) / 21.0) *
    CASE WHEN (epoch_us(lag(occurred_at) OVER (PARTITION BY memory_id ORDER BY occurred_at DESC, event_id DESC))
               - epoch_us(occurred_at)) / 3600000000.0 < 24.0 THEN 0.2 ELSE 1.0 END AS weight
  FROM v WHERE memory_id IS NOT NULL AND occurred_at IS NOT NULL AND starts_with(event_type, 'REINFORCE')),
strength AS (SELECT id, 1 + 0.35 * ln(1 + sum(weight)) AS reinforcement, count(*) AS reinforcements FROM w GROUP BY id)"""

DEGREES = """degrees AS (SELECT id, count(*) AS degree FROM (
  SELECT to_node AS id FROM g WHERE t_expired IS NULL UNION ALL SELECT memory_id FROM v) WHERE id IS NOT NULL GROUP BY id)"""

BOOST = "CASE WHEN degree > 0 THEN 1 + 0.15 * ln(1 + degree) ELSE 1.0 END"

CONFIDENCE = f"""CASE WHEN temporal_stability IN ('static', 'unknown') OR coalesce(t_valid, created_at) IS NULL
    OR {DAYS.format("coalesce(t_valid, created_at)")} < 0 THEN 1.0
  ELSE greatest(0.01, exp(-({DAYS.format("coalesce(t_valid, created_at)")}) /
    CASE WHEN temporal_stability = 'ephemeral' THEN 7.0 ELSE 90.0 END)) END"""
