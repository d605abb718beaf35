"""Queries of the reference check (problem 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagekeep.operators.references import EDGE_TARGETS, graph_orphans, orphan_report


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return graph_orphans(spark, root)


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(graph_orphans(spark, root))


def _case(side: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[side]}'" for k, v in EDGE_TARGETS.items())
    return f"CASE upper(trim(edge_type)) {whens} END"


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))"

_FOUND = f"""
WITH parents AS (
  SELECT target, key, min(created) AS created, min(ended) AS ended FROM (
    SELECT 'memories' AS target, lower(trim(id)) AS key, created_at AS created, t_expired AS ended FROM memories
    UNION ALL SELECT 'entities', lower(trim(id)), created_at, expired_at FROM entities
    UNION ALL SELECT 'chunks', lower(trim(chunk_id)), created_at, NULL FROM chunks
    UNION ALL SELECT 'sources', lower(trim(source_id)), created_at, NULL FROM sources
  ) GROUP BY target, key
), refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, 'from_node' AS ref_field, t_created AS moment, {_case(0)} AS target,
         lower(trim(from_node, {_BLANKS})) AS key FROM edges
  UNION ALL SELECT 'edges', edge_id, 'to_node', t_created, {_case(1)}, lower(trim(to_node, {_BLANKS})) FROM edges
  UNION ALL SELECT 'memory_events', event_id, 'memory_id', occurred_at, 'memories', lower(trim(memory_id, {_BLANKS}))
            FROM memory_events
  UNION ALL SELECT 'entities', id, 'chunk_id', created_at, 'chunks', lower(trim(chunk_id, {_BLANKS})) FROM entities
), judged AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, strftime(timezone('UTC', moment), '%Y-%m') AS period,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN p.created > moment THEN 'late' WHEN p.ended < moment THEN 'deleted' END AS reason
  FROM refs LEFT JOIN parents p USING (target, key)
  WHERE target IS NOT NULL AND refs.key <> ''
)
SELECT ref_table, ref_id, ref_field, period, reason FROM judged WHERE reason IS NOT NULL
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES = {
    "p5_found": _FOUND,
    "p5_report": f"SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM ({_FOUND}) "
    "GROUP BY ref_table, ref_field, period, reason",
}
