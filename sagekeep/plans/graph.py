"""Queries over the memory graph: scans, joins along edges, counts, scores, search and expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagekeep.functions import scores
from sagekeep.functions.format import explained_block, recall_block, search_block
from sagekeep.functions.text import content_hash, norm_key, normalise_content, preview
from sagekeep.operators import retrieval, vector
from sagekeep.operators.graph import Graph, confident
from sagekeep.operators.skew import numbered
from sagekeep.operators.ontology import Ontology, checked_types
from sagekeep.plans.sql import BOOST, CONFIDENCE, DEGREES, DIM, MOMENT, QUERY_VECTOR, STRENGTH, query, similarity
from sagekeep.schemas import constraint_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None) -> Callable:
    """Add a query over a graph, under its function's name, with the SQL that gives the same rows."""

    def add(function: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        name = function.__name__
        QUERIES[name] = lambda spark, root: function(Graph(spark, root))
        if sql:
            ORACLES[name] = sql
        return function

    return add


def moment() -> Column:
    return F.lit(f"{MOMENT}+00:00").cast("timestamp")


def micros(column: str) -> Column:
    return F.unix_micros(column)


def rounded(column: str | Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


# Scans, filters, limits


@register(query("m", "SELECT id, kind, epoch_us(created_at) AS created FROM m WHERE t_expired IS NULL"))
def scan_active(g: Graph) -> DataFrame:
    return g.active_memories().select("id", "kind", micros("created_at").alias("created"))


@register(query("m", "SELECT id, kind, content, temporal_stability, reinforce_count FROM m"))
def memory_records(g: Graph) -> DataFrame:
    return g.memories.select("id", "kind", "content", "temporal_stability", "reinforce_count")


@register(query("m", "SELECT id, kind, epoch_us(created_at) AS created FROM m WHERE t_expired IS NULL ORDER BY created_at DESC, id LIMIT 20"))
def list_latest_k(g: Graph) -> DataFrame:
    return g.listed_memories(limit=20).select("id", "kind", micros("created_at").alias("created"))


@register(query("e", "SELECT id, entity_type, canonical_name FROM e WHERE expired_at IS NULL"))
def entities_active(g: Graph) -> DataFrame:
    return g.active_entities().select("id", "entity_type", "canonical_name")


@register(query("e", "SELECT norm_key, arg_min(id, (created_at, id)) AS entity_id FROM e WHERE expired_at IS NULL AND norm_key IS NOT NULL GROUP BY norm_key"))
def entity_by_norm_key(g: Graph) -> DataFrame:
    return g.entities_by_key(g.active_entities()).filter("norm_key IS NOT NULL")


@register(query("g", "SELECT edge_id, from_node, to_node FROM g WHERE t_expired IS NULL AND edge_type = 'MENTIONS' AND (confidence IS NULL OR confidence >= 0.75)"))
def edge_confidence_filter(g: Graph) -> DataFrame:
    return g.active_edges("MENTIONS").filter(confident(0.75)).select("edge_id", "from_node", "to_node")


@register(query("s", "SELECT source_id, source_type, coalesce(nullif(path, ''), agent) AS label FROM s"))
def source_labels(g: Graph) -> DataFrame:
    return g.source_labels().select("source_id", "source_type", "label")


@register(query("s", "SELECT path, arg_max(source_id, (ingested_at, source_id)) AS source_id FROM s WHERE source_type = 'file' AND path IS NOT NULL GROUP BY path"))
def source_latest_per_path(g: Graph) -> DataFrame:
    return g.latest_file_sources()


@register(query("s", "SELECT agent, session_id, count(*) AS n_sources, max(epoch_us(ingested_at)) AS last_ingested FROM s WHERE source_type = 'agentic' GROUP BY agent, session_id"))
def sources_by_agent_session(g: Graph) -> DataFrame:
    rows = g.sources.filter("source_type = 'agentic'").groupBy("agent", "session_id")
    return rows.agg(F.count(F.lit(1)).alias("n_sources"), F.max(micros("ingested_at")).alias("last_ingested"))


@register(query("c", "SELECT source_id, chunk_id, sequence_no, row_number() OVER (PARTITION BY source_id ORDER BY sequence_no, chunk_id) AS place FROM c"))
def chunks_in_order(g: Graph) -> DataFrame:
    return numbered(g.chunks.select("source_id", "chunk_id", "sequence_no"), "source_id", ["sequence_no", "chunk_id"])


@register(query("v", """SELECT memory_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY occurred_at DESC, event_id) AS place
  FROM v WHERE memory_id IS NOT NULL) WHERE place <= 3"""))
def events_newest_k_per_memory(g: Graph) -> DataFrame:
    return g.events_of_memories(3).select("memory_id", "event_id", F.col("place").cast("long").alias("place"))


@register(query("v", "SELECT event_id, memory_id, event_type FROM v WHERE memory_id IS NOT NULL AND starts_with(event_type, 'REINFORCE')"))
def reinforcement_events(g: Graph) -> DataFrame:
    return g.events_of_memories(2**31 - 1, reinforcing=True).select("event_id", "memory_id", "event_type")


@register(query("mg", "SELECT id FROM m WHERE t_expired IS NULL AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'MENTIONS' AND from_node = m.id)"))
def extraction_queue_anti(g: Graph) -> DataFrame:
    return g.awaiting_extraction().select("id")


# Joins along edges

_LINKS = "links AS (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL)"


@register(query("mg", "SELECT chunk_id, id, kind FROM links JOIN m USING (id) WHERE t_expired IS NULL", _LINKS))
def chunk_members_join(g: Graph) -> DataFrame:
    return g.chunk_members().select("chunk_id", "id", "kind")


@register(query("gc", "SELECT id, arg_min(chunk_id, (created_at, chunk_id)) AS chunk_id FROM links JOIN c USING (chunk_id) GROUP BY id", _LINKS))
def first_chunk_per_memory(g: Graph) -> DataFrame:
    return g.chunk_of_memory()


@register(query("eg", """SELECT links.chunk_id, links.id AS entity_id, canonical_name FROM
  (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'LINKED' AND t_expired IS NULL) links JOIN e ON e.id = links.id WHERE expired_at IS NULL"""))
def chunk_entities_join(g: Graph) -> DataFrame:
    return g.chunk_entities().select("chunk_id", "entity_id", "canonical_name")


@register(query("mv", """SELECT artifact_ref, arg_max(m.id, (m.created_at, m.id)) AS id FROM v JOIN m ON m.id = v.memory_id
  WHERE event_type = 'SUMMARY_CREATED' AND artifact_ref IS NOT NULL AND kind = 'SUMMARY' GROUP BY artifact_ref"""))
def artifact_summaries(g: Graph) -> DataFrame:
    return g.artifact_summaries()


@register(query("eg", """SELECT e.id, count(edge_id) AS mentions FROM e LEFT JOIN (SELECT * FROM g WHERE edge_type = 'MENTIONS' AND t_expired IS NULL) x ON x.to_node = e.id
  WHERE expired_at IS NULL GROUP BY e.id"""))
def entity_mention_counts_left(g: Graph) -> DataFrame:
    return g.mention_counts().select("id", "mentions")


_ORPHANS = """m.t_expired IS NULL AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'CONTAINS' AND g.t_expired IS NULL AND to_node = m.id)"""


@register(query("mg", f"SELECT id FROM m WHERE {_ORPHANS} AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'MENTIONS' AND g.t_expired IS NULL AND from_node = m.id)"))
def orphans_double_anti(g: Graph) -> DataFrame:
    return g.orphaned_memories().select("id")


@register(query("mg", f"SELECT id FROM m WHERE {_ORPHANS}"))
def without_source_anti(g: Graph) -> DataFrame:
    return g.memories_without_source().select("id")


@register(query("mg", f"SELECT id FROM m WHERE {_ORPHANS} AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'PRODUCED' AND g.t_expired IS NULL AND to_node = m.id)"))
def without_source_strict(g: Graph) -> DataFrame:
    return g.memories_without_source(strict=True).select("id")


@register(query("me", """SELECT node, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS label FROM
  (SELECT id AS node, content AS t FROM m UNION ALL SELECT id, canonical_name FROM e)"""))
def node_labels(g: Graph) -> DataFrame:
    return g.node_labels(40)


_SOURCES = "fifth AS (SELECT DISTINCT id FROM m WHERE temporal_stability = 'static')"


def _static(g: Graph) -> DataFrame:
    return g.memory_view("temporal_stability = 'static'").select("id")


@register(query("mg", """SELECT edge_id, from_node, to_node, edge_type, weight, epoch_us(t_created) AS created FROM g WHERE from_node IN (SELECT id FROM fifth) AND t_expired IS NULL
  AND (confidence IS NULL OR confidence >= 0.5)""", _SOURCES))
def edges_out_of_memories(g: Graph) -> DataFrame:
    found = g.edges_from(_static(g), least=0.5)
    return found.select("edge_id", "from_node", "to_node", "edge_type", "weight", micros("t_created").alias("created"))


@register(query("mgv", """SELECT edge_id, from_node, to_node, edge_type, weight, epoch_us(t_created) AS created FROM g WHERE to_node IN (SELECT id FROM fifth)
  UNION ALL SELECT event_id, event_id, memory_id, 'AFFECTS', 1.0, epoch_us(occurred_at) FROM v WHERE memory_id IN (SELECT id FROM fifth)""", _SOURCES))
def edges_into_memories(g: Graph) -> DataFrame:
    found = g.edges_to(_static(g), include_expired=True)
    return found.select("edge_id", "from_node", "to_node", "edge_type", "weight", micros("t_created").alias("created"))


@register(query("mg", "SELECT edge_id, from_node, to_node, edge_type FROM g WHERE from_node IN (SELECT id FROM fifth) AND edge_type = 'MENTIONS' AND t_expired IS NULL", _SOURCES))
def mentions_of_memories(g: Graph) -> DataFrame:
    return g.edges_from(_static(g), "MENTIONS").select("edge_id", "from_node", "to_node", "edge_type")


@register(query("mg", """SELECT chunk_id, arg_max(id, (created_at, id)) AS id FROM links JOIN m USING (id) WHERE kind = 'SUMMARY' AND t_expired IS NULL GROUP BY chunk_id""", _LINKS))
def chunk_summaries(g: Graph) -> DataFrame:
    return g.chunk_summaries()


_EVENT_EDGES = "SELECT event_id, event_id, memory_id, 'AFFECTS', 1.0, epoch_us(occurred_at) FROM v WHERE memory_id IS NOT NULL"


@register(query("eg", """SELECT edge_id, from_node, to_node, edge_type, epoch_us(t_created) AS created FROM g WHERE to_node IN (SELECT id FROM e WHERE entity_type = 'ORG' AND expired_at IS NULL)
  AND t_expired IS NULL AND edge_type = 'MENTIONS' AND (confidence IS NULL OR confidence >= 0.75)"""))
def mentions_of_entities(g: Graph) -> DataFrame:
    found = g.edges_to(g.active_entities("ORG").select("id"), "MENTIONS", least=0.75)
    return found.select("edge_id", "from_node", "to_node", "edge_type", micros("t_created").alias("created"))


@register(query("gv", f"""SELECT * FROM (SELECT edge_id, from_node, to_node, edge_type, weight, epoch_us(t_created) AS created FROM g WHERE t_expired IS NULL
  UNION ALL {_EVENT_EDGES}) ORDER BY created DESC NULLS LAST, edge_id LIMIT 100"""))
def edges_listed(g: Graph) -> DataFrame:
    return g.listed_edges().select("edge_id", "from_node", "to_node", "edge_type", "weight", micros("t_created").alias("created"))


@register(query("g", """SELECT edge_id, from_node, to_node, epoch_us(t_created) AS created FROM g WHERE edge_type = 'LINKED' ORDER BY created DESC NULLS LAST, edge_id LIMIT 50"""))
def edges_listed_of_kind(g: Graph) -> DataFrame:
    found = g.listed_edges("LINKED", include_expired=True, limit=50)
    return found.select("edge_id", "from_node", "to_node", micros("t_created").alias("created"))


@register(query("s", "SELECT source_id, agent, session_id FROM s WHERE source_type = 'agentic' ORDER BY ingested_at DESC NULLS LAST, source_id LIMIT 50"))
def sources_listed(g: Graph) -> DataFrame:
    return g.listed_sources(50, source_type="agentic").select("source_id", "agent", "session_id")


@register(query("e", "SELECT id, entity_type, canonical_name FROM e WHERE id = (SELECT min(id) FROM entities)"))
def entity_by_id(g: Graph) -> DataFrame:
    least = g.table("entities").agg(F.min("id")).first()[0]
    return g.by_id("entities", "id", least).select("id", "entity_type", "canonical_name")


@register(query("m", "SELECT id, kind, content, reinforce_count FROM m WHERE id = (SELECT min(id) FROM memories)"))
def memory_by_id(g: Graph) -> DataFrame:
    least = g.table("memories").agg(F.min("id")).first()[0]
    return g.by_id("memories", "id", least).select("id", "kind", "content", "reinforce_count")


@register(query("g", "SELECT edge_id, from_node, to_node, weight FROM g WHERE edge_id = (SELECT min(edge_id) FROM edges)"))
def edge_by_id(g: Graph) -> DataFrame:
    least = g.table("edges").agg(F.min("edge_id")).first()[0]
    return g.by_id("edges", "edge_id", least).select("edge_id", "from_node", "to_node", "weight")


# Counts


@register(query("m", "SELECT kind, count(*) AS memories FROM m GROUP BY kind"))
def by_kind_counts(g: Graph) -> DataFrame:
    return g.kind_counts()


@register(query("gv", "SELECT edge_type, count(*) AS edges FROM (SELECT edge_type FROM g UNION ALL SELECT 'AFFECTS' FROM v WHERE memory_id IS NOT NULL) GROUP BY edge_type"))
def edge_counts(g: Graph) -> DataFrame:
    return g.edge_counts()


@register(query("gv", "SELECT id, degree FROM degrees", DEGREES))
def in_degree(g: Graph) -> DataFrame:
    return g.in_degrees()


@register(query("mg", "SELECT edge_type, count(DISTINCT from_node) AS memories FROM g WHERE from_node IN (SELECT id FROM m) GROUP BY edge_type"))
def distinct_memories_with_edge(g: Graph) -> DataFrame:
    return g.linked_memory_counts()


@register(query("v", "SELECT memory_id AS id, count(*) AS reinforcements, max(epoch_us(occurred_at)) AS last_seen FROM v WHERE memory_id IS NOT NULL AND starts_with(event_type, 'REINFORCE') GROUP BY memory_id"))
def last_seen_and_count(g: Graph) -> DataFrame:
    return g.reinforcement_state().select("id", "reinforcements", micros("last_seen_at").alias("last_seen"))


@register(query("meg", f"""SELECT 'memories' AS counter, count(*) AS value FROM m WHERE kind = 'MEMORY'
  UNION ALL SELECT 'summaries', count(*) FROM m WHERE kind = 'SUMMARY'
  UNION ALL SELECT 'expired_memories', count(*) FROM m WHERE t_expired IS NOT NULL
  UNION ALL SELECT 'entities', count(*) FROM e
  UNION ALL SELECT 'expired_entities', count(*) FROM e WHERE expired_at IS NOT NULL
  UNION ALL SELECT 'edges', count(*) FROM g
  UNION ALL SELECT 'orphaned_memories', count(*) FROM m WHERE {_ORPHANS} AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'MENTIONS' AND g.t_expired IS NULL AND from_node = m.id)
  UNION ALL SELECT 'memories_without_source', count(*) FROM m WHERE {_ORPHANS}
  UNION ALL SELECT 'awaiting_extraction', count(*) FROM m WHERE t_expired IS NULL AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'MENTIONS' AND from_node = m.id)"""))
def health_report(g: Graph) -> DataFrame:
    return g.health_report()


@register("""WITH k(table_name, key_name, key) AS (
  SELECT 'memories', 'id', id FROM memories UNION ALL SELECT 'memories', 'content_hash', content_hash FROM memories
  UNION ALL SELECT 'entities', 'id', id FROM entities UNION ALL SELECT 'entities', 'norm_key', norm_key FROM entities WHERE expired_at IS NULL
  UNION ALL SELECT 'edges', 'edge_id', edge_id FROM edges UNION ALL SELECT 'memory_events', 'event_id', event_id FROM memory_events
  UNION ALL SELECT 'chunks', 'chunk_id', chunk_id FROM chunks UNION ALL SELECT 'sources', 'source_id', source_id FROM sources)
SELECT table_name, key_name, count(*) FILTER (n > 1 AND key IS NOT NULL) AS broken FROM (SELECT table_name, key_name, key, count(*) AS n FROM k GROUP BY ALL) GROUP BY table_name, key_name""")
def key_constraints(g: Graph) -> DataFrame:
    names = ("memories", "entities", "edges", "memory_events", "chunks", "sources")
    return constraint_report({name: g.table(name) for name in names})


# Scores


@register(query("v", "SELECT id, round(reinforcement, 6) AS multiplier, reinforcements FROM strength", STRENGTH))
def reinforcement_multiplier(g: Graph) -> DataFrame:
    log = g.events.filter(F.col("event_type").startswith("REINFORCE"))
    found = scores.reinforcement(log, moment())
    return found.select(F.col("memory_id").alias("id"), rounded("multiplier", "multiplier"), "reinforcements")


@register(query("gv", f"SELECT id, round({BOOST}, 6) AS boost FROM degrees", DEGREES))
def graph_boost(g: Graph) -> DataFrame:
    return g.in_degrees().select("id", rounded(scores.graph_boost("degree"), "boost"))


@register(query("m", f"SELECT id, round({CONFIDENCE}, 6) AS confidence FROM m"))
def temporal_confidence(g: Graph) -> DataFrame:
    valid = F.coalesce("t_valid", "created_at")
    return g.memories.select("id", rounded(scores.temporal_confidence(valid, "temporal_stability", moment()), "confidence"))


_SCORED = f"""scored AS (SELECT m.id, coalesce(reinforcement, 1.0) AS reinforcement, coalesce(degree, 0) AS degree,
  coalesce(reinforcement, 1.0) * {BOOST} * {CONFIDENCE} AS multiplier
  FROM m LEFT JOIN strength USING (id) LEFT JOIN degrees USING (id))"""


@register(query("mgv", "SELECT id, round(multiplier, 6) AS multiplier, degree FROM scored", STRENGTH, DEGREES, _SCORED))
def enhanced_multiplier(g: Graph) -> DataFrame:
    found = retrieval.multipliers(g, g.memories.select("id", "created_at", "t_valid", "temporal_stability"), moment())
    return found.select("id", rounded("multiplier", "multiplier"), "degree")


_SECONDS = f"((epoch_us(TIMESTAMPTZ '{MOMENT}+00') - epoch_us(occurred_at)) / 1000000.0)"


@register(query("v", f"""SELECT event_id, CASE WHEN occurred_at IS NULL THEN 'unknown' WHEN {_SECONDS} < 60 THEN 'just now'
  WHEN {_SECONDS} < 3600 THEN floor({_SECONDS} / 60)::BIGINT || 'm' WHEN {_SECONDS} < 86400 THEN floor({_SECONDS} / 3600)::BIGINT || 'h'
  WHEN {_SECONDS} < 604800 THEN floor({_SECONDS} / 86400)::BIGINT || 'd' WHEN {_SECONDS} < 2592000 THEN floor({_SECONDS} / 604800)::BIGINT || 'w'
  ELSE floor({_SECONDS} / 2592000)::BIGINT || 'mo' END AS age FROM v"""))
def age_bucket(g: Graph) -> DataFrame:
    return g.events.select("event_id", scores.age_label("occurred_at", moment()).alias("age"))


# Vector search


def _query(g: Graph) -> list[float]:
    return vector.query_vector(g.memories, "id", "content_embedding", DIM)


_NEAR = f"near AS (SELECT m.*, {similarity('content_embedding')} AS similarity FROM m, q)"


@register(query("m", "SELECT id, round(similarity, 6) AS similarity FROM near WHERE t_expired IS NULL AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 10", QUERY_VECTOR, _NEAR))
def knn_topk(g: Graph) -> DataFrame:
    found = vector.top_k(g.memories, "id", "content_embedding", _query(g), 10, F.col("t_expired").isNull())
    return found.select("id", rounded("similarity", "similarity"))


@register(query("m", "SELECT id, round(similarity, 6) AS similarity FROM near WHERE t_expired IS NULL AND kind = 'SUMMARY' AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 10", QUERY_VECTOR, _NEAR))
def knn_kind_filter(g: Graph) -> DataFrame:
    where = F.col("t_expired").isNull() & (F.col("kind") == "SUMMARY")
    return vector.top_k(g.memories, "id", "content_embedding", _query(g), 10, where).select("id", rounded("similarity", "similarity"))


@register(query("m", """SELECT id, round(similarity, 6) AS similarity FROM (SELECT * FROM near WHERE similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 50)
  WHERE kind = 'SUMMARY' AND t_expired IS NULL""", QUERY_VECTOR, _NEAR))
def knn_post_filter(g: Graph) -> DataFrame:
    where = F.col("t_expired").isNull() & (F.col("kind") == "SUMMARY")
    found = vector.top_k(g.memories, "id", "content_embedding", _query(g), 50, where, post_filter=True)
    return found.select("id", rounded("similarity", "similarity"))


@register(query("me", f"""SELECT id, round(sim, 6) AS similarity FROM (SELECT id, {similarity('embedding')} AS sim FROM e, q WHERE expired_at IS NULL AND entity_type = 'PERSON')
  WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 10""", QUERY_VECTOR))
def entity_knn(g: Graph) -> DataFrame:
    rows = g.active_entities("PERSON")
    return vector.top_k(rows, "id", "embedding", _query(g), 10).select("id", rounded("similarity", "similarity"))


_MATCHED = """matched AS (SELECT id AS entity_id, CASE entity_type WHEN 'PERSON' THEN 1.0 ELSE 0.8 END AS similarity
  FROM e WHERE expired_at IS NULL AND entity_type IN ('PERSON', 'ORG')),
es AS (SELECT from_node AS id, max(similarity * CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0 ELSE confidence END) AS entity_score
  FROM g JOIN matched ON to_node = entity_id WHERE edge_type = 'MENTIONS' AND t_expired IS NULL GROUP BY from_node)"""


def _matched(g: Graph) -> DataFrame:
    rows = g.active_entities().filter("entity_type IN ('PERSON', 'ORG')")
    return rows.select(F.col("id").alias("entity_id"), F.when(F.col("entity_type") == "PERSON", 1.0).otherwise(0.8).alias("similarity"))


@register(query("eg", "SELECT id, round(entity_score, 6) AS entity_score FROM es WHERE id IS NOT NULL", _MATCHED))
def entity_scored_memories(g: Graph) -> DataFrame:
    found = retrieval.entity_scores(g, _matched(g)).filter("id IS NOT NULL")
    return found.select("id", rounded("entity_score", "entity_score"))


_HYBRID = query(
    "megv",
    """SELECT id, round(base * multiplier, 6) AS score, round(base, 6) AS base FROM blended JOIN scored USING (id)
  ORDER BY base * multiplier DESC, id LIMIT 5""",
    QUERY_VECTOR,
    _NEAR,
    STRENGTH,
    DEGREES,
    _SCORED,
    _MATCHED,
    "top AS (SELECT id, similarity FROM near WHERE t_expired IS NULL AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 50)",
    """blended AS (SELECT id, CASE WHEN max(CASE WHEN entity_score IS NOT NULL THEN 1 ELSE 0 END) OVER () = 1
      THEN (1 - 0.3) * similarity + 0.3 * coalesce(entity_score, 0.0) ELSE similarity END AS base FROM top LEFT JOIN es USING (id))""",
)


@register(_HYBRID)
def hybrid_blend(g: Graph) -> DataFrame:
    found = retrieval.hybrid_search(g, _query(g), _matched(g), moment())
    return found.select("id", rounded("score", "score"), rounded("base", "base"))


@register(query(
    "mgv",
    "SELECT id, round(sim * multiplier, 6) AS score FROM rows_ JOIN scored USING (id) ORDER BY sim * multiplier DESC, id LIMIT 5",
    QUERY_VECTOR,
    _NEAR,
    STRENGTH,
    DEGREES,
    _SCORED,
    _LINKS,
    "top AS (SELECT id FROM near WHERE kind = 'SUMMARY' AND t_expired IS NULL AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 25)",
    "wanted AS (SELECT id FROM links WHERE chunk_id IN (SELECT chunk_id FROM links WHERE id IN (SELECT id FROM top)) UNION SELECT id FROM top)",
    "rows_ AS (SELECT id, coalesce(similarity, 0.0) AS sim FROM near WHERE t_expired IS NULL AND id IN (SELECT id FROM wanted))",
))
def recall_chunk_expansion(g: Graph) -> DataFrame:
    return retrieval.recall(g, _query(g), moment()).select("id", rounded("score", "score"))


# Expansion. Seeds are the memories of one kind of stability, so that they grow with the data.

_SEEDS = "seeds AS (SELECT id FROM m WHERE temporal_stability = 'ephemeral' AND t_expired IS NULL)"
_SHARED = """mentions AS (SELECT DISTINCT from_node AS id, to_node AS entity FROM g WHERE edge_type = 'MENTIONS' AND t_expired IS NULL AND (confidence IS NULL OR confidence >= 0.75)),
shared AS (SELECT id, count(*) AS shared FROM mentions WHERE entity IN (SELECT entity FROM mentions WHERE id IN (SELECT id FROM seeds))
  AND id NOT IN (SELECT id FROM seeds) AND id IN (SELECT id FROM m WHERE t_expired IS NULL) GROUP BY id)"""
_RELATED = """related AS (SELECT to_node AS id, max(weight) AS weight, max((weight, from_node)) AS b FROM g
  WHERE edge_type = 'RELATED' AND t_expired IS NULL AND from_node IN (SELECT id FROM seeds) AND (confidence IS NULL OR confidence >= 0.0)
  AND to_node NOT IN (SELECT id FROM seeds) AND to_node IN (SELECT id FROM m WHERE t_expired IS NULL) GROUP BY to_node)"""


def _seeds(g: Graph) -> DataFrame:
    return g.active_memories().filter("temporal_stability = 'ephemeral'").select("id")


@register(query("mg", "SELECT id, shared FROM shared", _SEEDS, _SHARED))
def expand_shared_entities(g: Graph) -> DataFrame:
    return retrieval.expand_shared_entities(g, _seeds(g), None)


@register(query("mg", "SELECT id, round(weight, 6) AS weight, g2.from_node AS via FROM related JOIN (SELECT to_node, from_node, weight AS w FROM g WHERE edge_type = 'RELATED' AND t_expired IS NULL AND from_node IN (SELECT id FROM seeds)) g2 ON g2.to_node = id AND g2.w = weight QUALIFY row_number() OVER (PARTITION BY id ORDER BY g2.from_node DESC) = 1", _SEEDS, _RELATED))
def expand_related_best(g: Graph) -> DataFrame:
    return retrieval.expand_related(g, _seeds(g), None).select("id", rounded("weight", "weight"), "via")


@register(query("mg", """SELECT 'shared_entities' AS reason, id, score FROM (SELECT id, shared::DOUBLE AS score FROM shared ORDER BY shared DESC, id LIMIT 10)
  UNION ALL SELECT 'related', id, round(weight, 6) FROM (SELECT id, weight FROM related ORDER BY weight DESC, id LIMIT 10)""", _SEEDS, _SHARED, _RELATED))
def expand_both(g: Graph) -> DataFrame:
    return retrieval.expand(g, _seeds(g), 10, 10).select("reason", "id", rounded("score", "score"))


# Scalar functions over the tables

_BLANK = r"'[ \t\n\v\f\r]+'"
_NORMAL = f"trim(regexp_replace({{0}}, {_BLANK}, ' ', 'g'))"


@register(query("m", f"SELECT id, {_NORMAL.format('content')} AS content, sha256({_NORMAL.format('content')}) AS content_hash FROM m"))
def content_normalise_hash(g: Graph) -> DataFrame:
    return g.memories.select("id", normalise_content("content").alias("content"), content_hash("content").alias("content_hash"))


_PUNCTUATION = "concat('!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', chr(39))"


@register(query("e", f"SELECT id, entity_type || ':' || trim(lower({_NORMAL.format('canonical_name')}), {_PUNCTUATION}) AS key FROM e"))
def norm_keys(g: Graph) -> DataFrame:
    return g.entities.select("id", norm_key("canonical_name", "entity_type").alias("key"))


@register(query("g", "SELECT edge_id, CASE WHEN length(evidence) > 40 THEN substr(evidence, 1, 37) || '...' ELSE evidence END AS evidence FROM g"))
def truncate_preview(g: Graph) -> DataFrame:
    return g.edges.select("edge_id", preview("evidence", 40).alias("evidence"))


_KNOWN = ("PERSON", "ORG", "SYSTEM", "PROJECT", "PLACE", "CONCEPT", "TOOL")


@register(query("e", f"""SELECT id, CASE upper(trim(entity_type)) WHEN 'SKILL' THEN 'TOOL' ELSE upper(trim(entity_type)) END AS resolved_type,
  upper(trim(entity_type)) IN ('SKILL', {", ".join(f"'{k}'" for k in _KNOWN)}) AS is_known FROM e WHERE entity_type IS NOT NULL"""))
def entity_type_check(g: Graph) -> DataFrame:
    types = [{"name": k, "synonyms": [" skill "] if k == "TOOL" else []} for k in _KNOWN]
    found = checked_types(g.entities.filter("entity_type IS NOT NULL"), Ontology.of(types))
    return found.select("id", "resolved_type", "is_known")


@register(query("m", """SELECT id, 'ID: ' || id || chr(10) || 'Score: ' || printf('%.4f', similarity) || chr(10) || 'Created: ' || coalesce(strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d %H:%M:%S') || ' UTC', 'unknown')
    || chr(10) || 'Content: ' || coalesce(CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END, '') AS block
  FROM near WHERE t_expired IS NULL AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 10""", QUERY_VECTOR, _NEAR))
def search_blocks(g: Graph) -> DataFrame:
    """The nearest memories as they are shown."""
    found = vector.top_k(g.memories, "id", "content_embedding", _query(g), 10, F.col("t_expired").isNull())
    return found.withColumn("score", F.col("similarity")).select("id", search_block().alias("block"))


_AGE = f"(epoch_us(TIMESTAMPTZ '{MOMENT}+00') - epoch_us(near.created_at)) / 1000000.0"


@register(query(
    "mgv",
    f"""SELECT id, '(score=' || printf('%.4f', sim * multiplier) || ', age=' || CASE WHEN age IS NULL THEN 'unknown' WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN floor(age / 60)::BIGINT || 'm'
    WHEN age < 86400 THEN floor(age / 3600)::BIGINT || 'h' WHEN age < 604800 THEN floor(age / 86400)::BIGINT || 'd' WHEN age < 2592000 THEN floor(age / 604800)::BIGINT || 'w'
    ELSE floor(age / 2592000)::BIGINT || 'mo' END || ', stability=' || stability || ')' || coalesce(chr(10) || content, '') AS block
  FROM rows_ JOIN scored USING (id) ORDER BY sim * multiplier DESC, id LIMIT 5""",
    QUERY_VECTOR,
    _NEAR,
    STRENGTH,
    DEGREES,
    _SCORED,
    _LINKS,
    "top AS (SELECT id FROM near WHERE kind = 'SUMMARY' AND t_expired IS NULL AND similarity IS NOT NULL ORDER BY near.similarity DESC, id LIMIT 25)",
    "wanted AS (SELECT id FROM links WHERE chunk_id IN (SELECT chunk_id FROM links WHERE id IN (SELECT id FROM top)) UNION SELECT id FROM top)",
    f"rows_ AS (SELECT id, content, temporal_stability AS stability, {_AGE} AS age, coalesce(similarity, 0.0) AS sim FROM near WHERE t_expired IS NULL AND id IN (SELECT id FROM wanted))",
))
def recall_blocks(g: Graph) -> DataFrame:
    """What is recalled as it is shown."""
    return retrieval.recall(g, _query(g), moment()).select("id", recall_block(moment()).alias("block"))


@register(None)
def recall_explained(g: Graph) -> DataFrame:
    """The recall of the query vector with the reasons of each score, as text."""
    found = retrieval.recall(g, _query(g), moment())
    return found.select("id", explained_block(moment()).alias("block"))
