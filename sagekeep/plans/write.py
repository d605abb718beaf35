"""Queries of the write path: hygiene, duplicates, edges, updates, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagekeep.operators import backfill, commit, retrieval, vector
from sagekeep.operators.graph import Graph
from sagekeep.plans.graph import moment, register, rounded
from sagekeep.plans.sql import DIM, MOMENT, query, similarity

_BLANK = r"'[ \t\n\v\f\r]+'"
_NORMAL = f"trim(regexp_replace(content, {_BLANK}, ' ', 'g'))"
_REASON = r"""CASE WHEN content IS NULL OR content = '' THEN 'empty' WHEN length(content) < 12 THEN 'too_short' WHEN length(content) > 4000 THEN 'too_long'
  WHEN lower(content) IN ('ok', 'okay', 'thanks', 'thx', 'lol', 'haha', 'yeah', 'yep', 'nope', 'k') OR regexp_full_match(lower(content), '\.+') THEN 'no_substance' END"""
_NEW = """fresh AS (SELECT commit_id AS id, batch_no, seq_no, content, content_embedding AS vector, source FROM commit_outcomes WHERE outcome IS NULL
  QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY batch_no, seq_no) = 1)"""
_CLEAN = f"clean AS (SELECT *, {_REASON} AS reason, sha256(content) AS content_hash FROM (SELECT * REPLACE ({_NORMAL} AS content) FROM fresh))"
_STORED = f"""stored AS (SELECT sha256({_NORMAL}) AS content_hash, arg_min(id, (created_at, id)) AS stored FROM m WHERE content IS NOT NULL GROUP BY 1)"""
_PAIR = f"""CASE WHEN len(f.vector) = {DIM} AND len(m.content_embedding) = {DIM} THEN
  CASE WHEN list_dot_product(f.vector, f.vector) > 0 AND list_dot_product(m.content_embedding, m.content_embedding) > 0
  THEN round(list_cosine_similarity(f.vector::DOUBLE[], m.content_embedding::DOUBLE[]), 12) END END"""
_NEAR = f"""pairs AS (SELECT f.id, m.id AS other, {_PAIR} AS sim FROM clean f, m WHERE reason IS NULL),
near AS (SELECT id, other AS near, sim FROM pairs WHERE sim >= 0.92 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) = 1)"""


def incoming(g: Graph) -> DataFrame:
    """The undecided commits, once each, in their order."""
    rows = g.table("commit_outcomes").filter("outcome IS NULL AND commit_id IS NOT NULL")
    first = F.min_by(F.struct("content", "content_embedding", "source", "batch_no", "seq_no"), F.struct("batch_no", "seq_no"))
    rows = rows.groupBy(F.col("commit_id").alias("id")).agg(first.alias("r")).select("id", "r.*")
    place = F.col("batch_no").cast("long") * 2**32 + F.col("seq_no")
    return rows.select("id", place.alias("place"), "content", F.col("content_embedding").alias("vector"), "source")


@register(query("m", "SELECT id, reason FROM clean", _NEW, _CLEAN))
def hygiene_outcomes(g: Graph) -> DataFrame:
    from sagekeep.functions.text import normalise_content

    return incoming(g).select("id", commit.hygiene_reason(normalise_content("content")).alias("reason"))


@register(query("m", "SELECT content_hash, stored AS id FROM stored", _STORED))
def exact_dup_canonical(g: Graph) -> DataFrame:
    return commit.canonical_by_hash(g.memories)


@register(query("m", "SELECT id, near AS other, round(sim, 6) AS similarity FROM near", _NEW, "clean AS (SELECT *, NULL AS reason FROM fresh)", _NEAR))
def near_dup_argmax(g: Graph) -> DataFrame:
    found = commit.nearest_memory(incoming(g).select("id", "vector"), g.memories, 0.92, DIM)
    return found.select("id", "other", rounded("similarity", "similarity"))


_DECIDED = """judged AS (SELECT c.*, near, stored, first_value(c.id) OVER (PARTITION BY c.content_hash, near IS NOT NULL ORDER BY batch_no, seq_no, c.id) AS first
  FROM clean c LEFT JOIN (SELECT n.* FROM near n JOIN clean k ON k.id = n.id WHERE k.source IS NULL OR k.source <> 'manual') n ON n.id = c.id LEFT JOIN stored USING (content_hash) WHERE reason IS NULL),
decided AS (SELECT id, CASE WHEN near IS NOT NULL THEN 'NEAR_DUPE' WHEN coalesce(stored, first) <> id THEN 'EXACT_DUPE' ELSE 'INSERTED_NEW' END AS outcome,
  coalesce(near, stored, first) AS matched, NULL AS reason FROM judged
  UNION ALL SELECT id, 'REJECTED_HYGIENE', NULL, reason FROM clean WHERE reason IS NOT NULL)"""


@register(query("m", "SELECT id, outcome, matched, reason FROM decided", _NEW, _CLEAN, _STORED, _NEAR, _DECIDED))
def commit_decisions(g: Graph) -> DataFrame:
    return commit.decide(g.memories, incoming(g)).select("id", "outcome", "matched", "reason")


@register(query("m", """SELECT CASE outcome WHEN 'INSERTED_NEW' THEN 'ADD' WHEN 'EXACT_DUPE' THEN 'REINFORCE_EXACT' ELSE 'REINFORCE_NEAR' END AS event_type, matched AS memory_id, count(*) AS n
  FROM decided WHERE outcome <> 'REJECTED_HYGIENE' GROUP BY ALL""", _NEW, _CLEAN, _STORED, _NEAR, _DECIDED))
def commit_event_counts(g: Graph) -> DataFrame:
    events = commit.commit_events(commit.decide(g.memories, incoming(g)), moment())
    return events.groupBy("event_type", "memory_id").agg(F.count(F.lit(1)).alias("n"))


@register(query("m", f"""SELECT a.id AS from_node, b.id AS to_node, round(sim, 6) AS weight FROM (
  SELECT a.id, b.id AS other, CASE WHEN len(a.content_embedding) = {DIM} AND len(b.content_embedding) = {DIM} THEN
    CASE WHEN list_dot_product(a.content_embedding, a.content_embedding) > 0 AND list_dot_product(b.content_embedding, b.content_embedding) > 0
    THEN round(list_cosine_similarity(a.content_embedding::DOUBLE[], b.content_embedding::DOUBLE[]), 12) END END AS sim
  FROM m a JOIN m b ON b.created_at < a.created_at) p JOIN m a ON a.id = p.id JOIN m b ON b.id = p.other
  WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.id) <= 5"""))
def related_topn_per_memory(g: Graph) -> DataFrame:
    return commit.related_edges(g.memories).select("from_node", "to_node", rounded("weight", "weight"))


_CUT = "TIMESTAMPTZ '2025-07-01 00:00:00+00'"


@register(query("g", f"""SELECT edge_id, from_node, to_node, edge_type FROM g n WHERE t_created >= {_CUT} AND NOT EXISTS (SELECT 1 FROM g o WHERE o.t_created < {_CUT}
    AND o.t_expired IS NULL AND o.from_node = n.from_node AND o.to_node = n.to_node AND o.edge_type = n.edge_type)
  QUALIFY row_number() OVER (PARTITION BY from_node, to_node, edge_type ORDER BY t_created, edge_id) = 1"""))
def edge_upsert_keep_first(g: Graph) -> DataFrame:
    cut = F.lit("2025-07-01T00:00:00+00:00").cast("timestamp")
    added = commit.upsert_edges(g.edges.filter(F.col("t_created") < cut), g.edges.filter(F.col("t_created") >= cut))
    return added.select("edge_id", "from_node", "to_node", "edge_type")


@register(query("mecsg", f"""SELECT edge_id FROM g WHERE t_created >= {_CUT} AND from_node IN (SELECT node FROM nodes) AND to_node IN (SELECT node FROM nodes) AND NOT EXISTS (SELECT 1 FROM g o
    WHERE o.t_created < {_CUT} AND o.t_expired IS NULL AND o.from_node = g.from_node AND o.to_node = g.to_node AND o.edge_type = g.edge_type)
  QUALIFY row_number() OVER (PARTITION BY from_node, to_node, edge_type ORDER BY t_created, edge_id) = 1""",
    "nodes AS (SELECT id AS node FROM m UNION SELECT id FROM e UNION SELECT chunk_id FROM c UNION SELECT source_id FROM s)"))
def edge_upsert_checked_ends(g: Graph) -> DataFrame:
    cut = F.lit("2025-07-01T00:00:00+00:00").cast("timestamp")
    nodes = None
    for frame, key in ((g.memories, "id"), (g.entities, "id"), (g.chunks, "chunk_id"), (g.sources, "source_id")):
        part = frame.select(F.col(key).alias("node"))
        nodes = part if nodes is None else nodes.unionByName(part)
    added = commit.upsert_edges(g.edges.filter(F.col("t_created") < cut), g.edges.filter(F.col("t_created") >= cut), nodes)
    return added.select("edge_id")


@register(query("e", "SELECT id, norm_key FROM e WHERE expired_at IS NULL AND norm_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY created_at, id) = 1"))
def entity_dedupe_keep_first(g: Graph) -> DataFrame:
    return commit.dedupe_entities(g.entities).select("id", "norm_key")


@register(query("mv", f"""SELECT id, epoch_us(CASE WHEN t_expired IS NULL AND id IN (SELECT memory_id FROM v WHERE event_type = 'DEPRECATE') THEN TIMESTAMPTZ '{MOMENT}+00' ELSE t_expired END) AS expired,
  epoch_us(CASE WHEN t_expired IS NULL AND id IN (SELECT memory_id FROM v WHERE event_type = 'DEPRECATE') THEN NULL ELSE t_invalid END) AS invalid FROM m"""))
def soft_delete_view(g: Graph) -> DataFrame:
    ids = g.events.filter("event_type = 'DEPRECATE'").select(F.col("memory_id").alias("id"))
    changed = commit.deprecate(g.memories, ids, moment())
    return changed.select("id", F.unix_micros("t_expired").alias("expired"), F.unix_micros("t_invalid").alias("invalid"))


@register("""WITH RECURSIVE e AS (SELECT DISTINCT id, nullif(merged_into, '') AS up FROM entities),
  walk(id, pos, depth) AS (SELECT id, id, 0 FROM e UNION ALL SELECT w.id, e.up, depth + 1 FROM walk w JOIN e ON e.id = w.pos JOIN e x ON x.id = e.up WHERE depth < 50)
  SELECT id, arg_max(pos, depth) AS final FROM walk GROUP BY id""")
def merge_chains(g: Graph) -> DataFrame:
    return commit.resolve_merges(g.entities).select("id", "final")


@register(query("e", f"""SELECT asked_id, entity_id, round(similarity, 6) AS similarity FROM (
  SELECT asked_id, entity_id, 1.0 AS similarity FROM by_key UNION ALL
  SELECT asked_id, entity_id, sim FROM (SELECT a.id AS asked_id, p.id AS entity_id, {similarity('p.embedding', 'a.v')} AS sim FROM
    (SELECT id, entity_type, embedding::DOUBLE[] AS v FROM e WHERE expired_at IS NOT NULL AND id NOT IN (SELECT asked_id FROM by_key)
      AND CASE WHEN len(embedding) = {DIM} THEN list_dot_product(embedding, embedding) > 0 END) a
    JOIN e p ON p.entity_type = a.entity_type AND p.expired_at IS NULL) WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY asked_id ORDER BY sim DESC, entity_id) = 1)""",
    "by_key AS (SELECT a.id AS asked_id, k.entity_id FROM e a JOIN (SELECT norm_key, arg_min(id, (created_at, id)) AS entity_id FROM e WHERE expired_at IS NULL GROUP BY norm_key) k USING (norm_key) WHERE a.expired_at IS NOT NULL)"))
def entity_match_exact_then_nn(g: Graph) -> DataFrame:
    gone = g.entities.filter("expired_at IS NOT NULL")
    asked = gone.select(F.col("id").alias("asked_id"), "entity_type", "norm_key", F.col("embedding").alias("vector"))
    found = retrieval.match_entities(g, asked, 0.5, DIM)
    return found.select("asked_id", "entity_id", rounded("similarity", "similarity"))


@register(query("m", f"""SELECT id, {similarity('content_embedding', 'list_value(' + ', '.join(['1.0'] * DIM) + ')')} IS NOT NULL AS usable FROM m"""))
def usable_vectors(g: Graph) -> DataFrame:
    return g.memories.select("id", F.coalesce(vector.usable("content_embedding", DIM), F.lit(False)).alias("usable"))


@register(query("m", """SELECT id FROM m WHERE coalesce(t_valid, created_at) <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND (t_invalid IS NULL OR t_invalid > TIMESTAMPTZ '2025-06-01 00:00:00+00')
  AND t_created <= TIMESTAMPTZ '2025-09-01 00:00:00+00' AND (t_expired IS NULL OR t_expired > TIMESTAMPTZ '2025-09-01 00:00:00+00')"""))
def as_of_view(g: Graph) -> DataFrame:
    """What was valid at one moment, as known at another."""
    valid, known = (F.lit(f"2025-{m}-01T00:00:00+00:00").cast("timestamp") for m in ("06", "09"))
    rows = g.memories.filter((F.coalesce("t_valid", "created_at") <= valid) & (F.col("t_created") <= known))
    return rows.filter((F.col("t_invalid").isNull() | (F.col("t_invalid") > valid)) & (F.col("t_expired").isNull() | (F.col("t_expired") > known))).select("id")


@register(query("eg", """SELECT count(*) AS left_edges, count(*) FILTER (edge_type = 'MENTIONS') AS left_mentions FROM g
  WHERE (from_node IS NULL OR from_node NOT IN (SELECT id FROM e)) AND (to_node IS NULL OR to_node NOT IN (SELECT id FROM e))"""))
def purge_entities(g: Graph) -> DataFrame:
    _, edges = commit.purge_entities(g.entities, g.edges)
    mentions = F.count_if(F.col("edge_type") == "MENTIONS")
    return edges.agg(F.count(F.lit(1)).alias("left_edges"), mentions.alias("left_mentions"))


# Updates over whole tables


@register(query("m", """SELECT m.id, len(v) AS length, v[1]::DOUBLE + 0.0 AS head FROM (SELECT m.id, coalesce(n.vector, m.content_embedding) AS v FROM m LEFT JOIN n USING (id)) m""",
    """n AS (SELECT memory_id AS id, arg_max(content_embedding, (batch_no, seq_no, commit_id)) AS vector FROM commit_outcomes
  WHERE outcome = 'INSERTED_NEW' AND content_embedding IS NOT NULL AND memory_id IS NOT NULL GROUP BY memory_id)"""))
def vectors_replaced(g: Graph) -> DataFrame:
    """Memories with the vector of the last commit that inserted them, where there is one; -0.0 is shown as 0.0, as the SQL's lists lose the sign."""
    made = g.table("commit_outcomes").filter("outcome = 'INSERTED_NEW' AND content_embedding IS NOT NULL AND memory_id IS NOT NULL")
    last = F.max_by("content_embedding", F.struct("batch_no", "seq_no", "commit_id"))
    vectors = made.groupBy(F.col("memory_id").alias("id")).agg(last.alias("vector"))
    found = commit.set_vectors(g.memories.select("id", "content_embedding"), vectors, "content_embedding")
    return found.select("id", F.size("content_embedding").cast("long").alias("length"), (F.get("content_embedding", F.lit(0)).cast("double") + 0.0).alias("head"))


@register(query("e", f"""SELECT id, epoch_us(CASE WHEN id IN (SELECT id FROM hit) THEN TIMESTAMPTZ '{MOMENT}+00' ELSE expired_at END) AS expired, merged_into FROM e""",
    "hit AS (SELECT id FROM e WHERE merged_into <> '' AND expired_at IS NULL)"))
def merged_entities_expired(g: Graph) -> DataFrame:
    """Entities that were merged without being expired are."""
    merges = g.entities.filter("merged_into <> '' AND expired_at IS NULL").select("id", "merged_into")
    return commit.expire_entities(g.entities, merges, moment()).select("id", F.unix_micros("expired_at").alias("expired"), "merged_into")


@register(query("eg", f"""SELECT edge_id, epoch_us(CASE WHEN t_expired IS NULL AND edge_type = 'MENTIONS' AND to_node IN (SELECT id FROM e WHERE expired_at IS NOT NULL)
  THEN TIMESTAMPTZ '{MOMENT}+00' ELSE t_expired END) AS expired FROM g"""))
def mentions_of_expired_expired(g: Graph) -> DataFrame:
    """Mentions of expired entities are expired with them."""
    gone = g.view("entities", "expired_at IS NOT NULL").select(F.col("id").alias("to_node"))
    ids = g.view("edges", "edge_type = 'MENTIONS'", gone).select("edge_id")
    return commit.expire_edges(g.edges, ids, moment()).select("edge_id", F.unix_micros("t_expired").alias("expired"))


@register(query("g", "SELECT edge_id, edge_type FROM g WHERE edge_type IS NULL OR edge_type <> 'RELATED'"))
def edges_without_kind(g: Graph) -> DataFrame:
    return commit.delete_edges(g.edges, kind="RELATED").select("edge_id", "edge_type")


@register(query("g", """SELECT edge_id, edge_type FROM g WHERE from_node IS NULL OR from_node <> (
  SELECT from_node FROM g WHERE from_node IS NOT NULL GROUP BY from_node ORDER BY count(*) DESC, from_node LIMIT 1)"""))
def edges_without_busiest_node(g: Graph) -> DataFrame:
    """The edges that are left without those of the node that has most."""
    counts = g.edges.filter("from_node IS NOT NULL").groupBy("from_node").agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.orderBy(F.desc("n"), "from_node").first()
    return commit.delete_edges(g.edges, from_node=busiest[0] if busiest else "").select("edge_id", "edge_type")


@register(query("mv", "SELECT event_id, memory_id FROM v WHERE memory_id IN (SELECT id FROM m)"))
def events_of_known_memories(g: Graph) -> DataFrame:
    return commit.known_only(g.events, g.memories).select("event_id", "memory_id")


@register(query("mg", """SELECT id FROM m WHERE t_expired IS NULL AND kind = 'MEMORY' AND NOT EXISTS (SELECT 1 FROM g WHERE edge_type = 'MENTIONS' AND from_node = m.id)"""))
def extraction_queue_of_memories(g: Graph) -> DataFrame:
    """What awaits extraction, without summaries."""
    return backfill.memories_to_extract(g).select("id")


@register(query("mg", """SELECT id FROM m WHERE t_expired IS NULL AND kind = 'MEMORY' AND NOT EXISTS (SELECT 1 FROM g WHERE g.t_expired IS NULL
  AND ((edge_type = 'CONTAINS' AND to_node = m.id) OR (edge_type = 'MENTIONS' AND from_node = m.id)))"""))
def extraction_queue_of_orphans(g: Graph) -> DataFrame:
    return backfill.memories_to_extract(g, backfill.ORPHANED).select("id")


@register(query("mg", """SELECT edge_id FROM g WHERE edge_type IS DISTINCT FROM 'MENTIONS' OR from_node IS NULL OR from_node NOT IN (SELECT id FROM m WHERE t_expired IS NULL AND kind = 'MEMORY')"""))
def edges_before_reprocessing(g: Graph) -> DataFrame:
    """The edges that stay where all active memories get their mentions anew."""
    return backfill.without_mentions(g.edges, backfill.memories_to_extract(g, backfill.ALL)).select("edge_id")
