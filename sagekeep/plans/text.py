"""Queries over texts and sessions: blocks, chunks, extraction, summaries; and the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagekeep.operators import extract
from sagekeep.operators.graph import Graph
from sagekeep.plans.graph import register, rounded
from sagekeep.plans.sql import query
from sagekeep.runtime import materialise, shared_dir
from sagekeep.sources import chunking, sessions
from sagekeep.streaming import events as streams

_LINES = """lines AS (SELECT session_id, line_id, raw_line AS doc FROM session_lines WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' END
  QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY received_at) = 1),
said AS (SELECT session_id, line_id, lower(trim(coalesce(doc->>'$.message.role', doc->>'$.type'))) AS role, coalesce(doc->'$.message.content', doc->'$.content') AS content FROM lines),
parts AS (SELECT session_id, line_id, role, 0 AS pos, trim(content->>'$', concat(' ', chr(10), chr(13), chr(9))) AS text FROM said WHERE json_type(content) = 'VARCHAR'
  UNION ALL SELECT session_id, line_id, role, pos, trim(CASE json_type(b) WHEN 'VARCHAR' THEN b->>'$' ELSE b->>'$.text' END, concat(' ', chr(10), chr(13), chr(9))) FROM (
    SELECT session_id, line_id, role, unnest(json_extract(content, '$[*]')) AS b, generate_subscripts(json_extract(content, '$[*]'), 1) AS pos FROM said WHERE json_type(content) = 'ARRAY')
  WHERE json_type(b) = 'VARCHAR' OR coalesce(b->>'$.type', 'text') = 'text'),
blocks AS (SELECT session_id, line_id, role || ': ' || string_agg(text, chr(10) ORDER BY pos) AS block FROM parts WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY session_id, line_id, role)"""


#: The same with each line of a session once by its uuid, the smallest line_id of it.
_ONCE = _LINES.replace("lines AS (", "sent AS (", 1).replace("said AS (", """lines AS (SELECT session_id, line_id, doc FROM sent QUALIFY row_number() OVER (
  PARTITION BY session_id, CASE WHEN coalesce(doc->'$.uuid', 'null') IN ('null', '""') THEN 'line ' || line_id ELSE 'uuid ' || (doc->'$.uuid') END ORDER BY line_id) = 1),
said AS (""", 1)
_BLOCKS = "SELECT session_id, line_id, block FROM blocks"
_TEXT = "SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY line_id) AS text, count(*) AS blocks FROM blocks GROUP BY session_id"
_ASKED = """texts AS (SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY line_id) AS text FROM blocks GROUP BY session_id)
  SELECT session_id, CASE WHEN length(text) > 500 THEN '...' || right(text, 497) ELSE text END AS query FROM texts"""


# A line counts once by its uuid, in the queries as in their SQL.


@register(f"WITH {_ONCE} {_BLOCKS}")
def session_blocks(g: Graph) -> DataFrame:
    return sessions.session_blocks(g.table("session_lines")).select("session_id", "line_id", "block")


@register(f"WITH {_ONCE} {_TEXT}")
def session_text(g: Graph) -> DataFrame:
    return sessions.session_texts(sessions.session_blocks(g.table("session_lines")))


@register(f"WITH {_ONCE}, {_ASKED}")
def recall_queries(g: Graph) -> DataFrame:
    return sessions.recall_queries(sessions.session_texts(sessions.session_blocks(g.table("session_lines"))))


@register(f"WITH {_ONCE} {_BLOCKS}")
def session_blocks_once(g: Graph) -> DataFrame:
    return sessions.session_blocks(g.table("session_lines")).select("session_id", "line_id", "block")


@register(f"WITH {_ONCE} {_TEXT}")
def session_text_once(g: Graph) -> DataFrame:
    return sessions.session_texts(sessions.session_blocks(g.table("session_lines")))


@register(f"WITH {_ONCE}, {_ASKED}")
def recall_queries_once(g: Graph) -> DataFrame:
    return sessions.recall_queries(sessions.session_texts(sessions.session_blocks(g.table("session_lines"))))


@register("""SELECT session_id, epoch_us(min(try_cast(CASE WHEN json_valid(raw_line) THEN CASE WHEN json_type(raw_line) = 'OBJECT' THEN json_extract_string(raw_line, '$.timestamp') END END AS TIMESTAMPTZ))) AS earliest
  FROM session_lines WHERE raw_line IS NOT NULL GROUP BY session_id""")
def session_earliest_ts(g: Graph) -> DataFrame:
    return sessions.earliest_stamps(g.table("session_lines")).select("session_id", F.unix_micros("earliest").alias("earliest"))


@register("""WITH l AS (SELECT session_id, line_id, json_valid(raw_line) AS fine, CASE WHEN json_valid(raw_line) THEN CASE WHEN json_type(raw_line) = 'OBJECT'
    THEN lower(trim(coalesce(json_extract_string(raw_line, '$.message.role'), json_extract_string(raw_line, '$.type')))) END END AS role FROM session_lines WHERE trim(raw_line, concat(' ', chr(10), chr(13), chr(9))) <> ''),
  f AS (SELECT session_id, min(line_id) FILTER (NOT fine) AS broken, min(line_id) FILTER (role IN ('user', 'assistant')) AS spoken FROM l GROUP BY session_id)
  SELECT session_id, CASE WHEN spoken IS NOT NULL AND (broken IS NULL OR spoken < broken) THEN 'session' ELSE 'plain' END AS format FROM f""")
def session_formats(g: Graph) -> DataFrame:
    return sessions.detected_formats(g.table("session_lines"))


@register(None)
def char_chunks(g: Graph) -> DataFrame:
    """Documents cut by characters; tested against a plain scan, as SQL can't express it well."""
    found = chunking.char_chunks(g.table("documents"), "doc_id", "text", 800, 100, least_step=200)
    return found.select(F.col("id").alias("doc_id"), "sequence_no", "start_char", "length_chars")


@register(None)
def char_chunks_by_one(g: Graph) -> DataFrame:
    """Documents cut by characters with the least step of the surveyed system, which lets chunks crawl."""
    found = chunking.char_chunks(g.table("documents"), "doc_id", "text", 800, 100, least_step=1)
    return found.select(F.col("id").alias("doc_id"), "sequence_no", "start_char", "length_chars")


@register(None)
def block_chunks(g: Graph) -> DataFrame:
    """Sessions cut to chunks of whole blocks; tested against a plain scan."""
    blocks = sessions.session_blocks(g.table("session_lines"))
    return chunking.block_chunks(blocks, "session_id", "line_id", "block", "stamp", 1_000, 150).drop("earliest")


@register(query("mg", """SELECT DISTINCT links.chunk_id, links.id, x.id AS entity_id FROM (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL) links
  JOIN m ON m.id = links.id AND m.t_expired IS NULL JOIN (SELECT n.chunk_id, n.id, split_part(content, ' ', 2) AS canonical_name FROM (
    SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL) n JOIN m ON m.id = n.id WHERE m.t_expired IS NULL) x ON x.chunk_id = links.chunk_id
  WHERE length(x.canonical_name) > 0 AND contains(lower(m.content), lower(x.canonical_name))"""))
def substring_link(g: Graph) -> DataFrame:
    """Second words of memories, as names of their chunk, sought in all memories of it."""
    members = g.chunk_members().select("chunk_id", "id").join(g.memories.select("id", "content"), "id")
    names = members.select("chunk_id", F.col("id").alias("entity_id"), F.split_part("content", F.lit(" "), F.lit(2)).alias("canonical_name"))
    return extract.substring_links(members, names)


@register(query("meg", """SELECT DISTINCT members.chunk_id, members.id, x.entity_id FROM (SELECT chunk_id, id, content FROM (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL)
    JOIN m USING (id) WHERE t_expired IS NULL) members
  JOIN (SELECT l.chunk_id, e.id AS entity_id, canonical_name FROM (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'LINKED' AND t_expired IS NULL) l JOIN e ON e.id = l.id WHERE expired_at IS NULL) x
  ON x.chunk_id = members.chunk_id WHERE length(canonical_name) > 0 AND contains(lower(content), lower(canonical_name))"""))
def substring_entity_links(g: Graph) -> DataFrame:
    """Names of the entities that a chunk is linked to, sought in all memories of it."""
    members = g.chunk_members().select("chunk_id", "id").join(g.memories.select("id", "content"), "id")
    return extract.substring_links(members, g.chunk_entities().select("chunk_id", "entity_id", "canonical_name"))


_SENTENCE = r"regexp_extract(content, '^(?s)(.*?[.!?])(\s|$)', 1)"


@register(query("mg", """SELECT chunk_id, '# Chunk ' || chunk_id || chr(10) || chr(10) || '**Key Insights:**' || chr(10) || string_agg('- ' || CASE WHEN length(b) > 200 THEN substr(b, 1, 197) || '...' ELSE b END, chr(10) ORDER BY place) AS text,
    count(*) AS bullets FROM placed WHERE place <= 10 GROUP BY chunk_id HAVING count(*) >= 2""",
    "links AS (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL)",
    f"""placed AS (SELECT chunk_id, CASE WHEN {_SENTENCE} = '' THEN content ELSE {_SENTENCE} END AS b, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at, id) AS place
      FROM links JOIN m USING (id) WHERE t_expired IS NULL)"""))
def summary_render(g: Graph) -> DataFrame:
    members = g.chunk_members().select("chunk_id", "id", "created_at").join(g.memories.select("id", "content"), "id")
    return extract.summary_texts(members).select("chunk_id", "text", F.size("memory_ids").cast("long").alias("bullets"))


@register(query("mg", """SELECT s.summary AS from_node, id AS to_node, 'SUMMARIZES' AS edge_type FROM s JOIN (SELECT chunk_id, id FROM links JOIN m USING (id) WHERE t_expired IS NULL) USING (chunk_id)
  UNION ALL SELECT chunk_id, summary, kind FROM s, (VALUES ('CONTAINS'), ('SUMMARIZED_BY')) k(kind)""",
    "links AS (SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL)",
    """s AS (SELECT chunk_id, 'mem_' || substr(sha256('summary|' || chunk_id), 1, 16) AS summary FROM links JOIN m USING (id) WHERE t_expired IS NULL GROUP BY chunk_id HAVING count(*) >= 2)"""))
def summary_links(g: Graph) -> DataFrame:
    members = g.chunk_members().select("chunk_id", "id", "created_at").join(g.memories.select("id", "content"), "id")
    members = materialise(members, "chunk-members")
    return extract.summary_edges(extract.summary_texts(members), members)


@register(query("mg", """SELECT chunk_id, id, '[' || id || '] ' || CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS item FROM (
  SELECT DISTINCT from_node AS chunk_id, to_node AS id FROM g WHERE edge_type = 'CONTAINS' AND t_expired IS NULL) JOIN m USING (id) WHERE t_expired IS NULL"""))
def summary_items(g: Graph) -> DataFrame:
    members = g.chunk_members().select("chunk_id", "id").join(g.memories.select("id", "content"), "id")
    return extract.summary_items(members)


@register(None)
def extracted_mentions(g: Graph) -> DataFrame:
    """Entities found by rule in memories that await extraction, and the mentions that link them."""
    waiting = g.awaiting_extraction().select("id", "content")
    found = materialise(extract.extract_entities(waiting, "id", "content", extract.RuleExtractor()), "extracted")
    return extract.mention_edges(found, extract.entities_to_store(found, g.entities)).select("from_node", "to_node", rounded("confidence", "confidence"))


@register(None)
def extracted_memories(g: Graph) -> DataFrame:
    return extract.extract_memories(g.table("documents"), "doc_id", "text", extract.RuleExtractor()).select("id", "place", "content")


@register(None)
def hashed_embeddings(g: Graph) -> DataFrame:
    vectors = extract.embed_texts(g.memories.select("id", "content"), "content", extract.HashedEmbedder(64), 64)
    return vectors.select("id", "vector")


# Streams, run over the whole event log

#: Id and moment of the record that closes a finite log; windows from that moment on aren't results.
_END_ID = "end of the log"


def _end() -> Column:
    return F.lit("2200-01-01T00:00:00+00:00").cast("timestamp")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """All available input through a stream, its output read as a table."""
    spark = stream.sparkSession
    target, state = shared_dir(spark, "stream"), shared_dir(spark, "stream-state")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", target)
    else:  # a file sink only appends; updates are written batch by batch
        writer = stream.writeStream.foreachBatch(lambda batch, epoch: batch.write.parquet(f"{target}/batch={epoch}"))
    writer.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _event_stream(g: Graph, closed: bool = False) -> DataFrame:
    """The event log as a stream; written once as files of its own, as a table may be a single file.

    A ``closed`` one ends with a record far in the future, so that the watermark
    passes all windows of the log. The window of that record itself never comes out.
    """
    folder = shared_dir(g.spark, "event-log")
    g.events.write.parquet(folder)
    if closed:
        known = {"event_id": F.lit(_END_ID), "memory_id": F.lit(_END_ID), "occurred_at": _end()}
        end = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in g.events.schema]
        g.spark.range(1).select(*end).write.mode("append").parquet(folder)
    return g.spark.readStream.schema(g.events.schema).parquet(folder)


@register(query("v", """SELECT memory_id AS id, round(1 + 0.35 * ln(1 + sum(w)), 6) AS multiplier, count(*) AS n FROM (
  SELECT memory_id, exp(-(max(t) OVER (PARTITION BY memory_id) - t) / 86400000.0 / 21.0) * CASE WHEN (lag(t) OVER (PARTITION BY memory_id ORDER BY t DESC) - t) / 3600000.0 < 24.0 THEN 0.2 ELSE 1.0 END AS w
  FROM (SELECT memory_id, epoch_ms(occurred_at) AS t FROM v WHERE memory_id IS NOT NULL AND occurred_at IS NOT NULL AND starts_with(event_type, 'REINFORCE'))) GROUP BY memory_id"""))
def streaming_reinforcement(g: Graph) -> DataFrame:
    log = _event_stream(g).filter(F.col("event_type").startswith("REINFORCE"))
    found = _run(streams.reinforcement_trace(log), "update")
    latest = found.groupBy(F.col("memory_id").alias("id")).agg(F.max_by("multiplier", "at_ms").alias("multiplier"))
    counts = g.events.filter(F.col("event_type").startswith("REINFORCE") & F.col("memory_id").isNotNull() & F.col("occurred_at").isNotNull())
    counts = counts.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return latest.join(counts, "id").select("id", rounded("multiplier", "multiplier"), "n")


@register(query("v", """SELECT strftime(make_timestamp(epoch_us(occurred_at)), '%Y-%m-%d') AS day, event_type, count(*) AS events
  FROM v WHERE occurred_at IS NOT NULL GROUP BY 1, 2"""))
def streaming_daily_counts(g: Graph) -> DataFrame:
    found = _run(streams.daily_counts(_event_stream(g, closed=True)), "append").filter(F.col("day") < _end())
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events")


@register(query("v", """SELECT memory_id, min(t) AS first, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY memory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT memory_id, event_id, epoch_us(occurred_at) AS t, CASE WHEN epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY memory_id ORDER BY epoch_us(occurred_at), event_id) < 86400000000 THEN 0 ELSE 1 END AS fresh
    FROM v WHERE memory_id IS NOT NULL AND occurred_at IS NOT NULL)) GROUP BY memory_id, burst"""))
def streaming_bursts(g: Graph) -> DataFrame:
    found = _run(streams.bursts(_event_stream(g, closed=True)), "append").filter(F.col("first") < _end())
    return found.select("memory_id", F.unix_micros("first").alias("first"), "events")
