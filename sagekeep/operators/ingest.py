"""From documents and single memories to the graph: chunks, decisions, entities, edges, events and summaries of one batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagekeep.functions.text import identifier
from sagekeep.operators import commit, extract
from sagekeep.runtime import materialise, strip
from sagekeep.schemas import conform
from sagekeep.sources import chunking, sessions
from sagekeep.sources.store import Store


@dataclass(frozen=True)
class IngestConfig:
    chunk_size: int = 20_000
    chunk_overlap: int = 500
    least_step: int = 1
    least_memory_confidence: float = 0.0
    least_entity_confidence: float = 0.75
    rules: commit.Hygiene = field(default_factory=commit.Hygiene)
    extractor: extract.Extractor = field(default_factory=extract.RuleExtractor)
    embedder: extract.Embedder = field(default_factory=extract.HashedEmbedder)
    #: Called with the decided rows of a batch (id, outcome, matched, reason, content, content_hash) once it is stored.
    on_commit: Callable[[DataFrame], None] | None = None
    #: How files are read: by what they hold, or all as one of the other two.
    source_format: str = "auto"


#: The formats of files.
FORMATS = ("auto", "plain", "session")
STORED = ("memories", "entities", "edges", "memory_events", "chunks", "sources")


def _no_tags() -> Column:
    return F.lit(None).cast("array<string>")


def full_edges(rows: DataFrame, moment: Column) -> DataFrame:
    """Edges in full from from_node, to_node, edge_type and what else is known of them."""
    full = rows.withColumn("edge_id", identifier("edge_", "from_node", "to_node", "edge_type"))
    return conform(full.withColumn("t_created", moment).withColumn("t_valid", moment), "edges")


def ingest(spark: SparkSession, store: Store, documents: DataFrame, moment: Column, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Add documents (path, text, modified) to a store, all of it or nothing; gives the counts of what was done.

    Session files are cut to chunks of whole messages, other texts by characters.
    A memory is valid from the earliest time stamp of its chunk, else of its
    session, else from when its file was modified, else from ``moment``.
    Near and exact duplicates only reinforce what they repeat. Chunks with two new
    memories or more get a summary. Ids are made of contents and of the store's version, so a batch that is
    ingested again after a failure gives the same rows.
    """
    if config.source_format not in FORMATS:
        raise ValueError(f"unknown format {config.source_format!r}; known are {', '.join(FORMATS)}")
    since = store.version()
    old = {name: store.read(name) for name in STORED}
    files = documents.withColumn("source_id", identifier("source_", "path", F.sha2("text", 256)))
    sources = conform(
        files.select(
            "source_id", F.lit("file").alias("source_type"), F.col("modified").alias("created_at"), moment.alias("ingested_at"),
            F.sha2("text", 256).alias("source_hash"), "path",
        ),
        "sources",
    )
    sources = sources.join(old["sources"].select("source_id"), "source_id", "left_anti")
    cut = _chunks(files, config).withColumn("chunk_id", identifier("chunk_", "source_id", F.col("sequence_no").cast("string")))
    cut = cut.join(files.select("source_id", "path", "modified"), "source_id")
    cut = cut.withColumn("valid", F.coalesce("earliest", "of_session", "modified", moment))
    cut = materialise(cut.withColumn("created_at", moment), "chunks")
    found = extract.extract_memories(cut, "chunk_id", "text", config.extractor, config.least_memory_confidence)
    found = found.withColumnRenamed("id", "chunk_id").join(cut.select("chunk_id", "source_id", "sequence_no", "valid"), "chunk_id")
    found = found.withColumn("id", identifier("mem_", "chunk_id", F.col("place").cast("string"), F.lit(since or "")))
    found = extract.embed_texts(found, "content", config.embedder, config.rules.dim)
    incoming = materialise(
        found.select(
            "id", "chunk_id", "source_id", "content", "vector", F.lit("file").alias("source"), "valid",
            (F.col("sequence_no").cast("long") * 2**32 + F.col("place")).alias("place"), _no_tags().alias("tags"),
        ),
        "incoming",
    )
    return _store(store, since, old, sources, cut, incoming, moment, config)


def add_memories(spark: SparkSession, store: Store, contents: DataFrame, moment: Column, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Add single memories (content, and if there are source, tags, agent, session_id) to a store; gives the counts of what was done.

    Each agent's session is a source of its own in each batch; without an agent it
    is ``cli``, without a source a memory is ``manual``. Memories go the way of a
    document's, without a chunk; equal rows are decided in the order of their ids.
    """
    since = store.version()
    old = {name: store.read(name) for name in STORED}
    for name, default in {"source": F.lit("manual"), "tags": _no_tags(), "agent": F.lit("cli"), "session_id": F.lit(None).cast("string")}.items():
        contents = contents.withColumn(name, F.coalesce(name, default) if name in contents.columns else default)
    origin = identifier("source_", "agent", F.coalesce("session_id", F.lit("")), F.lit(since or ""))
    rows = contents.filter("content IS NOT NULL").withColumn("source_id", origin)
    sources = rows.select("source_id", "agent", "session_id").distinct().select(
        "*", F.lit("agentic").alias("source_type"), moment.alias("created_at"), moment.alias("ingested_at"),
        F.to_json(F.struct(F.lit("add").alias("command"))).alias("metadata"),
    )
    rows = rows.groupBy("source_id", "content", "source").agg(F.min("tags").alias("tags"), F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rows = rows.withColumn("id", identifier("mem_", "source_id", "source", F.col("time").cast("string"), "content"))
    rows = extract.embed_texts(rows, "content", config.embedder, config.rules.dim)
    nothing = F.lit(None).cast("string").alias("chunk_id")
    incoming = rows.select("id", nothing, "source_id", "content", "vector", "source", moment.alias("valid"), F.lit(0).cast("long").alias("place"), "tags")
    cut = old["chunks"].filter("false").withColumn("path", F.lit(None).cast("string"))
    return _store(store, since, old, conform(sources, "sources"), cut, materialise(incoming, "incoming"), moment, config)


def _store(
    store: Store, since: str | None, old: dict[str, DataFrame], sources: DataFrame, cut: DataFrame, incoming: DataFrame, moment: Column, config: IngestConfig
) -> DataFrame:
    """Decide the rows of a batch and append all that follows from them, in one commit."""
    decided = materialise(commit.decide(old["memories"], incoming, config.rules), "decided")
    fresh = decided.filter("outcome = 'INSERTED_NEW'").join(incoming.select("id", "vector", "chunk_id", "source_id", "valid", "source", "tags"), "id")
    about = F.struct("source", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))
    memories = fresh.select(
        "id", "content", F.col("vector").alias("content_embedding"), "content_hash", moment.alias("created_at"),
        F.to_json(about).alias("metadata"), F.lit("MEMORY").alias("kind"), F.col("valid").alias("t_valid"),
        moment.alias("t_created"), F.lit("unknown").alias("temporal_stability"), F.lit(0).alias("reinforce_count"), "chunk_id", "source_id",
    )
    memories = materialise(memories, "new-memories")
    mentions = materialise(extract.extract_entities(memories, "id", "content", config.extractor), "mentions")
    stored = materialise(extract.entities_to_store(mentions, old["entities"], config.least_entity_confidence), "to-store")
    entities = new_entities(stored, moment, config)
    in_chunks = memories.filter("chunk_id IS NOT NULL")
    summaries = materialise(extract.summary_texts(in_chunks.select("chunk_id", "id", "content", "created_at")), "summaries")
    summary_rows = summaries.select(
        identifier("mem_", F.lit("summary"), "chunk_id").alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
        moment.alias("created_at"), F.lit("SUMMARY").alias("kind"), moment.alias("t_valid"), moment.alias("t_created"), F.lit("static").alias("temporal_stability"),
    )
    summary_rows = extract.embed_texts(summary_rows, "content", config.embedder, config.rules.dim).withColumnRenamed("vector", "content_embedding")
    # Exact duplicates keep their provenance, near ones don't.
    placed = decided.filter("outcome IN ('INSERTED_NEW', 'EXACT_DUPE')").join(incoming.select("id", "chunk_id", "source_id"), "id")
    kinds = F.explode(F.array(F.struct(F.col("source_id").alias("f"), F.lit("PRODUCED").alias("k")), F.struct(F.col("chunk_id").alias("f"), F.lit("CONTAINS").alias("k")))).alias("x")
    provenance = placed.select(F.col("matched").alias("to_node"), kinds).select(F.col("x.f").alias("from_node"), "to_node", F.col("x.k").alias("edge_type"))
    provenance = provenance.filter("from_node IS NOT NULL")
    linked = extract.mention_edges(mentions, stored, config.least_entity_confidence).withColumn("edge_type", F.lit("MENTIONS"))
    chunk_links = linked.join(in_chunks.select(F.col("id").alias("from_node"), "chunk_id"), "from_node").groupBy(F.col("chunk_id").alias("from_node"), "to_node")
    chunk_links = chunk_links.agg(F.max("confidence").alias("confidence")).withColumn("edge_type", F.lit("LINKED"))
    more = [provenance, linked, chunk_links, extract.summary_edges(summaries, in_chunks.select("chunk_id", "id"))]
    added = None
    for part in more:
        rows = full_edges(part, moment)
        added = rows if added is None else added.unionByName(rows)
    added = materialise(conform(commit.upsert_edges(old["edges"], added), "edges"), "new-edges")
    origins = incoming.select("id", "source")
    events = conform(commit.commit_events(decided.join(origins, "id"), moment, "source"), "memory_events")
    extracted = mentions.filter(F.col("confidence") >= config.least_entity_confidence).groupBy(F.col("id").alias("memory_id"))
    extracted = extracted.agg(F.count_distinct("norm_key").alias("entity_count")).select(
        identifier("evt_", F.lit("entities"), "memory_id").alias("event_id"), "memory_id", F.lit("ENTITY_EXTRACTED").alias("event_type"),
        moment.alias("occurred_at"), F.lit("system").alias("source"),
        F.to_json(F.struct("entity_count", F.lit(config.least_entity_confidence).alias("min_confidence"))).alias("payload"),
    )
    told = in_chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("memory_count")).join(cut.select("chunk_id", "path"), "chunk_id")
    summarised = summaries.select("chunk_id").join(told, "chunk_id").select(
        identifier("evt_", F.lit("summary"), "chunk_id").alias("event_id"), identifier("mem_", F.lit("summary"), "chunk_id").alias("memory_id"),
        F.lit("SUMMARY_CREATED").alias("event_type"), moment.alias("occurred_at"), F.lit("summary_generation").alias("source"),
        F.col("path").alias("artifact_ref"), F.to_json(F.struct("memory_count")).alias("payload"),
    )
    events = events.unionByName(conform(extracted, "memory_events")).unionByName(conform(summarised, "memory_events"))
    events = events.join(old["memory_events"].select("event_id"), "event_id", "left_anti")
    new_memories = conform(memories, "memories").unionByName(conform(summary_rows, "memories"))
    new_memories = new_memories.join(old["memories"].select("id"), "id", "left_anti")
    new_chunks = conform(cut, "chunks").join(old["chunks"].select("chunk_id"), "chunk_id", "left_anti")
    store.append(
        since,
        memories=conform(new_memories, "memories"),
        entities=conform(entities, "entities"),
        edges=added,
        memory_events=conform(events, "memory_events"),
        chunks=conform(new_chunks, "chunks"),
        sources=conform(sources, "sources"),
    )
    if config.on_commit is not None:
        config.on_commit(decided)
    return decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def new_entities(stored: DataFrame, moment: Column, config: IngestConfig) -> DataFrame:
    """The rows of the entities that aren't stored yet, with vectors of their names in lower case."""
    rows = stored.filter("is_new").select(F.col("entity_id").alias("id"), "entity_type", "canonical_name", "norm_key", moment.alias("created_at"))
    rows = extract.embed_texts(rows, "canonical_name", config.embedder, config.rules.dim, lower=True)
    return rows.withColumnRenamed("vector", "embedding")


def _chunks(files: DataFrame, config: IngestConfig) -> DataFrame:
    """source_id, sequence_no, start_char, length_chars, text, earliest, of_session of the chunks of all files.

    A session is a file of JSON lines that says a role before any line is broken;
    only files that begin with an object are parsed to find that out. Chunks of
    messages have no place in the file's characters, so their start is null.
    """
    maybe = files.filter("false") if config.source_format == "plain" else files
    maybe = maybe.filter(F.startswith(strip("text"), F.lit("{"))) if config.source_format == "auto" else maybe
    lines = materialise(sessions.text_lines(maybe.select(F.col("source_id").alias("path"), "text")).withColumnRenamed("path", "session_id"), "lines")
    if config.source_format == "auto":
        spoken = sessions.detected_formats(lines).filter("format = 'session'").select(F.col("session_id").alias("source_id"))
    else:
        spoken = maybe.select("source_id").distinct()
    spoken = materialise(spoken, "session-files")
    plain = files.join(spoken, "source_id", "left_anti")
    columns = ["source_id", "sequence_no", "start_char", "length_chars", "text", "earliest", "of_session"]
    by_chars = chunking.char_chunks(plain, "source_id", "text", config.chunk_size, config.chunk_overlap, config.least_step)
    nothing = F.lit(None).cast("timestamp")
    by_chars = by_chars.withColumnRenamed("id", "source_id").withColumn("earliest", nothing).withColumn("of_session", nothing).select(columns)
    said = lines.join(spoken.withColumnRenamed("source_id", "session_id"), "session_id", "left_semi")
    blocks = sessions.session_blocks(said)
    by_blocks = chunking.block_chunks(blocks, "session_id", "line_id", "block", "stamp", config.chunk_size, config.chunk_overlap)
    by_blocks = by_blocks.join(sessions.earliest_stamps(said).withColumnRenamed("earliest", "of_session"), "session_id", "left")
    by_blocks = by_blocks.withColumn("start_char", F.lit(None).cast("long")).withColumn("length_chars", F.length("text").cast("long"))
    return by_chars.unionByName(by_blocks.withColumnRenamed("session_id", "source_id").select(columns))
