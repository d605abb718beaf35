"""Upkeep of a store: entities of memories that have none yet, and vectors made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagekeep.operators import commit, extract
from sagekeep.operators.graph import Graph
from sagekeep.operators.ingest import STORED, IngestConfig, full_edges, new_entities
from sagekeep.runtime import materialise
from sagekeep.schemas import conform
from sagekeep.sources.store import Store

#: Which memories are looked at.
WAITING, ALL, ORPHANED = "waiting", "all", "orphaned"


def memories_to_extract(graph: Graph, which: str = WAITING) -> DataFrame:
    """id, content of the active memories (summaries aren't among them) that get their entities.

    ``waiting`` have no mention, active or expired; ``orphaned`` no active one and
    no chunk; ``all`` are all.
    """
    if which == ORPHANED:
        rows = graph.orphaned_memories().filter("kind = 'MEMORY'")
    elif which in (WAITING, ALL):
        rows = graph.awaiting_extraction(which == ALL, "MEMORY")
    else:
        raise ValueError(f"expected {WAITING}, {ALL} or {ORPHANED}, got {which!r}")
    return rows.select("id", "content")


def without_mentions(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """``edges`` without the mentions that go out of ``memories`` (id)."""
    redone = memories.select(F.col("id").alias("from_node"), F.lit("MENTIONS").alias("edge_type")).distinct()
    return edges.join(redone, ["from_node", "edge_type"], "left_anti").select(edges.columns)


def link_entities(store: Store, moment: Column, config: IngestConfig = IngestConfig(), which: str = WAITING) -> DataFrame:
    """Find entities in stored memories and link them, in one commit; gives counter, value.

    With ``all`` the mentions of memories in which something is found are made
    anew; those of the others stay. Entities of a known key aren't stored again.
    Running it twice adds nothing the second time.
    """
    since = store.version()
    old = {name: store.read(name) for name in STORED}
    rows = materialise(memories_to_extract(Graph(store.spark, store.root, **old), which), "to-extract")
    found = materialise(extract.extract_entities(rows, "id", "content", config.extractor), "mentions")
    stored = materialise(extract.entities_to_store(found, old["entities"], config.least_entity_confidence), "to-store")
    entities = materialise(conform(new_entities(stored, moment, config), "entities"), "new-entities")
    kept = without_mentions(old["edges"], found) if which == ALL else old["edges"]
    linked = extract.mention_edges(found, stored, config.least_entity_confidence).withColumn("edge_type", F.lit("MENTIONS"))
    added = materialise(conform(commit.upsert_edges(kept, full_edges(linked, moment)), "edges"), "new-edges")
    if which == ALL:
        store.change({"edges": kept.unionByName(added)}, {"entities": entities}, since)
    else:
        store.append(since, entities=entities, edges=added)
    counts = {"memories_processed": rows, "entities_created": entities, "edges_created": added}
    totals = None
    for name, frame in counts.items():
        part = frame.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("value"))
        totals = part if totals is None else totals.unionByName(part)
    return totals


def embed_anew(store: Store, table: str, config: IngestConfig = IngestConfig(), limit: int | None = None) -> DataFrame:
    """Make the vectors of all memories, or of the active entities, anew; gives the numbers of embedded and failed texts.

    Entities are embedded by their names in lower case. A text for which the model
    fails keeps its old vector. ``limit`` takes that many records, newest first.
    """
    since, old = store.version(), store.read(table)
    of_entities = table == "entities"
    text, vector = ("canonical_name", "embedding") if of_entities else ("content", "content_embedding")
    rows = old.filter(F.col(text).isNotNull() & (F.col("expired_at").isNull() if of_entities else F.lit(True)))
    rows = rows if limit is None else rows.orderBy(F.desc("created_at"), "id").limit(limit)
    made = extract.embed_texts(rows.select("id", text), text, config.embedder, config.rules.dim, lower=of_entities, keep_going=True)
    made = materialise(made.select("id", "vector"), "vectors")
    store.change({table: commit.set_vectors(old, made.filter("vector IS NOT NULL"), vector)}, {}, since)
    return made.agg(F.count("vector").alias("embedded"), F.count_if(F.col("vector").isNull()).alias("failed"))
