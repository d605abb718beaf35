"""The tables of the memory graph as views, and the relational access paths over them.

Tables may hold rows delivered more than once; the views hold each record once, by
its id: of a memory the version seen last, of the others any (they are identical).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.operators.vector import cosine_to, usable
from sagekeep.runtime import read_table


#: The key of each table's records, and what tells their versions apart, newest first.
VERSIONS = {
    "memories": ("id", ("last_seen_at", "reinforce_count")),
    "entities": ("id", ("created_at",)),
    "edges": ("edge_id", ("t_created",)),
    "memory_events": ("event_id", ("occurred_at",)),
    "chunks": ("chunk_id", ("created_at",)),
    "sources": ("source_id", ("ingested_at",)),
}


def newest_version(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``; rows without a key are left out."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.filter(F.col(key).isNotNull()).withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def confident(least: float, column: str = "confidence") -> Column:
    """An edge without a confidence passes, as does one of at least ``least``."""
    return F.col(column).isNull() | (F.col(column) >= least)


class Graph:
    """Views of the tables under ``root``; pass frames to replace single tables."""

    def __init__(self, spark: SparkSession, root: str, **frames: DataFrame) -> None:
        self.spark, self.root, self.frames = spark, root, frames

    def table(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else read_table(self.spark, self.root, name)

    def view(self, name: str, where: Column | str | None = None, among: DataFrame | None = None) -> DataFrame:
        """The records of a table, each once, of which ``where`` holds.

        The versions of a record agree in all columns but a memory's last_seen_at
        and reinforce_count, so conditions on other columns are applied before the
        versions are told apart: they reach the scan, and less is exchanged. So is
        ``among``, whose only column names one of the table's: records with other
        values of it are left out first.
        """
        rows = self.table(name)
        rows = rows if where is None else rows.filter(where)
        return self.once(name, rows if among is None else rows.join(among, among.columns[0], "left_semi"))

    def once(self, name: str, rows: DataFrame) -> DataFrame:
        """The newest version of each record among rows of a table."""
        key, order = VERSIONS[name]
        return newest_version(rows, key, *(F.desc_nulls_last(column) for column in order))

    def memory_view(self, where: Column | str | None = None, among: DataFrame | None = None) -> DataFrame:
        """Memories, with the defaults of missing kind, stability and count."""
        return self._completed(self.view("memories", where, among))

    @staticmethod
    def _completed(memories: DataFrame) -> DataFrame:
        defaults = {"kind": F.lit("MEMORY"), "temporal_stability": F.lit("unknown"), "reinforce_count": F.lit(0)}
        return memories.withColumns({name: F.coalesce(name, value) for name, value in defaults.items() if name in memories.columns})

    def compared_memories(self, query: list[float], columns: list[str], where: Column | str | None = None) -> DataFrame:
        """``columns`` and ``similarity`` to a vector of the memories that have a usable one.

        The cosine is taken in the scan, so that neither vectors nor contents that
        aren't asked for are exchanged.
        """
        rows = self.table("memories")
        rows = (rows if where is None else rows.filter(where)).filter(usable("content_embedding", len(query)))
        kept = dict.fromkeys(["id", *columns, *VERSIONS["memories"][1]])
        rows = rows.select(*kept, cosine_to("content_embedding", query).alias("similarity"))
        return self._completed(self.once("memories", rows)).select(*columns, "similarity")

    def edge_view(self, where: Column | str | None = None, among: DataFrame | None = None) -> DataFrame:
        """Edges; a missing weight is 1, other weights (0 too) stay."""
        return self.view("edges", where, among).withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    @cached_property
    def memories(self) -> DataFrame:
        return self.memory_view()

    @cached_property
    def entities(self) -> DataFrame:
        return self.view("entities")

    @cached_property
    def edges(self) -> DataFrame:
        return self.edge_view()

    @cached_property
    def events(self) -> DataFrame:
        return self.view("memory_events")

    @cached_property
    def chunks(self) -> DataFrame:
        return self.view("chunks")

    @cached_property
    def sources(self) -> DataFrame:
        return self.view("sources")

    # Scans and filters

    def active_memories(self) -> DataFrame:
        return self.memory_view("t_expired IS NULL")

    def listed_memories(self, include_expired: bool = False, limit: int | None = None) -> DataFrame:
        """The columns of a listing, newest first."""
        rows = self.memories if include_expired else self.active_memories()
        rows = rows.select("id", "kind", "content", "created_at", "t_expired").orderBy(F.desc("created_at"), "id")
        return rows if limit is None else rows.limit(limit)

    def by_id(self, table: str, key: str, value: str) -> DataFrame:
        """The one record of an id; the filter reaches the scan."""
        views = {"memories": self.memory_view, "edges": self.edge_view}
        where = F.col(key) == value
        return views[table](where) if table in views else self.view(table, where)

    def active_entities(self, entity_type: str | None = None) -> DataFrame:
        where = F.col("expired_at").isNull()
        return self.view("entities", where if entity_type is None else where & (F.col("entity_type") == entity_type))

    def entities_by_key(self, keys: DataFrame, include_expired: bool = False) -> DataFrame:
        """For each of ``keys`` (norm_key) the entity of that key, the earliest where there are several."""
        rows = self.entities if include_expired else self.active_entities()
        first = rows.groupBy("norm_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("entity_id"))
        return keys.select("norm_key").distinct().join(first, "norm_key", "left")

    def active_edges(self, *kinds: str) -> DataFrame:
        where = F.col("t_expired").isNull()
        return self.edge_view(where & F.col("edge_type").isin(*kinds) if kinds else where)

    def affects(self, among: DataFrame | None = None) -> DataFrame:
        """Events seen as edges to their memories (memory_id in ``among`` where it is given): without weight, confidence and expiry."""
        return self.view("memory_events", "memory_id IS NOT NULL", among).select(
            F.col("event_id").alias("from_node"), F.col("memory_id").alias("to_node"), F.lit("AFFECTS").alias("edge_type")
        )

    def all_links(self) -> DataFrame:
        """from_node, to_node, edge_type of all edges, events among them."""
        return self.edges.select("from_node", "to_node", "edge_type").unionByName(self.affects())

    def events_of_memories(self, limit: int = 100, reinforcing: bool = False) -> DataFrame:
        """The newest ``limit`` events of each memory, newest first; all of reinforcing ones where asked for."""
        where = F.col("memory_id").isNotNull()
        rows = self.view("memory_events", where & F.col("event_type").startswith("REINFORCE") if reinforcing else where)
        rank = F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("occurred_at"), "event_id"))
        return rows.withColumn("place", rank).filter(F.col("place") <= limit)

    def awaiting_extraction(self, reprocess: bool = False, kind: str | None = None) -> DataFrame:
        """Active memories (of one kind, if it is given) without any MENTIONS edge, expired edges included; oldest first."""
        rows = self.active_memories()
        rows = rows if kind is None else rows.filter(F.col("kind") == kind)
        if not reprocess:
            linked = self.edge_view("edge_type = 'MENTIONS'").select(F.col("from_node").alias("id"))
            rows = rows.join(linked, "id", "left_anti")
        return rows.orderBy("created_at", "id")

    def source_labels(self) -> DataFrame:
        """Each source with its path, or else its agent."""
        return self.sources.withColumn("label", F.coalesce(F.nullif("path", F.lit("")), "agent"))

    def latest_file_sources(self) -> DataFrame:
        """path, source_id: of the file sources of one path the one ingested last."""
        files = self.view("sources", "source_type = 'file' AND path IS NOT NULL")
        return files.groupBy("path").agg(F.max_by("source_id", F.struct("ingested_at", "source_id")).alias("source_id"))

    # Joins along edges

    def along(self, kind: str, include_expired: bool = False, least: float | None = None, among: DataFrame | None = None) -> DataFrame:
        """edge_id, from_node, to_node, weight, confidence, t_created of one kind of edge, from or to ``among`` where it is given."""
        where = F.col("edge_type") == kind
        if not include_expired:
            where &= F.col("t_expired").isNull()
        if least is not None:
            where &= confident(least)
        return self.edge_view(where, among).select("edge_id", "from_node", "to_node", "weight", "confidence", "t_created")

    def chunk_members(self, include_expired: bool = False) -> DataFrame:
        """chunk_id, id, kind of the memories that each chunk contains."""
        members = self.memories if include_expired else self.active_memories()
        links = self.along("CONTAINS").select(F.col("from_node").alias("chunk_id"), F.col("to_node").alias("id"))
        return links.distinct().join(members.select("id", "kind", "created_at"), "id")

    def chunk_of_memory(self) -> DataFrame:
        """id, chunk_id: the earliest chunk that contains a memory."""
        links = self.along("CONTAINS").select(F.col("from_node").alias("chunk_id"), F.col("to_node").alias("id"))
        found = links.join(self.chunks.select("chunk_id", "created_at"), "chunk_id")
        return found.groupBy("id").agg(F.min_by("chunk_id", F.struct("created_at", "chunk_id")).alias("chunk_id"))

    def chunk_entities(self) -> DataFrame:
        """chunk_id, entity_id, canonical_name of the entities that chunks are linked to."""
        links = self.along("LINKED").select(F.col("from_node").alias("chunk_id"), F.col("to_node").alias("id"))
        names = self.active_entities().select("id", "canonical_name")
        return links.distinct().join(names, "id").withColumnRenamed("id", "entity_id")

    def artifact_summaries(self) -> DataFrame:
        """artifact_ref, id: the latest summary that an event of an artifact made."""
        made = self.view("memory_events", "event_type = 'SUMMARY_CREATED' AND artifact_ref IS NOT NULL")
        summaries = self.memory_view("kind = 'SUMMARY'").select("id", "created_at")
        found = made.select("artifact_ref", F.col("memory_id").alias("id")).join(summaries, "id")
        return found.groupBy("artifact_ref").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))

    def mention_counts(self) -> DataFrame:
        """All active entities and the number of active mentions, none included."""
        mentions = self.along("MENTIONS").select(F.col("to_node").alias("id"), "edge_id")
        counts = mentions.groupBy("id").agg(F.count("edge_id").alias("mentions"))
        return self.active_entities().join(counts, "id", "left").fillna(0, ["mentions"])

    def _active_ends(self, kind: str, end: str) -> DataFrame:
        return self.along(kind).select(F.col(end).alias("id"))

    def orphaned_memories(self) -> DataFrame:
        """Active memories that no chunk contains and that mention nothing."""
        return (
            self.active_memories()
            .join(self._active_ends("CONTAINS", "to_node"), "id", "left_anti")
            .join(self._active_ends("MENTIONS", "from_node"), "id", "left_anti")
        )

    def memories_without_source(self, strict: bool = False) -> DataFrame:
        """Active memories that no chunk contains; ``strict`` also accepts a PRODUCED edge as a source."""
        rows = self.active_memories().join(self._active_ends("CONTAINS", "to_node"), "id", "left_anti")
        return rows.join(self._active_ends("PRODUCED", "to_node"), "id", "left_anti") if strict else rows

    def node_labels(self, length: int = 40) -> DataFrame:
        """node, label: the content of memories and the names of entities, cut to ``length``."""
        from sagekeep.functions.text import preview

        memories = self.memories.select(F.col("id").alias("node"), preview("content", length).alias("label"))
        entities = self.entities.select(F.col("id").alias("node"), preview("canonical_name", length).alias("label"))
        return memories.unionByName(entities)

    # Counts

    def in_degrees(self) -> DataFrame:
        """id, degree: edges of every kind into a node, expired ones left out, events counted as edges."""
        links = self.active_edges().select("to_node").unionByName(self.affects().select("to_node"))
        return links.filter("to_node IS NOT NULL").groupBy(F.col("to_node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def kind_counts(self) -> DataFrame:
        return self.memories.groupBy("kind").agg(F.count(F.lit(1)).alias("memories"))

    def edge_counts(self) -> DataFrame:
        """Edges of each kind, expired ones and events included."""
        return self.all_links().groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))

    def linked_memory_counts(self) -> DataFrame:
        """How many distinct memories have an edge of each kind going out."""
        return (
            self.edges.join(self.memories.select(F.col("id").alias("from_node")), "from_node", "left_semi")
            .groupBy("edge_type")
            .agg(F.count_distinct("from_node").alias("memories"))
        )

    def reinforcement_state(self) -> DataFrame:
        """id, reinforcements, last_seen_at derived from the event log rather than from stored counters."""
        rows = self.view("memory_events", F.col("event_type").startswith("REINFORCE") & F.col("memory_id").isNotNull())
        return rows.groupBy(F.col("memory_id").alias("id")).agg(
            F.count(F.lit(1)).alias("reinforcements"), F.max("occurred_at").alias("last_seen_at")
        )

    def health_report(self) -> DataFrame:
        """counter, value: the counters of a housekeeping report.

        Memories are read once, with what the edges at each of them say; the
        links of a node are reduced to three flags before they meet.
        """
        links = self.view("edges", F.col("edge_type").isin("CONTAINS", "MENTIONS"))
        active, mentions = F.col("t_expired").isNull(), F.col("edge_type") == "MENTIONS"
        node = F.when(mentions, F.col("from_node")).otherwise(F.col("to_node"))
        flags = links.groupBy(node.alias("id")).agg(
            F.coalesce(F.bool_or(active & ~mentions), F.lit(False)).alias("contained"),
            F.coalesce(F.bool_or(active & mentions), F.lit(False)).alias("mentioning"),
            F.coalesce(F.bool_or(mentions), F.lit(False)).alias("extracted"),
        )
        rows = self.memories.select("id", "kind", "t_expired").join(flags, "id", "left").fillna(False, ["contained", "mentioning", "extracted"])
        alone = active & ~F.col("contained")
        of_memories = {
            "memories": F.col("kind") == "MEMORY",
            "summaries": F.col("kind") == "SUMMARY",
            "expired_memories": ~active,
            "orphaned_memories": alone & ~F.col("mentioning"),
            "memories_without_source": alone,
            "awaiting_extraction": active & ~F.col("extracted"),
        }
        expired = F.max(F.col("expired_at").isNotNull()).alias("expired")
        entities = self.table("entities").filter("id IS NOT NULL").groupBy("id").agg(expired)
        edges = self.table("edges").filter("edge_id IS NOT NULL").select("edge_id").distinct()
        parts = [
            rows.agg(*(F.count_if(where).alias(name) for name, where in of_memories.items())),
            entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if("expired").alias("expired_entities")),
            edges.agg(F.count(F.lit(1)).alias("edges")),
        ]
        long = [part.unpivot([], part.columns, "counter", "value") for part in parts]
        return long[0].unionByName(long[1]).unionByName(long[2])

    # Getters of the edges and neighbours of given nodes

    def edges_from(self, nodes: DataFrame, kind: str | None = None, include_expired: bool = False, least: float | None = None) -> DataFrame:
        """The edges that go out of ``nodes`` (id), newest first."""
        return self._edges_at("from_node", nodes, kind, include_expired, least).orderBy(F.desc_nulls_last("t_created"), "edge_id")

    def edges_to(self, nodes: DataFrame, kind: str | None = None, include_expired: bool = False, least: float | None = None) -> DataFrame:
        """The edges that come into ``nodes`` (id), newest first; of no kind, or of AFFECTS, events are among them."""
        found = self._edges_at("to_node", nodes, None if kind == "AFFECTS" else kind, include_expired, least)
        if kind in (None, "AFFECTS"):
            events = self._event_edges(nodes.select(F.col("id").alias("memory_id")).distinct())
            found = events if kind else found.unionByName(events)
        return found.orderBy(F.desc_nulls_last("t_created"), "edge_id")

    def listed_edges(self, kind: str | None = None, include_expired: bool = False, limit: int | None = 100) -> DataFrame:
        """Edges of a kind, or of all kinds with the events among them, newest first."""
        found = self._event_edges() if kind == "AFFECTS" else self._edges_where(kind, include_expired, None)
        found = (found if kind else found.unionByName(self._event_edges())).orderBy(F.desc_nulls_last("t_created"), "edge_id")
        return found if limit is None else found.limit(limit)

    def _event_edges(self, among: DataFrame | None = None) -> DataFrame:
        """Events as edges to their memories; they never expire and are as sure as can be."""
        return self.view("memory_events", "memory_id IS NOT NULL", among).select(
            F.col("event_id").alias("edge_id"), F.col("event_id").alias("from_node"), F.col("memory_id").alias("to_node"),
            F.lit("AFFECTS").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("confidence"),
            F.col("occurred_at").alias("t_created"),
        )

    def _edges_at(self, end: str, nodes: DataFrame, kind: str | None, include_expired: bool, least: float | None) -> DataFrame:
        return self._edges_where(kind, include_expired, least, nodes.select(F.col("id").alias(end)).distinct())

    def _edges_where(self, kind: str | None, include_expired: bool, least: float | None, among: DataFrame | None = None) -> DataFrame:
        where = F.lit(True) if include_expired else F.col("t_expired").isNull()
        where = where if kind is None else where & (F.col("edge_type") == kind)
        where = where if least is None else where & confident(least)
        return self.edge_view(where, among).select("edge_id", "from_node", "to_node", "edge_type", "weight", "confidence", "t_created")

    def listed_sources(self, limit: int | None = None, **wanted: str) -> DataFrame:
        """The sources whose source_type, agent or session_id are as ``wanted``, ingested last first."""
        where = F.lit(True)
        for column, value in wanted.items():
            where &= F.col(column) == value
        rows = self.view("sources", where).orderBy(F.desc_nulls_last("ingested_at"), "source_id")
        return rows if limit is None else rows.limit(limit)

    def chunk_summaries(self) -> DataFrame:
        """chunk_id, id: the latest active summary that a chunk holds."""
        summaries = self.memory_view("kind = 'SUMMARY' AND t_expired IS NULL").select("id", "created_at")
        links = self.along("CONTAINS").select(F.col("from_node").alias("chunk_id"), F.col("to_node").alias("id")).distinct()
        return links.join(summaries, "id").groupBy("chunk_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
