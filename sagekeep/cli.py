"""Command line: python -m sagekeep.cli COMMAND --root FOLDER."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagekeep.functions.text import identifier, preview, tail
from sagekeep.operators import backfill, commit, extract, retrieval
from sagekeep.operators.graph import Graph
from sagekeep.operators.ingest import FORMATS, STORED, IngestConfig, add_memories, ingest
from sagekeep.runtime import build_session, materialise, ship_package
from sagekeep.sources import sessions
from sagekeep.sources.config import load_settings
from sagekeep.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sagekeep", description="Ask and keep up a memory graph.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, **kwargs) -> None:
        sub = commands.add_parser(name, **kwargs)
        sub.add_argument("--root", required=True, help="folder of the store")
        sub.add_argument("--limit", type=int, default=20)
        for flags, settings in options:
            sub.add_argument(*flags, **settings)

    expired = (("--include-expired",), {"action": "store_true"})
    add("memories", expired, help="list memories, newest first")
    add("entities", expired, help="list entities with their mentions")
    add("edges", (("--type",), {}), expired, help="list edges")
    add("show", (("id",), {}), help="show one record of any table")
    add("recall", (("query",), {}), help="memories around the summaries nearest to a text")
    add("search", (("query",), {}), help="memories nearest to a text, re-ranked")
    add("ingest", (("paths",), {"nargs": "+"}), (("--recursive",), {"action": "store_true"}), (("--pattern",), {}), (("--format",), {"choices": FORMATS, "default": "auto"}), help="add files")
    add("add", (("content",), {}), (("--source",), {"default": "manual"}), (("--tags",), {}), (("--agent",), {"default": "cli"}), (("--session-id",), {}), help="add one memory")
    add("sources", (("--type",), {}), (("--agent",), {}), (("--session-id",), {}), help="list sources, ingested last first")
    add("extract-entities", (("--reprocess",), {"action": "store_true"}), help="link entities of memories without any")
    add("deprecate", (("ids",), {"nargs": "+"}), (("--reason",), {"default": "deprecated by hand"}), help="expire memories")
    add("purge-entities", (("--force",), {"action": "store_true"}), help="drop all entities and their edges")
    some = (("--only",), {"type": int, "help": "as many of the newest records"})
    add("embed", some, help="compute the vectors of all memories anew")
    add("embed-entities", some, help="compute the vectors of all active entities anew")
    add("report", help="counters of the graph's health")
    add("orphans", (("--fix",), {"action": "store_true"}), help="memories without a chunk and without mentions")
    settings = commands.add_parser("settings", help="show settings with their includes")
    settings.add_argument("path")
    return top


def run(args: argparse.Namespace, spark, embedder: extract.Embedder | None = None) -> DataFrame:
    """The frame that a command shows."""
    store, now = Store(spark, args.root), F.current_timestamp()
    embedder = embedder or extract.HashedEmbedder()
    frames = {name: store.read(name) for name in STORED}
    config = IngestConfig(embedder=embedder)
    graph = Graph(spark, args.root, **frames)
    if args.command == "memories":
        rows = graph.listed_memories(args.include_expired, args.limit)
        return rows.withColumn("content", preview("content", 100))
    if args.command == "entities":
        return graph.mention_counts().select("id", "entity_type", "canonical_name", "mentions").orderBy(F.desc("mentions"), "id").limit(args.limit)
    if args.command == "edges":
        rows = graph.listed_edges(args.type, args.include_expired, args.limit)
        return rows.select("edge_id", "from_node", "edge_type", "to_node", "weight", "confidence")
    if args.command == "sources":
        wanted = {"source_type": args.type, "agent": args.agent, "session_id": args.session_id}
        rows = graph.listed_sources(args.limit, **{column: value for column, value in wanted.items() if value is not None})
        return rows.select("source_id", "source_type", "path", "agent", "session_id", "ingested_at")
    if args.command == "show":
        keys = {"memories": "id", "entities": "id", "edges": "edge_id", "chunks": "chunk_id", "sources": "source_id"}
        found = None
        for table, key in keys.items():
            rows = graph.by_id(table, key, args.id)
            part = rows.select(F.lit(table).alias("table_name"), F.to_json(F.struct(*rows.columns)).alias("record"))
            found = part if found is None else found.unionByName(part)
        return found
    if args.command in ("recall", "search"):
        # A conversation is asked with its end; it may be given as a JSON array of messages.
        asked = sessions.conversation_texts(spark.createDataFrame([(0, args.query)], "id int, text string"), "id").select(tail("text", 500)).first()
        query = embedder.embed([asked[0] if asked else args.query])[0]
        if args.command == "recall":
            found = retrieval.recall(graph, query, now, args.limit)
        else:
            found = retrieval.hybrid_search(graph, query, None, now, args.limit).join(graph.memories.select("id", "content"), "id")
        return found.select("id", F.round("score", 4).alias("score"), preview("content", 100).alias("content")).orderBy(F.desc("score"), "id")
    if args.command == "ingest":
        documents = sessions.read_documents(spark, args.paths, args.recursive, args.pattern)
        return ingest(spark, store, documents, now, IngestConfig(embedder=embedder, source_format=args.format))
    if args.command == "add":
        tags = [tag.strip() for tag in args.tags.split(",")] if args.tags else None
        row = (args.content, args.source, tags, args.agent, args.session_id)
        one = spark.createDataFrame([row], "content string, source string, tags array<string>, agent string, session_id string")
        return add_memories(spark, store, one, now, config)
    if args.command == "extract-entities":
        return backfill.link_entities(store, now, config, backfill.ALL if args.reprocess else backfill.WAITING)
    if args.command == "orphans" and args.fix:
        return backfill.link_entities(store, now, config, backfill.ORPHANED)
    if args.command == "deprecate":
        ids = spark.createDataFrame([(i,) for i in args.ids], "id string")
        hit = graph.active_memories().join(ids, "id", "left_semi").select("id")
        hit = materialise(hit, "deprecated")
        events = hit.select(
            identifier("evt_", F.lit("deprecate"), "id").alias("event_id"), F.col("id").alias("memory_id"), F.lit("DEPRECATE").alias("event_type"),
            now.alias("occurred_at"), F.lit("manual").alias("source"), F.to_json(F.struct(F.lit(args.reason).alias("reason"))).alias("payload"),
        )
        store.change({"memories": commit.deprecate(frames["memories"], ids, now)}, {"memory_events": events})
        return hit
    if args.command == "purge-entities":
        if not args.force:
            raise SystemExit("purge-entities drops all entities; say --force")
        entities, edges = commit.purge_entities(frames["entities"], frames["edges"])
        store.publish(entities=entities, edges=edges)
        return graph.entities.agg(F.count(F.lit(1)).alias("dropped"))
    if args.command in ("embed", "embed-entities"):
        return backfill.embed_anew(store, "memories" if args.command == "embed" else "entities", config, args.only)
    return graph.health_report() if args.command == "report" else graph.orphaned_memories().select("id", preview("content", 100).alias("content")).limit(args.limit)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "settings":
        print(json.dumps(load_settings(args.path), indent=2))
        return
    spark = build_session("sagekeep")
    ship_package(spark)
    run(args, spark).show(args.limit, truncate=False)


if __name__ == "__main__":
    main()
