from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sagekeep import cli
from sagekeep.operators import backfill, extract
from sagekeep.operators.commit import Hygiene
from sagekeep.operators.graph import Graph
from sagekeep.operators.ingest import IngestConfig, add_memories, ingest
from sagekeep.sources.store import Store

T0 = datetime(2025, 1, 1)
TEXT = "The team met Alice Smith in Berlin today. They moved the whole store to Postgres Cluster at noon. Ok."


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def documents(spark, *texts):
    return spark.createDataFrame([(f"/d/{n}.txt", t, T0) for n, t in enumerate(texts)], "path string, text string, modified timestamp")


def test_a_batch_becomes_a_graph_and_again_changes_little(spark, store):
    config = IngestConfig(chunk_size=400, chunk_overlap=0)
    now = F.lit(T0).cast("timestamp")
    counts = {r.outcome: r["rows"] for r in ingest(spark, store, documents(spark, TEXT, None), now, config).collect()}
    assert counts == {"INSERTED_NEW": 2}
    memories = store.read("memories")
    assert memories.filter("kind = 'MEMORY'").count() == 2 and memories.filter("kind = 'SUMMARY'").count() == 1
    assert {r.canonical_name for r in store.read("entities").collect()} == {"Alice Smith", "Berlin", "Postgres Cluster"}
    kinds = {r.edge_type: r["count"] for r in store.read("edges").groupBy("edge_type").count().collect()}
    assert kinds == {"PRODUCED": 2, "CONTAINS": 3, "MENTIONS": 3, "LINKED": 3, "SUMMARIZES": 2, "SUMMARIZED_BY": 1}
    events = store.read("memory_events")
    assert {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()} == {"ADD": 2, "ENTITY_EXTRACTED": 2, "SUMMARY_CREATED": 1}
    graph = Graph(spark, store.root, **{name: store.read(name) for name in ("memories", "memory_events")})
    summary = memories.filter("kind = 'SUMMARY'").first().id
    assert [tuple(r) for r in graph.artifact_summaries().collect()] == [("/d/0.txt", summary)]
    again = {r.outcome: r["rows"] for r in ingest(spark, store, documents(spark, TEXT), now, config).collect()}
    assert again == {"NEAR_DUPE": 2} and store.read("memories").count() == 3 and store.read("sources").count() == 2


def test_session_files_are_cut_by_messages(spark, store):
    lines = [
        '{"type": "system", "timestamp": "2024-03-01T00:00:00Z"}',
        '{"type": "user", "uuid": "u1", "timestamp": "2024-03-02T00:00:00Z", "message": {"role": "user", "content": "The harbour of Lisbon was closed for repairs."}}',
        '{"type": "user", "uuid": "u1", "timestamp": "2024-03-02T00:00:00Z", "message": {"role": "user", "content": "The harbour of Lisbon was closed for repairs."}}',
        "not json",
        '{"type": "assistant", "timestamp": "2024-03-05T00:00:00Z", "message": {"content": [{"type": "text", "text": "Freight moved over Porto Central instead."}]}}',
    ]
    plain = '{"a": 1}\nnot json\n{"type": "user", "content": "too late to be a session, this is plain"}'
    ingest(spark, store, documents(spark, "\n".join(lines), plain, TEXT, ""), F.lit(T0).cast("timestamp"), IngestConfig(chunk_size=80, chunk_overlap=0)).collect()
    sources = {r.source_id: r.path for r in store.read("sources").collect()}
    chunks = [(sources[r.source_id], r.sequence_no, r.start_char is None) for r in store.read("chunks").collect()]
    assert sorted(c for c in chunks if c[0] == "/d/0.txt") == [("/d/0.txt", 1, True), ("/d/0.txt", 2, True)] and ("/d/1.txt", 1, False) in chunks
    valid = {r.content: r.t_valid for r in store.read("memories").filter("kind = 'MEMORY'").collect()}
    assert valid["user: The harbour of Lisbon was closed for repairs."] == datetime(2024, 3, 2) and T0 in valid.values()


def test_models_can_be_replaced(spark, rows):
    class Fixed:
        def entities(self, text):
            return [("Name", " person ", 1.7, "e"), ("", "PERSON", 0.9, "e"), ("Other", "", 0.9, "e"), ("Low", "ORG", 0.1, "e")]

        def memories(self, text):
            return [("long enough text", 0.9, "r"), ("short", 0.9, "r"), ("not sure enough", 0.1, "r")]

    frame = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    found = extract.extract_entities(frame, "id", "text", Fixed())
    assert rows(found.select("name", "entity_type", "confidence", "norm_key")) == [("Low", "ORG", 0.1, "ORG:low"), ("Name", "PERSON", 1.0, "PERSON:name")]
    assert [r.content for r in extract.extract_memories(frame, "id", "text", Fixed(), 0.5).collect()] == ["long enough text"]
    vectors = extract.embed_texts(frame, "text", extract.HashedEmbedder(8), 8).orderBy("id").collect()
    assert len(vectors[0].vector) == 8 and vectors[1].vector is None
    with pytest.raises(Exception, match="length 9"):
        extract.embed_texts(frame, "text", extract.HashedEmbedder(8), 9).collect()


def test_summaries_link_all_memories_of_a_chunk(spark):
    members = [("full", f"m{i:02d}", f"Content {i}. More.", T0) for i in range(13)] + [("two", "m00", "a", T0), ("two", "n", None, T0), ("one", "m01", "b", T0)]
    members = spark.createDataFrame(members, "chunk_id string, id string, content string, created_at timestamp")
    texts = extract.summary_texts(members)
    assert {r.chunk_id: len(r.memory_ids) for r in texts.collect()} == {"full": 10, "two": 2}
    edges = extract.summary_edges(texts, members)
    names = {r.to_node: r.from_node for r in edges.filter("edge_type = 'SUMMARIZED_BY'").collect()}
    cited = {(names[r.from_node], r.to_node) for r in edges.filter("edge_type = 'SUMMARIZES'").collect()}
    assert cited == {("full", f"m{i:02d}") for i in range(13)} | {("two", "m00"), ("two", "n")}
    assert edges.count() == 15 + 2 * 2


def test_a_batch_links_its_summary_to_all_memories(spark, store):
    words = ["river", "castle", "engine", "violin", "glacier", "market", "orchard", "compass", "lantern", "harbour", "tunnel", "blanket"]
    text = " ".join(f"{w.title() * 3} {w[::-1] * 3} {w * 2}." for w in words)
    counts = {r.outcome: r["rows"] for r in ingest(spark, store, documents(spark, text), F.lit(T0).cast("timestamp")).collect()}
    assert counts == {"INSERTED_NEW": 12}
    assert store.read("edges").filter("edge_type = 'SUMMARIZES'").count() == 12


def test_forced_entities():
    assert extract.parse_forced(["person:Al B", "PERSON: al b", "ORG:X:Y"]) == [("Al B", "PERSON"), ("X:Y", "ORG")]
    for bad in ("noname", "PERSON:", ":x"):
        with pytest.raises(ValueError, match="TYPE:Name"):
            extract.parse_forced([bad])


def test_commands(spark, store, tmp_path):
    file = tmp_path / "a.txt"
    file.write_text(TEXT)
    ask = lambda *argv: cli.run(cli.parser().parse_args([*argv, "--root", store.root]), spark).collect()
    assert {r.outcome for r in ask("ingest", str(file))} == {"INSERTED_NEW"}
    listed = ask("memories")
    assert len(listed) == 3 and ask("memories", "--limit", "1") != []
    assert "Postgres" in ask("search", "Postgres Cluster store")[0].content
    assert len(ask("recall", "team")) == 3 and len(ask("edges", "--type", "MENTIONS")) == 3
    one = listed[0].id
    assert [r.table_name for r in ask("show", one)] == ["memories"]
    assert [r.id for r in ask("deprecate", one, "unknown")] == [one] and len(ask("memories")) == 2 and len(ask("memories", "--include-expired")) == 3
    assert store.read("memory_events").filter("event_type = 'DEPRECATE'").first().memory_id == one
    with pytest.raises(SystemExit):
        ask("purge-entities")
    ask("purge-entities", "--force")
    assert ask("entities") == [] and ask("edges", "--type", "MENTIONS") == []
    assert ask("embed")[0].embedded == 3
    assert {r.counter: r.value for r in ask("report")}["entities"] == 0 and ask("orphans") == []


def counters(frame):
    return {r.counter: r.value for r in frame.collect()}


def test_entities_are_linked_afterwards(spark, store):
    now = F.lit(T0).cast("timestamp")
    table = [("m1", "They met Alice Smith there.", "MEMORY"), ("m2", "nothing here", "MEMORY"), ("m3", "They met Berlin Group there.", "SUMMARY"), ("m4", None, "MEMORY")]
    store.append(memories=spark.createDataFrame([(*r, T0) for r in table], "id string, content string, kind string, created_at timestamp"))
    assert counters(backfill.link_entities(store, now)) == {"memories_processed": 3, "entities_created": 1, "edges_created": 1}
    assert counters(backfill.link_entities(store, now)) == {"memories_processed": 2, "entities_created": 0, "edges_created": 0}
    assert counters(backfill.link_entities(store, now, which=backfill.ORPHANED)) == {"memories_processed": 2, "entities_created": 0, "edges_created": 0}
    extra = spark.createDataFrame([("x1", "m1", "gone", "MENTIONS"), ("x2", "m2", "gone", "MENTIONS"), ("x3", "m1", "m2", "RELATED")], "edge_id string, from_node string, to_node string, edge_type string")
    store.append(edges=extra)
    assert counters(backfill.link_entities(store, now, which=backfill.ALL)) == {"memories_processed": 3, "entities_created": 0, "edges_created": 1}
    entity = store.read("entities").first()
    left = {(r.from_node, r.to_node, r.edge_type) for r in store.read("edges").collect()}
    assert left == {("m1", entity.id, "MENTIONS"), ("m2", "gone", "MENTIONS"), ("m1", "m2", "RELATED")} and entity.norm_key == "CONCEPT:alice smith"
    with pytest.raises(ValueError, match="orphaned"):
        backfill.memories_to_extract(Graph(spark, store.root), "some")


def test_vectors_are_made_anew_where_the_model_can(spark, store):
    class Picky:
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), float(t.islower())] for t in texts]

    entities = [("e1", "Good", None, [0.0, 0.0]), ("e2", "bad", None, [9.0, 9.0]), ("e3", "Gone", T0, [8.0, 8.0]), ("e4", None, None, None)]
    store.append(entities=spark.createDataFrame(entities, "id string, canonical_name string, expired_at timestamp, embedding array<float>"))
    config = IngestConfig(embedder=Picky(), rules=Hygiene(dim=2))
    assert tuple(backfill.embed_anew(store, "entities", config).first()) == (1, 1)
    assert {r.id: r.embedding for r in store.read("entities").collect()} == {"e1": [4.0, 1.0], "e2": [9.0, 9.0], "e3": [8.0, 8.0], "e4": None}


def test_single_memories_and_the_hook(spark, store):
    seen, now = [], F.lit(T0).cast("timestamp")
    config = IngestConfig(on_commit=lambda decided: seen.append({r.outcome for r in decided.collect()}))
    rows = [("They met Alice Smith in the harbour.", "manual", ["a", "b"], "bot", "s1"), ("ok", None, None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "content string, source string, tags array<string>, agent string, session_id string")
    assert {r.outcome: r["rows"] for r in add_memories(spark, store, frame, now, config).collect()} == {"INSERTED_NEW": 1, "REJECTED_HYGIENE": 1}
    assert seen == [{"INSERTED_NEW", "REJECTED_HYGIENE"}]
    memory = store.read("memories").first()
    assert memory.metadata == '{"source":"manual","tags":["a","b"]}' and memory.t_valid == T0
    assert {r.edge_type for r in store.read("edges").collect()} == {"PRODUCED", "MENTIONS"}
    assert {(r.agent, r.session_id, r.source_type) for r in store.read("sources").collect()} == {("bot", "s1", "agentic"), ("cli", None, "agentic")}
    again = add_memories(spark, store, frame.select("content").limit(1), now, config)
    assert {r.outcome: r["rows"] for r in again.collect()} == {"EXACT_DUPE": 1} and store.read("memories").count() == 1
    assert {r.event_type: r.source for r in store.read("memory_events").collect()} == {"ADD": "manual", "ENTITY_EXTRACTED": "system", "REINFORCE_EXACT": "manual"}


def test_formats(spark, store):
    line = '{"type": "user", "content": "The whole harbour was closed."}'
    now = F.lit(T0).cast("timestamp")
    with pytest.raises(ValueError, match="unknown format"):
        ingest(spark, store, documents(spark, line), now, IngestConfig(source_format="odd"))
    ingest(spark, store, documents(spark, line), now, IngestConfig(source_format="plain"))
    ingest(spark, store, documents(spark, line), now, IngestConfig(source_format="session"))
    assert {r.content for r in store.read("memories").collect()} == {line, "user: The whole harbour was closed."}
