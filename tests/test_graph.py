from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sagekeep.operators import retrieval, vector
from sagekeep.operators.graph import Graph
from sagekeep.schemas import TABLES, conform

T0 = datetime(2025, 1, 1)


def build(spark, memories=(), entities=(), edges=(), events=(), chunks=()):
    """A graph from short rows: see the schemas below."""
    frame = lambda rows, schema, table: conform(spark.createDataFrame(list(rows), schema), table)
    times = [(i, k, v, T0 + timedelta(hours=n), T0 if gone else None) for n, (i, k, v, gone) in enumerate(memories)]
    frames = {
        "memories": frame(times, "id string, kind string, content_embedding array<float>, created_at timestamp, t_expired timestamp", "memories"),
        "entities": frame(entities, "id string, entity_type string, norm_key string, embedding array<float>", "entities"),
        "edges": frame(
            [(f"x{n:03d}", *e) for n, e in enumerate(edges)], "edge_id string, from_node string, to_node string, edge_type string, weight double, confidence double", "edges"
        ),
        "memory_events": frame(events, "event_id string, memory_id string, event_type string, occurred_at timestamp", "memory_events"),
        "chunks": frame(chunks, "chunk_id string, created_at timestamp", "chunks"),
        "sources": spark.createDataFrame([], TABLES["sources"]),
    }
    return Graph(spark, "nowhere", **frames)


def mention(memory, entity, confidence=None):
    return (memory, entity, "MENTIONS", None, confidence)


@pytest.fixture(scope="module")
def expansion(spark):
    memories = [(f"m{i}", "MEMORY", None, False) for i in range(1, 5)] + [("m5", "MEMORY", None, True)]
    edges = [mention("m1", "alice", 0.9), mention("m1", "pg", 0.9), mention("m2", "alice"), mention("m2", "redis", 0.9), mention("m3", "pg", 0.8), mention("m3", "bob", 0.9)]
    edges += [mention("m4", "alice", 0.5), mention("m5", "alice", 0.9), mention("m1", "alice", 0.9)]
    edges += [("m1", "m4", "RELATED", 0.7, 0.7), ("m2", "m4", "RELATED", 0.9, 0.9), ("m1", "m2", "RELATED", 0.6, 0.6), ("m1", "m5", "RELATED", 0.9, 0.9)]
    return build(spark, memories, edges=edges)


def test_shared_entities(spark, rows, expansion):
    seeds = spark.createDataFrame([("m1",)], "id string")
    assert rows(retrieval.expand_shared_entities(expansion, seeds)) == [("m2", 1), ("m3", 1)]
    assert rows(retrieval.expand_shared_entities(expansion, seeds, least=0.4)) == [("m2", 1), ("m3", 1), ("m4", 1)]


def test_related(spark, rows, expansion):
    seeds = spark.createDataFrame([("m1",), ("m2",)], "id string")
    assert rows(retrieval.expand_related(expansion, seeds)) == [("m4", 0.9, "m2")]
    both = {(r.reason, r.id) for r in retrieval.expand(expansion, seeds).collect()}
    assert both == {("shared_entities", "m3"), ("related", "m4")}


def test_zero_confidence_counts_as_one(spark):
    graph = build(spark, edges=[mention("a", "e", 0.0), mention("b", "e", 0.5), mention("c", "e", None), mention("c", "f", 0.2)])
    matched = spark.createDataFrame([("e", 0.8), ("f", 1.0)], "entity_id string, similarity double")
    got = {r.id: round(r.entity_score, 6) for r in retrieval.entity_scores(graph, matched).collect()}
    assert got == {"a": 0.8, "b": 0.4, "c": 0.8}


def test_top_k_filters_first_unless_told_otherwise(spark, rows):
    memories = [("a", "MEMORY", [1.0, 0.0], False), ("b", "MEMORY", [1.0, 0.0], False), ("c", "SUMMARY", [0.9, 0.1], False), ("d", "SUMMARY", [0.0, 1.0], False), ("n", "SUMMARY", None, False), ("z", "SUMMARY", [0.0, 0.0], False), ("s", "SUMMARY", [1.0], False)]
    graph = build(spark, memories)
    where = F.col("kind") == "SUMMARY"
    find = lambda **k: [r.id for r in vector.top_k(graph.memories, "id", "content_embedding", [1.0, 0.0], 2, **k).collect()]
    assert find() == ["a", "b"] and find(where=where) == ["c", "d"] and find(where=where, post_filter=True) == []


def test_cosine_of_odd_vectors(spark):
    pairs = [([1.0, 0.0], [2.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], None), (None, [1.0], None)]
    frame = spark.createDataFrame(pairs, "a array<float>, b array<float>, c double")
    assert [r.got for r in frame.select(vector.cosine(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]


def test_entities_match_by_key_then_by_nearness(spark, rows):
    graph = build(spark, entities=[("e1", "PERSON", "PERSON:a", [1.0, 0.0]), ("e2", "PERSON", "PERSON:b", [0.0, 1.0]), ("e3", "ORG", "ORG:c", [1.0, 0.1])])
    asked = [("q1", "PERSON", "PERSON:b", [1.0, 0.0]), ("q2", "PERSON", "PERSON:z", [1.0, 0.1]), ("q3", "ORG", None, [0.0, 1.0]), ("q4", "PERSON", "PERSON:y", None)]
    frame = spark.createDataFrame(asked, "asked_id string, entity_type string, norm_key string, vector array<float>")
    got = {r.asked_id: (r.entity_id, round(r.similarity, 3)) for r in retrieval.match_entities(graph, frame, 0.5, 2).collect()}
    assert got == {"q1": ("e2", 1.0), "q2": ("e1", 0.995)}


def test_recall_expands_chunks_once(spark):
    memories = [("s1", "SUMMARY", [1.0, 0.0], False), ("s2", "SUMMARY", [0.9, 0.1], False), ("a", "MEMORY", [0.5, 0.5], False), ("b", "MEMORY", [1.0, 0.1], True), ("c", "MEMORY", [1.0, 0.0], False)]
    edges = [("k1", m, "CONTAINS", None, None) for m in ("s1", "s2", "a", "b")] + [("k2", "c", "CONTAINS", None, None)]
    graph = build(spark, memories, edges=edges)
    found = retrieval.recall(graph, [1.0, 0.0], F.lit(T0).cast("timestamp"), None)
    assert [r.id for r in found.collect()] == ["s1", "s2", "a"]
    assert retrieval.recall(build(spark), [1.0, 0.0], F.lit(T0).cast("timestamp")).collect() == []


def test_degree_counts_events_and_boosts_the_score(spark):
    memories = [("a", "MEMORY", [1.0, 0.0], False), ("b", "MEMORY", [1.0, 0.0], False)]
    events = [(f"e{i}", "b", "ADD", T0) for i in range(5)] + [("e9", None, "ADD", T0)]
    graph = build(spark, memories, events=events, edges=[("m", "b", "RELATED", 1.0, 1.0)])
    assert {r.id: r.degree for r in graph.in_degrees().collect()} == {"b": 6}
    found = retrieval.hybrid_search(graph, [1.0, 0.0], None, F.lit(T0).cast("timestamp"), 2).collect()
    assert [r.id for r in found] == ["b", "a"] and found[1].score == pytest.approx(1.0)


def test_views_hold_each_record_once(spark):
    memories = [("a", "MEMORY", None, False), ("a", None, None, False), (None, "MEMORY", None, False)]
    graph = build(spark, memories, edges=[mention("a", "e")] * 2)
    assert graph.memories.count() == 1 and graph.edges.first().weight == 1.0
    assert {r.counter: r.value for r in build(spark).health_report().collect()}["edges"] == 0


def test_rows_of_a_hot_key_are_numbered_in_ranges(spark):
    from sagekeep.operators.skew import numbered

    table = [("hot", i, f"x{i % 7}") for i in range(400)] + [(None, 2, "b"), (None, 1, "a"), ("few", 5, "c")]
    frame = spark.createDataFrame(table, "key string, at int, name string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = {(r.key, r.at): r.place for r in numbered(frame, "key", ["at", "name"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == {("hot", i): i + 1 for i in range(400)} | {(None, 1): 1, (None, 2): 2, ("few", 5): 1}
    assert numbered(frame.limit(0), "key", ["at"]).collect() == []


def test_recall_without_a_limit_gives_all_around_summaries(spark):
    from sagekeep.operators.retrieval import recall

    schema = "id string, kind string, content string, content_embedding array<float>, created_at timestamp, t_valid timestamp, t_expired timestamp, temporal_stability string, last_seen_at timestamp, reinforce_count int"
    moment = F.lit("2025-01-01T00:00:00+00:00").cast("timestamp")
    rows = [(f"s{i:03d}", "SUMMARY", "s", [1.0, i / 700], None, None, None, "static", None, 1) for i in range(700)]
    rows += [("m", "MEMORY", "m", None, None, None, None, "static", None, 1), ("alone", "MEMORY", "m", [1.0, 0.0], None, None, None, "static", None, 1), rows[0]]
    edges = spark.createDataFrame([("e1", "c", "s650"), ("e2", "c", "m")], "edge_id string, from_node string, to_node string")
    edges = edges.selectExpr("*", "'CONTAINS' AS edge_type", "1.0D AS weight", "1.0D AS confidence", "CAST(NULL AS timestamp) AS t_created", "CAST(NULL AS timestamp) AS t_expired")
    events = spark.createDataFrame([], "event_id string, memory_id string, event_type string, occurred_at timestamp")
    graph = Graph(spark, "", memories=spark.createDataFrame(rows, schema), edges=edges, memory_events=events)
    assert {r.id for r in recall(graph, [1.0, 0.0], moment, None).collect()} == {f"s{i:03d}" for i in range(700)} | {"m"}
    assert [r.id for r in recall(graph, [1.0, 0.0], moment, 2).collect()] == ["s000", "s001"]
