from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sagekeep.functions import format as blocks
from sagekeep.functions.scores import reinforcement
from sagekeep.operators.ontology import Ontology, checked_types
from sagekeep.operators.graph import Graph
from sagekeep.plans import text
from sagekeep.plans.text import _run
from sagekeep.streaming import events as streams

T0 = datetime(2025, 1, 1)
SCHEMA = "event_id string, memory_id string, event_type string, occurred_at timestamp, content_hash string"


def stream(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_trace_equals_the_batch(spark, tmp_path):
    hours = {"a": [0, 3, 40, 41, 500], "b": [10], "c": [0, 24, 48], "d": [5, 5]}
    rows = [(f"{m}{i}", m, "REINFORCE", T0 + timedelta(hours=h), "x") for m, hs in hours.items() for i, h in enumerate(hs)]
    found = _run(streams.reinforcement_trace(stream(spark, tmp_path, rows)), "update")
    got = {r.memory_id: r.multiplier for r in found.groupBy("memory_id").agg(F.max_by("multiplier", "at_ms").alias("multiplier")).collect()}
    for memory, hs in hours.items():
        batch = spark.createDataFrame([r for r in rows if r[1] == memory], SCHEMA)
        newest = F.lit(T0 + timedelta(hours=max(hs))).cast("timestamp")
        assert got[memory] == pytest.approx(reinforcement(batch, newest).first().multiplier, abs=1e-9)


def test_late_events_of_later_batches_count(spark, tmp_path):
    hours = [100, 103, 90, 140, 101, 139.5, 141, 60, 600, 595, 598]  # 60 comes later than the delay
    path = str(tmp_path / "events")
    for place, h in enumerate(hours):
        row = [(f"a{place}", "a", "REINFORCE", T0 + timedelta(hours=h), "x")]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    found = _run(streams.reinforcement_trace(source), "update")
    assert found.count() == len(hours)
    batch = spark.createDataFrame([(str(i), "a", "REINFORCE", T0 + timedelta(hours=h), "x") for i, h in enumerate(hours)], SCHEMA)
    expected = reinforcement(batch, F.lit(T0 + timedelta(hours=600)).cast("timestamp")).first().multiplier
    assert found.orderBy(F.desc("at_ms"), F.desc("trace")).first().multiplier == pytest.approx(expected, abs=1e-9)


def test_windows_close_and_repeats_are_dropped(spark, tmp_path, rows):
    table = [("e1", "m", "ADD", T0, "h"), ("e1", "m", "ADD", T0, "h"), ("e2", "m", "ADD", T0 + timedelta(hours=20), "h"), ("e3", "m", "ADD", T0 + timedelta(days=9), "k"), ("e4", None, "ADD", T0, "k")]
    source = stream(spark, tmp_path, table)
    counted = _run(streams.daily_counts(source), "append")
    assert rows(counted) == [(T0, "ADD", 3)]
    runs = _run(streams.bursts(source.dropDuplicates(["event_id"])), "append")
    assert rows(runs.select("first", "events")) == [(T0, 2)]
    assert _run(streams.new_contents(source), "append").count() == 2


def test_finite_logs_are_counted_to_their_end(spark, rows):
    hours = [0, 1, 1, 30, 200, 201, 210, 226, 240, 241]  # dense to the end
    table = [(f"e{i}", f"m{i % 2}" if i % 5 else None, "ADD" if i % 3 else "USE", T0 + timedelta(hours=h), "x") for i, h in enumerate(hours)]
    g = Graph(spark, "", memory_events=spark.createDataFrame([*table, table[-1]], SCHEMA))
    days = g.events.groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    assert rows(text.streaming_daily_counts(g)) == rows(days)
    runs = g.events.filter("memory_id IS NOT NULL").groupBy("memory_id", F.session_window("occurred_at", "24 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    assert rows(text.streaming_bursts(g)) == rows(runs.select("memory_id", F.unix_micros("w.start").alias("first"), "events"))


@pytest.mark.parametrize("name", ["streaming_daily_counts", "streaming_bursts"])
def test_streams_equal_the_batch(spark, data, rows, name):
    g = Graph(spark, data)
    if name == "streaming_daily_counts":
        batch = g.events.filter("occurred_at IS NOT NULL").groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    else:
        batch = g.events.filter("memory_id IS NOT NULL").groupBy("memory_id", F.session_window("occurred_at", "24 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
        batch = batch.select("memory_id", F.unix_micros("w.start").alias("first"), "events")
    assert rows(getattr(text, name)(g)) == rows(batch)


def test_types_are_checked_not_refused(spark, rows):
    ontology = Ontology.of(["person", {"name": "Tool", "synonyms": ["utility"], "tier": 1, "examples": ["Hammer"]}])
    frame = spark.createDataFrame([(" Person",), ("UTILITY ",), ("other",), (None,)], "entity_type string")
    assert rows(checked_types(frame, ontology).select("resolved_type", "is_known")) == sorted([("PERSON", True), ("TOOL", True), ("OTHER", False), (None, False)], key=repr)
    assert ontology.names(1) == ["TOOL"] and ontology.example_types() == {"Hammer": "TOOL"}
    for bad in ([""], ["a", "A "]):
        with pytest.raises(ValueError):
            Ontology.of(bad)


def test_text_blocks(spark):
    schema = "id string, content string, created_at timestamp, score double, temporal_stability string, similarity double, reinforcement double, reinforcements long, boost double, degree long, confidence double"
    found = spark.createDataFrame([("a", "x" * 150, T0, 0.5, "dynamic", 0.4, 1.5, 3, 1.0, 0, 0.9)], schema)
    now = F.lit(T0 + timedelta(days=3)).cast("timestamp")
    assert blocks.as_text(found, blocks.recall_block(now)).startswith("(score=0.5000, age=3d, stability=dynamic)\nxxx")
    assert blocks.as_text(found, blocks.explained_block(now)).endswith("because: similarity 0.4000; reinforced 3 times x1.500; dynamic, aged x0.900")
    assert blocks.as_text(found, blocks.search_block(), blocks.GAP).endswith("x...") and blocks.as_text(found.filter("false"), blocks.recall_block(now)) == "No memories found."
