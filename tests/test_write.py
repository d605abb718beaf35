import pathlib
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sagekeep.functions.text import content_hash, evidence, norm_key, normalise_content, preview, tail
from sagekeep.operators import commit
from sagekeep.schemas import TABLES, conform, constraint_report

T0 = datetime(2025, 1, 1)


def memories(spark, rows):
    """Rows of (id, content, vector); created in their order."""
    full = [(i, c, v, T0 + timedelta(hours=n)) for n, (i, c, v) in enumerate(rows)]
    return conform(spark.createDataFrame(full, "id string, content string, content_embedding array<float>, created_at timestamp"), "memories")


def incoming(spark, rows):
    return spark.createDataFrame(rows, "id string, place long, content string, vector array<float>, source string")


def reasons(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in frame.select(commit.hygiene_reason(normalise_content("t"))).collect()]


def test_hygiene(spark):
    texts = ["", "   ", None, "ok", "thanks", "x" * 11, "x" * 12, "x" * 4000, "x" * 4001, "." * 12, "  a\n\n b\tc   filler text "]
    assert reasons(spark, texts) == ["empty", "empty", "empty", "too_short", "too_short", "too_short", None, None, "too_long", "no_substance", None]


def test_text_functions(spark):
    row = spark.createDataFrame([("  a\n\n b\tc   filler text ", " Größe x ")], "t string, u string")
    got = row.select(
        normalise_content("t"), normalise_content("u"), preview(F.lit("abcdef"), 5), preview(F.lit("abcde"), 5), tail(F.lit("abcdef"), 5),
        F.length(evidence(F.lit("e" * 300))), content_hash(F.lit(" a  b ")) == F.sha2(F.lit("a b"), 256),
    ).first()
    assert tuple(got) == ("a b c filler text", "Größe x", "ab...", "abcde", "...ef", 200, True)


@pytest.mark.parametrize(
    ("name", "kind", "key"),
    [("Alice Smith", "PERSON", "PERSON:alice smith"), ("  Dr. Alice  ", "PERSON", "PERSON:dr. alice"), ('"Acme   Corp."', "ORG", "ORG:acme corp"), (None, "ORG", None)],
)
def test_norm_key(spark, name, kind, key):
    row = spark.createDataFrame([(name, kind)], "n string, k string")
    assert row.select(norm_key("n", "k")).first()[0] == key


def decided(spark, stored, rows, **rules):
    found = commit.decide(memories(spark, stored), incoming(spark, rows), commit.Hygiene(dim=2, **rules))
    return {r.id: (r.outcome, r.matched) for r in found.collect()}


def test_decisions_in_their_order(spark):
    stored = [("A", "text number one", [1.0, 0.0])]
    rows = [
        ("b", 1, "text number two", [0.95, 0.3122499], "hook"), ("c", 2, "text number one", [1.0, 0.0], "hook"), ("d", 3, "text  number one", None, "manual"),
        ("e", 4, "text number two", [0.95, 0.3122499], "manual"), ("f", 5, "text number six", [0.0, 1.0], "hook"), ("g", 6, "text number six", None, None), ("h", 7, "ok", None, "hook"),
    ]
    assert decided(spark, stored, rows) == {
        "b": ("NEAR_DUPE", "A"), "c": ("NEAR_DUPE", "A"), "d": ("EXACT_DUPE", "A"), "e": ("INSERTED_NEW", "e"),
        "f": ("INSERTED_NEW", "f"), "g": ("EXACT_DUPE", "f"), "h": ("REJECTED_HYGIENE", None),
    }


def test_commit_is_idempotent(spark):
    rows = [(f"r{i}", i, f"a sound text {i}", None, "hook") for i in range(5)]
    first = commit.decide(memories(spark, []), incoming(spark, rows), commit.Hygiene(dim=2))
    assert {r.outcome for r in first.collect()} == {"INSERTED_NEW"}
    again = decided(spark, [(r[0], r[2], None) for r in rows], [(f"x{r[0]}", *r[1:]) for r in rows])
    assert {o for o, _ in again.values()} == {"EXACT_DUPE"}
    events = commit.commit_events(first, F.lit(T0).cast("timestamp")).collect()
    assert {e.event_type for e in events} == {"ADD"} and len({e.event_id for e in events}) == 5


EDGE = "edge_id string, from_node string, to_node string, edge_type string, weight double, evidence string, t_created timestamp, t_expired timestamp"


def test_edges_keep_the_first_and_known_ends(spark):
    old = spark.createDataFrame([("o1", "a", "b", "RELATED", 0.5, None, T0, None), ("o2", "a", "c", "RELATED", 0.5, None, T0, T0)], EDGE)
    new = [(f"n{i}", *ends, "RELATED", w, "x" * 300, T0 + timedelta(hours=i), None) for i, (ends, w) in enumerate([(("a", "b"), 1.0), (("a", "c"), None), (("a", "c"), 0.9), (("a", "gone"), 0.0), (("b", "c"), 0.0)])]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "node string")
    got = {r.edge_id: (r.weight, len(r.evidence)) for r in commit.upsert_edges(old, spark.createDataFrame(new, EDGE), nodes).collect()}
    assert got == {"n1": (1.0, 200), "n4": (0.0, 200)}


def test_related_edges_lead_to_earlier_memories(spark):
    rows = [(f"m{i}", "t", [1.0, i / 10]) for i in range(8)] + [("z", "t", [0.0, 0.0]), ("n", "t", None), ("s", "t", [1.0])]
    got = commit.related_edges(memories(spark, rows), 0.9, 2, dim=2).collect()
    assert all(r.from_node > r.to_node and r.weight >= 0.9 for r in got)
    assert max(sum(1 for r in got if r.from_node == f"m{i}") for i in range(8)) == 2 and got[0].evidence.startswith("semantic_similarity=0.9")


def test_updates(spark):
    table = memories(spark, [("a", "x", [1.0]), ("b", "y", None)])
    now = F.lit(T0).cast("timestamp")
    ids = spark.createDataFrame([("a",), ("a",), ("none",)], "id string")
    once = commit.deprecate(table, ids, now)
    assert {r.id: r.t_expired for r in once.collect()} == {"a": T0, "b": None}
    later = commit.deprecate(once, ids, F.lit(T0 + timedelta(days=1)).cast("timestamp"))
    assert {r.id: r.t_expired for r in later.collect()} == {"a": T0, "b": None}
    vectors = spark.createDataFrame([("b", [2.0, 3.0])], "id string, vector array<float>")
    assert {r.id: r.content_embedding for r in commit.set_vectors(table, vectors, "content_embedding").collect()} == {"a": [1.0], "b": [2.0, 3.0]}
    assert commit.set_vectors(table, vectors, "content_embedding").columns == table.columns


def test_deleting_edges(spark):
    rows = [("1", "a", "b", "MENTIONS"), ("2", "a", "c", "RELATED"), ("3", "d", "b", "MENTIONS"), ("4", None, "b", None)]
    edges = spark.createDataFrame(rows, "edge_id string, from_node string, to_node string, edge_type string")
    left = lambda **k: {r.edge_id for r in commit.delete_edges(edges, **k).collect()}
    assert left(kind="MENTIONS") == {"2", "4"} and left(from_node="a") == {"3", "4"} and left(kind="MENTIONS", from_node="a") == {"2", "3", "4"}
    entities = spark.createDataFrame([("b",)], "id string")
    none, rest = commit.purge_entities(entities, edges)
    assert none.count() == 0 and {r.edge_id for r in rest.collect()} == {"2"}


def test_merges_are_followed_to_their_end(spark):
    rows = [(f"e{i}", f"e{i + 1}") for i in range(9)] + [("e9", None), ("r1", "r2"), ("r2", "r1"), ("into", "r1"), ("x", "gone"), ("y", "")]
    got = {r.id: r.final for r in commit.resolve_merges(spark.createDataFrame(rows, "id string, merged_into string")).collect()}
    assert {got[f"e{i}"] for i in range(10)} == {"e9"} and got["x"] == "x" and got["y"] == "y" and {got["r1"], got["into"]} <= {"r1", "r2"}


def test_constraints(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    tables["memories"] = memories(spark, [("a", "x", None), ("a", "x", None), (None, "y", None)])
    report = {(r.table_name, r.key_name): r.broken for r in constraint_report(tables).collect()}
    assert report[("memories", "id")] == 1 and sum(report.values()) == 1


def test_related_edges_write_each_vector_to_the_disk_at_most_four_times(tmp_path):
    code = f"""
import sys, pathlib
sys.path[:0] = [{str(pathlib.Path(__file__).parents[1])!r}]
import numpy as np
from sagekeep.runtime import build_session
from sagekeep.operators.commit import related_edges
spark = build_session("t", 2, **{{"spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.local.dir": "{tmp_path}/local", "spark.cleaner.referenceTracking": "false", "spark.driver.memory": "2g"}})
matrix = np.random.default_rng(3).normal(size=(20_000, 64)).astype("f4")
rows = [(f"id{{i:06d}}", row.tolist(), i) for i, row in enumerate(matrix)]
spark.createDataFrame(rows, "id string, content_embedding array<float>, n long").selectExpr("id", "content_embedding", "timestamp_micros(n) AS created_at").write.parquet("{tmp_path}/in")
print(related_edges(spark.read.parquet("{tmp_path}/in")).count())
size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).rglob("*") if f.is_file()) if pathlib.Path(p).exists() else 0
print("BYTES", size("{tmp_path}/local") + size("{tmp_path}/shared"), size("{tmp_path}/in"))
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "BYTES" in said.stdout, said.stderr[-2000:]
    written, given = (int(x) for x in said.stdout.split("BYTES")[1].split()[:2])
    assert written < 4 * given


def test_related_edges_of_equal_vectors_and_of_memories_without_a_time(spark):
    rows = [(f"m{i:04d}", [1.0, 2.0, 3.0, 4.0], None if i == 7 else i // 3) for i in range(1500)] + [("z", [4.0, 3.0, 2.0, -9.0], 9000)]
    memories = spark.createDataFrame(rows, "id string, content_embedding array<float>, at long").selectExpr("id", "content_embedding", "timestamp_micros(at) AS created_at")
    found = {(r.from_node, r.to_node, r.weight) for r in commit.related_edges(memories, dim=4).collect()}
    timed = [(i, at) for i, _, at in rows[:-1] if at is not None]
    wanted = {(i, other, 1.0) for i, at in timed for other in [o for o, b in timed if b < at][:5]}
    assert found == wanted
