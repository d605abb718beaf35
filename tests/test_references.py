from datetime import datetime

from pyspark.sql import functions as F

from sagekeep.operators.references import Child, Parent, edge_target, orphan_references, orphan_report

OLD, MID, NEW = datetime(2025, 1, 5), datetime(2025, 3, 5), datetime(2025, 5, 5)
PARENTS = "id string, created_at timestamp, t_expired timestamp, key string, target string, salt int"
REFS = "event_id string, memory_id string, occurred_at timestamp, created string, is_parent boolean"


def parents(spark, rows):
    return Parent("memories", spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PARENTS), "id", "created_at", "t_expired")


def children(spark, rows):
    frame = spark.createDataFrame([(*r, "x", True) for r in rows], REFS)
    return Child("memory_events", frame, "event_id", "occurred_at", {"memory_id": F.lit("memories")})


CASES = [
    ("e01", "mem_1", MID), ("e02", " MEM_1\n", MID), ("e03", "gone", MID), ("e04", None, MID), ("e05", "  ", MID),
    ("e06", "mem_2", OLD), ("e07", "mem_3", NEW), ("e08", "mem_3", MID), ("e09", "mem_1", None), ("e10", "gone", None),
    ("e11", "mem_4", MID), (None, "gone", MID), ("e03", "gone", MID), ("e12", "x" * 100_000, MID),
]
MEMORIES = [("mem_1", OLD, None), ("mem_1", OLD, None), ("Mem_2 ", MID, None), ("mem_3", OLD, datetime(2025, 4, 1)), ("mem_4", MID, MID), (None, OLD, None)]
EXPECTED = {
    ("e03", "2025-03", "missing"), ("e06", "2025-01", "late"), ("e07", "2025-05", "deleted"), ("e10", None, "missing"),
    (None, "2025-03", "missing"), ("e12", "2025-03", "missing"),
}


def found(spark, memories, events, **options):
    result = orphan_references([parents(spark, memories)], [children(spark, events)], **options)
    return {(r.ref_id, r.period, r.reason) for r in result.collect()}


def test_reasons_and_odd_keys(spark):
    assert found(spark, MEMORIES, CASES) == EXPECTED


def test_salted_hot_key_gives_the_same(spark):
    hot = [(f"h{i:04d}", "mem_3", NEW if i % 2 else MID) for i in range(2000)]
    assert found(spark, MEMORIES, CASES + hot, salts=7) == EXPECTED | {(f"h{i:04d}", "2025-05", "deleted") for i in range(1, 2000, 2)}


def test_empty_tables(spark):
    assert found(spark, MEMORIES, []) == set()
    assert found(spark, [], [("a", "k", MID)]) == {("a", "2025-03", "missing")}


def test_report_counts_each_reference_once(spark):
    report = orphan_report(orphan_references([parents(spark, MEMORIES)], [children(spark, CASES)]))
    assert {(r.period, r.reason): r.orphans for r in report.collect()}[("2025-03", "missing")] == 3


def test_unknown_edge_types_lead_nowhere(spark):
    kinds = spark.createDataFrame([(" mentions ",), ("OTHER",), (None,)], "edge_type string")
    got = kinds.select("edge_type", edge_target(0).alias("a"), edge_target(1).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("memories", "entities"), (None, None), (None, None)]
