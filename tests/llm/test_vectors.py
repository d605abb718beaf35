import pathlib
import subprocess
import sys

import numpy as np
import pytest

from sagekeep.llm import vectors
from sagekeep.llm.vectors import match, similar_neighbours, unordered_pairs, usable_vectors

SCHEMA = "id string, v array<float>, vector string, order string, similarity double"


def cases(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    matrix = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base * 3.0])[:n].astype(np.float32)
    matrix[5:12] = matrix[4]  # copies
    return [(f"id{i:04d}", [float(x) for x in row]) for i, row in enumerate(matrix)]


def brute_force(rows, k, least):
    ids = [i for i, _ in rows]
    matrix = np.array([v for _, v in rows], np.float64)
    norms = np.sqrt((matrix * matrix).sum(1))
    near = np.round(matrix @ matrix.T / np.outer(norms, norms), 12)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and near[a, b] >= least), key=lambda b: (-near[a, b], ids[b]))
        out |= {(ids[a], ids[b]) for b in order[:k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 0.0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("k", "least"), [(5, 0.9), (3, -1.0)])
def test_neighbours_are_those_of_brute_force(spark, k, least, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    monkeypatch.setattr(vectors, "TILE_COLUMNS", 100)
    rows = cases()
    odd = [("null", None), ("zero", [0.0] * 8), ("short", [1.0] * 7), ("nan", [float("nan")] * 8), ("hole", [None] + [1.0] * 7), (None, [1.0] * 8)]
    got = similar_neighbours(frame(spark, rows + odd + rows[:3]), "id", "v", k, least, dim=8).collect()
    assert {(r.id, r.other) for r in got} == brute_force(rows, k, least)
    assert len(got) == len({(r.id, r.other) for r in got})


def test_several_blocks_give_the_same(spark, monkeypatch):
    rows = cases(seed=4)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 90)
    got = similar_neighbours(frame(spark, rows), "id", "v", 4, 0.5, dim=8).collect()
    assert {(r.id, r.other) for r in got} == brute_force(rows, 4, 0.5)


def test_a_group_of_copies_makes_no_pairs_of_all(spark):
    rows = [(f"c{i:05d}", [1.0, 2.0, 3.0, 4.0]) for i in range(2000)] + [("z", [1.0, 2.0, 3.0, 4.5])]
    got = similar_neighbours(frame(spark, rows), "id", "v", 5, 0.9, dim=4)
    assert got.count() == 5 * len(rows)
    pairs = {tuple(r) for r in unordered_pairs(got).collect()}
    assert ("c00000", "c01999") in pairs and ("c00007", "c01999") not in pairs and ("c00000", "z") in pairs


def test_empty_and_single(spark):
    empty = frame(spark, [("a", [1.0] * 8)])
    assert similar_neighbours(empty, "id", "v", 5, 0.0, dim=8).collect() == []
    assert similar_neighbours(empty.filter("false"), "id", "v", 5, 0.0, dim=8).collect() == []


def test_match_best_and_first(spark):
    rows = cases(90, seed=2)
    table = usable_vectors(frame(spark, rows), "id", "v", 8).selectExpr("id", "vector", "cast(substring(id, 3) as long) as order").cache()
    matrix = np.array([v for _, v in rows], np.float64)
    unit = matrix / np.sqrt((matrix * matrix).sum(1))[:, None]
    near = np.round(unit @ unit.T, 12)
    best = {r.id: r.other for r in match(table, table, 0.9, earlier=True, dim=8).collect()}
    first = {r.id: r.other for r in match(table, table, 0.9, earlier=True, first=True, dim=8).collect()}
    for a in range(len(rows)):
        fits = [b for b in range(a) if near[a, b] >= 0.9]
        name = f"id{a:04d}"
        assert first.get(name) == (f"id{fits[0]:04d}" if fits else None)
        assert best.get(name) == (f"id{min(fits, key=lambda b: (-near[a, b], b)):04d}" if fits else None)
    table.unpersist()


@pytest.mark.parametrize("dense", [0.0, 1e9])
def test_matrices_meet_once_or_twice_with_the_same_result(spark, dense, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "DENSE", dense)
    rows = cases(seed=6)
    got = similar_neighbours(frame(spark, rows), "id", "v", 3, 0.3, dim=8).collect()
    assert {(r.id, r.other) for r in got} == brute_force(rows, 3, 0.3)
    assert len(got) == len({(r.id, r.other) for r in got})


def test_of_an_id_with_several_vectors_the_smallest_counts(spark):
    rows = [("a", [1.0, 0.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0, 0.0]), ("b", [1.0, 0.1, 0.0, 0.0]), ("c", [0.1, 1.0, 0.0, 0.0])]
    got = similar_neighbours(frame(spark, rows), "id", "v", 2, 0.9, dim=4).collect()
    assert {(r.id, r.other) for r in got} == {("a", "c"), ("c", "a")}  # of the bytes, 0.0 comes before 1.0


def written_by_exchanges(tmp_path, frame_of):
    """Bytes that all exchanges of a query wrote, and bytes of the folder that tasks share."""
    root = tmp_path / "run"
    root.mkdir()
    code = f"""
import sys, pathlib
sys.path[:0] = {[str(pathlib.Path(vectors.__file__).parents[2]), str(pathlib.Path(__file__).parents[2])]!r}
import numpy as np
from pyspark.sql import functions as F
from sagekeep.runtime import build_session
spark = build_session("t", 2, **{{"spark.checkpoint.dir": "file://{root}/shared", "spark.local.dir": "{root}/local", "spark.cleaner.referenceTracking": "false", "spark.shuffle.compress": "true", "spark.driver.memory": "2g"}})
rng = np.random.default_rng(3)
matrix = rng.normal(size=(30_000, 64)).astype("f4")
spark.createDataFrame([(f"id{{i:06d}}", row.tolist(), i) for i, row in enumerate(matrix)], "id string, v array<float>, n long").write.parquet("{root}/in")
t = spark.read.parquet("{root}/in")
size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).rglob("*") if f.is_file()) if pathlib.Path(p).exists() else 0
before = size("{root}/local")
{frame_of}
print("BYTES", size("{root}/local") - before, size("{root}/shared"), size("{root}/in"))
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "BYTES" in said.stdout, said.stderr[-2000:]
    return [int(x) for x in said.stdout.split("BYTES")[1].split()[:3]]


def test_each_vector_is_written_to_the_disk_at_most_three_times(spark, tmp_path):
    exchanged, shared, given = written_by_exchanges(
        tmp_path, "from sagekeep.llm.vectors import similar_neighbours\nprint(similar_neighbours(t, 'id', 'v', 5, 0.9).count())"
    )
    assert exchanged + shared < 3 * given
