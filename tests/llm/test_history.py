import pathlib
import random

import numpy as np

from sagekeep.llm.history import ChunkHistory, chunks_of, one_blank, repeats
from sagekeep.llm.vectors import usable_vectors

from pyspark.sql import functions as F

NEW = "commit_id string, batch_no int, seq_no int, content string, content_embedding array<float>, id string, digest string"
OLD = "id string, content string, content_embedding array<float>, body string"


def unit(*values):
    return [float(v) for v in values]


def sequential(old, new, least=0.92):
    """The plain definition, one record after another."""

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 12)

    clean = lambda t: None if t is None else " ".join(t.split())
    usable = lambda v: v is not None and len(v) == 4 and any(v)
    accepted = [(i, clean(t), v if usable(v) else None) for i, t, v in old]
    out = set()
    last = lambda n: 2**40 if n is None else n
    for name, _, _, text, vector in sorted(new, key=lambda r: (last(r[1]), last(r[2]), r[0])):
        text = clean(text)
        equal = sorted(i for i, t, _ in accepted if t is not None and t == text)
        if equal:
            out.add((name, equal[0]))
            continue
        near = sorted((-cosine(vector, v), i) for i, _, v in accepted if usable(vector) and v and cosine(vector, v) >= least)
        if near:
            out.add((name, near[0][1]))
        else:
            accepted.append((name, text, vector if usable(vector) else None))
    return out


def run(spark, old, new):
    memories = spark.createDataFrame([(*r, "x") for r in old], OLD)
    history = ChunkHistory(spark, parts=4)
    vectors = usable_vectors(memories, "id", "content_embedding", 4)
    history.append(memories.select("id", one_blank(F.col("content")).alias("body")).join(vectors, "id", "left"))
    found = repeats(spark.createDataFrame([(*r, "x", "y") for r in new], NEW), history, dim=4)
    return {(r.id, r.match) for r in found.collect()}, history


def test_chains_copies_and_odd_rows(spark):
    rng = random.Random(2)
    old = [("m1", "the first memory of all", unit(1, 0, 0, 0)), ("m2", None, None), ("m3", "", unit(0, 0, 0, 0)), ("m4", "long " * 20_000, unit(0, 1, 0)), ("m0", "the first  memory of all", None)]
    new = [
        ("c01", 1, 1, " the first\n memory of all ", None),
        ("c02", 1, 2, "The first memory of all", None),
        ("c03", 1, 3, "  ", None),
        ("c04", 1, 4, None, None),
        ("c05", 1, 5, None, unit(1, 0.1, 0, 0)),
        ("c06", 1, 6, "long " * 20_000, None),
        ("c10", 2, 1, "chain a", unit(0, 0, 1, 0)),
        ("c11", 2, 2, "chain b", unit(0, 0, 1, 0.4)),
        ("c12", 2, 3, "chain c", unit(0, 0, 1, 0.9)),
        ("c13", 2, 4, "chain b", unit(0, 0, 1, -0.9)),
        ("c14", 2, 5, "chain d", unit(0, 0, 2, 0.8)),
    ]
    new += [(f"d{i:02d}", 3, i, f"text {rng.randint(0, 9)}", unit(*(rng.choice([-1, 0, 1, 2]) for _ in range(4)))) for i in range(60)]
    new += [(f"e{i:02d}", 4, i, f"copy number {i}", unit(3, 3, -3, 1)) for i in range(40)] + [new[0]]
    found, history = run(spark, old, new)
    assert found == sequential(old, {r[0]: r for r in new}.values())
    # What was accepted is now part of the history.
    again = spark.createDataFrame([("n1", "chain a"), ("n2", "never seen before")], "id string, body string")
    hits = history.covered(again).filter("equal").collect()
    assert [(r.record, r.accepted, r.coverage) for r in hits] == [("n1", "c10", 1.0)]


def test_coverage_of_partly_shared_texts(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared, other = words(150), words(30)
    history = ChunkHistory(spark)
    history.append(spark.createDataFrame([("old", shared, None), ("far", words(150), None)], "id string, body string, vector binary"))
    found = history.covered(spark.createDataFrame([("new", shared + " " + other)], "id string, body string"), 0.6).collect()
    assert [r.accepted for r in found] == ["old"] and 0.7 < found[0].coverage < 0.95 and not found[0].equal


def test_nothing_new_and_no_history(spark):
    assert run(spark, [], [])[0] == set()
    assert run(spark, [("m", "text", unit(1, 0, 0, 0))], [])[0] == set()
    assert run(spark, [], [("a", 1, 1, "x y", None), ("b", 1, 2, "x  y", None)])[0] == {("b", "a")}


def test_places_that_are_equal_missing_or_large(spark):
    new = [(f"c{i}", None, None, f"the same text {i % 3}", None) for i in (2195, 19910, 5, 77, 404, 31)]
    new += [("z1", 2**30, 2**31 - 2, "the same text 0", None), ("z2", 2**30, 2**31 - 3, "the same text 1", unit(1, 1, 0, 0)), ("z3", 1, 2**31 - 1, "other", unit(1, 1, 0, 0.1))]
    assert run(spark, [], new)[0] == sequential([], new)


def test_a_second_batch_reads_only_what_the_first_one_wrote(spark):
    old = [(f"m{i}", f"memory number {i} " * 3, unit(i, 1, 0, 0)) for i in range(30)] + [("b", "boiler plate " * 40 + "end", None)]
    first = [(f"c{i}", 1, i, f"memory number {i} " * 3, unit(0, 0, i, 1)) for i in range(20, 40)]
    found, history = run(spark, old, first)
    assert found == sequential(old, first)
    written = history.vectors().inputFiles()
    second = [(f"d{i}", 2, i, f"memory number {i} " * 3, unit(0, 1, i, 1)) for i in range(25, 50)] + [("dd", 2, 99, "boiler  plate " * 40 + " end", None)]
    again = repeats(spark.createDataFrame([(*r, "x", "y") for r in second], NEW), history, dim=4)
    accepted = old + [(r[0], *r[3:]) for r in first if r[0] not in {i for i, _ in found}]
    assert {(r.id, r.match) for r in again.collect()} == sequential(accepted, second)
    assert set(written) < set(history.vectors().inputFiles())
    one = spark.createDataFrame([(5,)], "chunk long")
    touched = history._touched("chunks", "record string, chunk long", one, "chunk").select(F.input_file_name().alias("f")).distinct()
    assert len({r.f.split("part=")[1].split("/")[0] for r in touched.collect()}) == 1


def test_coverage_in_place_decides_equality_alone(spark):
    rng = random.Random(11)
    piece = lambda: "".join(rng.choice("abcdefgh ") for _ in range(400))
    a, b, c = piece(), piece(), piece()
    turned = a + b + a + c, a + c + a + b
    history = ChunkHistory(spark, parts=4)
    history.append(spark.createDataFrame([("old", turned[0], None), ("blank", "", None)], "id string, body string, vector binary"))
    new = spark.createDataFrame([("same", turned[0]), ("turned", turned[1]), ("none", ""), ("other", piece())], "id string, body string")
    found = {(r.record, r.accepted): r for r in history.covered(new, 0.5).collect()}
    assert {key for key, r in found.items() if r.equal} == {("same", "old"), ("none", "blank")}
    assert found["turned", "old"].coverage > 0.8
    # No digest of a text is kept that could decide instead.
    assert sorted(p.name for p in pathlib.Path(history.path.removeprefix("file://")).iterdir()) == ["chunks", "vectors"]


def test_passages_in_another_order_are_covered_but_not_equal():
    pieces = [b"one passage of it, ", b"and another passage, "]
    first, second = (chunks_of(b"".join(x), np.array([len(x[0])])) for x in (pieces, pieces[::-1]))
    assert {k: v[:2] for k, v in first.items()} == {k: v[:2] for k, v in second.items()}
    assert all(first[k][2] != second[k][2] for k in first)
