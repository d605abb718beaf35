import random

from sagekeep.llm.spans import shared_part, shared_spans

SCHEMA = "doc_id long, text string, windows string, start long"


def brute_force(rows, least):
    holders = {}
    for doc, text in rows:
        for at in range(len(text or "") - least + 1):
            holders.setdefault(text[at : at + least], set()).add(doc)
    out = []
    for doc, text in {r for r in rows if r[0] is not None}:
        marks = [False] * len(text or "")
        for at in range(len(marks) - least + 1):
            if holders[text[at : at + least]] - {doc}:
                marks[at : at + least] = [True] * least
        start = None
        for at, mark in enumerate([*marks, False]):
            if mark and start is None:
                start = at
            elif not mark and start is not None:
                out.append((doc, start, at))
                start = None
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdefgh äöü中🙂\n\x00"
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (119, 120, 121, 150, 400, 900)]
    rows = []
    for doc in range(40):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 4)):
            cut = rng.choice(passages)
            at = rng.randint(0, 10)
            parts += [cut[at : len(cut) - rng.randint(0, 10)], "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))]
        rows.append((doc, "".join(parts)))
    return rows


def test_against_brute_force(spark, rows):
    cases = texts(1) + [
        (100, None), (101, ""), (102, "x" * 119), (103, "x" * 120), (104, "x" * 500), (105, "ab" * 300), (106, "ba" * 200),
        (107, "only once " * 40), (107, "only once " * 40),
    ]
    assert rows(shared_spans(frame(spark, cases))) == sorted(brute_force(cases, 120), key=repr)


def test_long_text_is_cut_without_loss(spark, rows, monkeypatch):
    from sagekeep.llm import spans

    monkeypatch.setattr(spans, "SLAB", 150)
    cases = texts(2)
    assert rows(shared_spans(frame(spark, cases))) == sorted(brute_force(cases, 120), key=repr)


def test_group_of_copies_gives_one_row_each(spark):
    text = "".join(random.Random(3).choice("abcdefghij ") for _ in range(300))
    cases = [(i, text) for i in range(500)] + [(None, text)]
    found = shared_spans(frame(spark, cases)).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0, 300) for i in range(500)]


def test_a_passage_in_every_document(spark, rows):
    rng = random.Random(4)
    words = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    boiler, other = words(260), words(200)
    cases = [(i, words(rng.randint(0, 150)) + boiler[i % 7 :] + words(rng.randint(0, 90)) + (other[: 190 - i % 50] if i % 3 else "")) for i in range(90)]
    cases += [(200 + i, boiler[: 130 + i] + words(40)) for i in range(10)] + [(300, boiler * 3), (301, words(400))]
    assert rows(shared_spans(frame(spark, cases))) == sorted(brute_force(cases, 120), key=repr)


def test_empty_table_and_parts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shared_spans(empty).collect() == []
    cases = frame(spark, [(1, "y" * 240), (2, "y" * 120 + "z" * 120), (3, None)])
    parts = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_part) for r in shared_part(cases, shared_spans(cases)).collect()}
    assert parts == {1: (240, 240, 1.0), 2: (240, 120, 0.5), 3: (0, 0, 0.0)}
