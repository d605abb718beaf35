import pytest

from sagekeep.llm.components import components
from sagekeep.llm.names import NameParser, link_names, linked_pairs
from sagekeep.llm.tries import BOUND, Automaton, distance, edits_allowed, make_trie, near_words, shards_of, shards_to_ask, traverse

ALIASES = [
    ("Liz", "Elizabeth", "given"), ("Beth", "Elizabeth", "given"), ("Alex", "Alexander", "given"), ("Alex", "Alexandra", "given"),
    ("Labs", "Laboratories", "org_word"), ("RI", "Research Institute", "org_word"), ("Ltd", "Limited", "org_suffix"), ("L.L.C.", "LLC", "org_suffix"),
]
GROUPS = [
    ["Elizabeth Torvastrup", "Torvastrup, Liz", "elizabeth  TORVASTRUP", "Elizabeth K. Torvastrop", "Beth_Torvastrup", "Dr. Elizabeth Tórvastrup", "E. Torvastrup", "Elizabeth Torvsatrup"],
    ["Margaret Torvastrup"],
    ["Alexander Bremolint", "Bremolint, Alexander"],
    ["Alexandra Bremolint"],
    ["Alex Bremolint"],  # fits two
    ["Gunvalder Laboratories Limited", "The Gunvalder Labs Ltd.", "Gunvalder, Laboratories (Ltd)", "GUNVALDER LABORATORIES", "Gunvalder Laborotories Ltd"],
    ["Gunvalder Research Institute LLC", "Gunvalder RI L.L.C.", "GunvalderResearch Institute"],
    ["Torvastrup"],
    [None], [" "], ["B."],
]
SCHEMA = "id string, entity_type string, canonical_name string, norm_key string, merged_into string, entity string, kind string"


def test_groups_of_spellings(spark):
    entities, expected = [], set()
    for number, names in enumerate(GROUPS):
        ids = [f"e{number:02d}{i}" for i in range(len(names))]
        entities += [(i, " org" if number in (5, 6) else "Person", n, None, None, "x", "y") for i, n in zip(ids, names, strict=True)]
        expected |= {(a, b) for a in ids for b in ids if a < b}
    entities += [
        ("m1", "PERSON", "Quite Different", None, "e010", "x", "y"),  # a recorded merge
        ("m2", "PERSON", "Nobody Knows", "PERSON:margaret torvastrup", "", "x", "y"),  # a recorded key
        ("m3", "PERSON", "Gone Merge", None, "not there", "x", "y"),
        ("t1", "TOOL", "Elizabeth Torvastrup", None, "e000", "x", "y"),
        (None, "PERSON", "Elizabeth Torvastrup", None, None, "x", "y"),
        entities[0],
    ]
    expected |= {("e010", "m1"), ("e010", "m2"), ("m1", "m2")}
    found = linked_pairs(link_names(spark.createDataFrame(entities, SCHEMA), spark.createDataFrame(ALIASES, "alias string, full_form string, kind string")))
    assert {tuple(r) for r in found.collect()} == expected


def test_empty_tables(spark):
    aliases = spark.createDataFrame([], "alias string, full_form string, kind string")
    assert linked_pairs(link_names(spark.createDataFrame([], SCHEMA), aliases)).collect() == []
    rows = [(str(i), "PERSON", "Same Person", None, None, "x", "y") for i in range(4)]
    assert linked_pairs(link_names(spark.createDataFrame(rows, SCHEMA), aliases)).count() == 6


def test_parser():
    parser = NameParser(ALIASES)
    assert parser.parse("PERSON", "Prof. Ann-Marie  O'Néill, PhD")[0] == ["ann", "marie", "neill"]
    assert parser.parse("PERSON", "Torvastrup, Liz B.") == (["torvastrup", "liz"], "b", ["torvastrup"])
    assert parser.parse("ORG", "The Gunvalder R1 L.L.C.")[0] == ["gunvalder", "research", "institute"]
    assert len(parser.parse("PERSON", "word " * 50_000)[0]) == 50_000


@pytest.mark.parametrize(("a", "b", "edits"), [("abcd", "abdc", 1), ("abcd", "abcd", 0), ("abcd", "bcd", 1), ("kitten", "sitting", 3), ("", "ab", 2)])
def test_distance(a, b, edits):
    assert distance(a, b) == distance(b, a) == edits


def test_tries_find_all_within_the_bound(spark, monkeypatch):
    import random

    from sagekeep.llm import tries

    monkeypatch.setattr(tries, "HOT_SHARD", 0.1)
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(300)} | {"kim", "kmi", "kiim", "tim", "wu", "uw"}
    trie = make_trie(sorted(words))
    for word in sorted(words)[:40]:
        within = set(traverse(trie, Automaton(word)))
        assert {w for w in words if distance(w, word) <= BOUND} | {word} >= within - {word}
    near = {(a, b) for a in words for b in set(traverse(trie, Automaton(a))) if a < b and 0 < distance(a, b) <= edits_allowed(a, b)}
    for a, b in near:
        assert set(shards_of(b)) & shards_to_ask(a) and set(shards_of(a)) & shards_to_ask(b)
    frame = spark.createDataFrame([("k", w) for w in sorted(words)], "kind string, word string")
    found = [(r.word, r.other) for r in near_words(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == near
    assert {("kim", "kmi"), ("kiim", "kim")} <= near and not {("kim", "tim"), ("uw", "wu")} & near


def linked(spark, names, kind="PERSON"):
    rows = [(f"{i:03d}", kind, n, None, None, "x", "y") for i, n in enumerate(names)]
    aliases = spark.createDataFrame([], "alias string, full_form string, kind string")
    found = {tuple(r) for r in linked_pairs(link_names(spark.createDataFrame(rows, SCHEMA), aliases)).collect()}
    return {(names[int(a)], names[int(b)]) for a, b in found}


FAMILIES = ["Torvastrup", "Bremolint", "Gunvalder", "Kestorin", "Pladovic", "Ostremar", "Quilbeth", "Ravenskol", "Solbrikke", "Umlauten", "Vostergan", "Wilkotrin", "Yarbinsk", "Zelmander"]


@pytest.mark.parametrize("misspelt", [3, 8, 14])
def test_a_slip_stays_one_however_often_it_is_met(spark, misspelt):
    names = [f"Margaret {f}" for f in FAMILIES] + [f"Margeret {f}" for f in FAMILIES[:misspelt]]
    assert linked(spark, names) == {(f"Margaret {f}", f"Margeret {f}") for f in FAMILIES[:misspelt]}


def test_all_given_names_count_in_any_order(spark):
    names = ["John Michael Torvastrup", "John Patrick Torvastrup", "Torvastrup, Michael John", "John Torvastrup", "Anna Maria Bremolint", "Anna Bremolint", "Maria Anna Bremolimt"]
    names += [f"{given} {f}" for given in ("John", "Michael", "Patrick", "Anna", "Maria") for f in FAMILIES[3:]]
    assert linked(spark, names) == {
        ("John Michael Torvastrup", "Torvastrup, Michael John"),
        ("Anna Maria Bremolint", "Anna Bremolint"), ("Anna Maria Bremolint", "Maria Anna Bremolimt"), ("Anna Bremolint", "Maria Anna Bremolimt"),
    }


def test_short_words_and_long_names(spark):
    names = ["Kim Lee", "Lee, Kim", "Kmi Lee", "Tim Lee", "Kim Wu", "Wu Kim", "Kim Li"]
    long = " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(10))
    names += [long, " ".join(reversed(long.split())), long + " more"]
    found = linked(spark, names)
    assert {("Kim Lee", "Lee, Kim"), ("Kim Wu", "Wu Kim"), (long, " ".join(reversed(long.split())))} <= found
    assert not {("Kim Lee", "Tim Lee"), ("Kim Lee", "Kim Wu"), ("Kim Wu", "Kim Li"), (long, long + " more")} & found


def test_components(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "z")]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"n{i:02d}"] for i in range(31)} == {"n00"}
    assert found["x"] == found["y"] == "x" and found["z"] == "z"


def test_hub_of_many_links(spark):
    edges = [("hub", f"n{i:03d}") for i in range(300)] + [("n000", "a"), ("b", "c")]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in found.items() if k not in "bc"} == {"a"} and found["c"] == "b" and len(found) == 304
