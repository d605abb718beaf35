import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sagekeep.sources import chunking, config, sessions
from sagekeep.sources.store import Store


@pytest.mark.parametrize(
    ("text", "size", "overlap", "spans"),
    [
        ("aaaa bbbb cccc dddd", 10, 2, [(0, 9), (7, 7), (12, 7)]),
        ("a" * 25, 10, 3, [(0, 10), (7, 10), (14, 10), (21, 4)]),
        ("", 10, 3, [(0, 0)]),
        ("short", 10, 3, [(0, 5)]),
    ],
)
def test_char_spans(text, size, overlap, spans):
    assert list(chunking.char_spans(text, size, overlap)) == spans


def test_crawling_chunks_and_the_step_that_stops_them():
    text = "a" * 50 + "\n\n" + "b" * 120
    found = list(chunking.char_spans(text, 100, 20))
    assert len(found) == 25 and found[:4] == [(0, 50), (30, 20), (31, 19), (32, 18)] and found[-1] == (132, 40)
    assert len(list(chunking.char_spans(text, 100, 20, least_step=30))) < 6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_chunks_cover_the_text(text, size, overlap):
    covered = set()
    for start, length in chunking.char_spans(text, size, overlap):
        assert length <= size
        covered |= set(range(start, start + length))
    # A break itself may fall between two chunks when nothing overlaps.
    assert all(text[i] in " \n" for i in set(range(len(text))) - covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aab \n", max_size=300), st.integers(5, 40), st.integers(0, 4), st.integers(2, 30))
def test_larger_steps_leave_no_text_out(text, size, overlap, least_step):
    covered = set()
    for start, length in chunking.char_spans(text, size, overlap, least_step):
        assert length <= size and (length > 0 or not text)
        covered |= set(range(start, start + length))
    assert covered == set(range(len(text)))


def test_step_past_an_early_break():
    text = "a" * 20 + "\n\n" + "b" * 200
    assert list(chunking.char_spans(text, 100, 10, least_step=60)) == [(0, 20), (20, 100), (110, 100), (200, 22)]


def pack(spark, blocks, size, overlap):
    rows = [("k", i, b, None) for i, b in enumerate(blocks)]
    frame = spark.createDataFrame(rows, "k string, i long, b string, t timestamp")
    found = chunking.block_chunks(frame, "k", "i", "b", "t", size, overlap).orderBy("sequence_no").collect()
    return [r.text for r in found]


@pytest.mark.parametrize(
    ("blocks", "size", "overlap", "chunks"),
    [
        (["aaaa", "bbbb", "cccc"], 10, 0, ["aaaa\n\nbbbb", "cccc"]),
        (["aaaa", "bbbb", "cccc"], 10, 3, ["aaaa\n\nbbbb", "bbbb\n\ncccc"]),
        (["bb", "x" * 15], 10, 0, ["bb", "x" * 15]),
        (["bb", "x" * 15], 10, 1, ["bb", "bb\n\n" + "x" * 15]),
        (["x" * 15, "x" * 15, "c"], 10, 5, ["x" * 15, "x" * 15, "c"]),
    ],
)
def test_block_chunks(spark, blocks, size, overlap, chunks):
    assert pack(spark, blocks, size, overlap) == chunks


def test_char_chunks_of_a_frame(spark):
    frame = spark.createDataFrame([(1, "aaaa bbbb cccc dddd"), (2, None), (3, "")], "id long, text string")
    found = chunking.char_chunks(frame, "id", "text", 10, 2).orderBy("id", "sequence_no").collect()
    assert [(r.id, r.sequence_no, r.start_char, r.text) for r in found] == [(1, 1, 0, "aaaa bbbb"), (1, 2, 7, "bb cccc"), (1, 3, 12, "cc dddd"), (3, 1, 0, "")]


LINES = [
    '{"type":"system","timestamp":"2024-01-01T00:00:00Z","content":"x"}',
    '{"type":"user","timestamp":"2024-01-01T01:00:00Z","message":{"role":"user","content":"hi"}}',
    "not json",
    '{"message":{"role":"assistant","content":[{"type":"thinking","text":"t"},{"type":"tool_use"},{"type":"text","text":" done "},"more",{"text":"untyped"}]}}',
    "",
    None,
    "[1]",
    '{"type":"user","content":{"text":"no list"}}',
]


def test_session_lines(spark):
    frame = spark.createDataFrame([(i, "s", line) for i, line in enumerate(LINES)] + [(1, "s", LINES[1])], "line_id long, session_id string, raw_line string")
    blocks = sessions.session_blocks(frame)
    text = sessions.session_texts(blocks).first()
    assert text.text == "user: hi\n\nassistant: done\nmore\nuntyped" and text.blocks == 2
    assert str(sessions.earliest_stamps(frame).first().earliest) == "2024-01-01 00:00:00"
    assert sessions.detected_formats(frame).first().format == "session"
    late = spark.createDataFrame([(0, "s", "not json"), (1, "s", LINES[1])], "line_id long, session_id string, raw_line string")
    assert sessions.detected_formats(late).first().format == "plain"


def test_lines_sent_again_under_a_new_id(spark):
    said = lambda uuid, text: json.dumps({"type": "user", "content": text} | ({"uuid": uuid} if uuid != "none" else {}))
    lines = [(5, "s", said("u", "one")), (2, "s", said("u", "one")), (3, "t", said("u", "other session")), (4, "s", said("1", "text")), (6, "s", said(1, "number"))]
    lines += [(7 + i, "s", said(u, "kept")) for i, u in enumerate(["none", "none", None, None, "", ""])]
    frame = spark.createDataFrame(lines, "line_id long, session_id string, raw_line string")
    assert {r.line_id for r in sessions.session_blocks(frame).collect()} == {2, 3, 4, *range(6, 13)}
    assert sessions.session_blocks(frame, by_uuid=False).count() == 11
    texts = {r.session_id: r.blocks for r in sessions.session_texts(sessions.session_blocks(frame)).collect()}
    assert texts == {"s": 9, "t": 1}


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\r\nthree", newline="")
    (tmp_path / "deep" / "b.txt").write_text("x")
    found = sessions.read_documents(spark, [str(tmp_path)], recursive=True, pattern="*.txt")
    assert found.count() == 2
    assert [r.raw_line for r in sessions.text_lines(found.filter("path LIKE '%a.txt'")).orderBy("line_id").collect()] == ["one", "two", "three"]


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SAGE_HOST", "there")
    (tmp_path / "base.json").write_text(json.dumps({"storage": {"host": "here", "port": 1}, "retrieval": {}}))
    (tmp_path / "own.json").write_text(json.dumps({"include": "base.json", "storage": {"host": "${SAGE_HOST}"}, "hygiene": {"dir": "${NO_SUCH:-default}"}}))
    settings_ = config.validate(config.load_settings(tmp_path / "own.json"))
    assert settings_ == {"storage": {"host": "there", "port": 1}, "retrieval": {}, "hygiene": {"dir": "default"}}
    (tmp_path / "base.json").write_text(json.dumps({"include": ["own.json"]}))
    with pytest.raises(ValueError, match="includes itself"):
        config.load_settings(tmp_path / "own.json")
    with pytest.raises(ValueError, match="retrieval"):
        config.validate({"storage": 1, "hygiene": 2})


def test_store_publishes_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() is None and store.read("memories").count() == 0
    edges = spark.createDataFrame([("e1", "a", "b", "RELATED"), ("e2", "a", "c", "MENTIONS")], "edge_id string, from_node string, to_node string, edge_type string")
    first = store.publish(edges=edges, chunks=spark.createDataFrame([("c",)], "chunk_id string"))
    assert store.version() == first and store.read("edges").count() == 2
    store.publish(edges=store.read("edges").filter("edge_type = 'RELATED'"))
    assert [r.edge_id for r in store.read("edges").collect()] == ["e1"] and store.read("chunks").count() == 1
    broken = spark.range(1).selectExpr("raise_error('stop') AS edge_id")
    version = store.version()
    with pytest.raises(Exception, match="stop"):
        store.publish(edges=broken)
    assert store.version() == version and store.read("edges").count() == 1


def test_store_appends_without_touching_what_is_there(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "store")), "edge_id string, edge_type string"
    store.append(edges=spark.createDataFrame([("e1", "RELATED")], schema), sources=spark.createDataFrame([], "source_id string"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    version = store.version()
    store.append(edges=spark.createDataFrame([("e2", "MENTIONS")], schema))
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert {(r.edge_id, r.edge_type) for r in store.read("edges").collect()} == {("e1", "RELATED"), ("e2", "MENTIONS")} and store.read("sources").count() == 0
    with pytest.raises(RuntimeError, match="in the meantime"):
        Store(spark, store.root).append(since=version, edges=spark.createDataFrame([("e3", "MENTIONS")], schema))
    assert store.read("edges").count() == 2


def test_recall_inputs(spark, rows):
    inputs = [
        (1, "plain question?"), (2, '[{"role": "user", "content": "hi"}, {"role": "system", "content": "no"}, {"role": "Assistant", "content": [{"type": "text", "text": " done "}, {"type": "tool_use"}]}]'),
        (3, "[]"), (4, None), (5, '{"role": "user", "content": "an object is plain"}'), (6, "[1, 2]"),
    ]
    found = sessions.conversation_texts(spark.createDataFrame(inputs, "id int, text string"), "id")
    assert rows(found) == [(1, "plain question?"), (2, "user: hi\n\nassistant: done"), (5, '{"role": "user", "content": "an object is plain"}')]
