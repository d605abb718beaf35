import json
from datetime import datetime, timedelta

import pytest

from sagekeep.llm.conversations import conversations, message_text, moment_of, parse_line, parsed

START = datetime(2025, 3, 1)


def line(role, text="hello", minute=0, uuid=None, **more):
    record = {"type": role, "message": {"role": role, "content": text}, "timestamp": f"2025-03-01T10:{minute:02d}:00Z"}
    if uuid:
        record["uuid"] = uuid
    return json.dumps(record | more)


SESSIONS = {
    "sound": [line("user", minute=1), line("assistant", minute=2), line("assistant", minute=3), line("user", minute=4), line("assistant", minute=5)],
    "late": [line("assistant", minute=9), line("user", minute=1)],
    "again": [line("user", minute=1, uuid="a"), line("assistant", minute=2, uuid="b"), line("user", minute=1, uuid="a"), line("user", minute=1, uuid="a")],
    "unanswered": [line("user", minute=1), line("assistant", minute=2), line("user", minute=3)],
    "opened by the other": [line("assistant", minute=1), line("user", minute=2), line("assistant", minute=3)],
    "broken": [line("user", minute=1), "{broken", line("assistant", minute=2)],
    "no object": [line("user", minute=1), "[1, 2]", line("assistant", minute=2)],
    "no time": [line("user", minute=1), line("assistant", timestamp="yesterday")],
    "no time, no turn": [line("user", minute=1), line("system", timestamp="yesterday"), line("assistant", minute=2)],
    "empty": [line("system"), json.dumps({"type": "user", "content": "  "}), None, "   "],
    "blank lines": [None, " \n", line("user", minute=1), line("assistant", minute=2)],
    "odd roles": [line(" User ", minute=1), line("ASSISTANT", minute=2)],
    "same moment": [line("user", minute=1), line("assistant", minute=1)],
    "long": [line("user", "x" * 200_000, minute=1), line("assistant", "y", minute=2)],
}
EXPECTED = {"sound": [1, 2, 2, 3, 4], "late": [2, 1], "again": [1, 2], "no time, no turn": [1, None, 2], "blank lines": [None, None, 1, 2], "odd roles": [1, 2], "same moment": [1, 2], "long": [1, 2]}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows, expected, number = [], set(), 0
    for session, lines in SESSIONS.items():
        for place, raw in enumerate(lines):
            number += 1
            rows.append((number, session, "s", START + timedelta(days=number % 40, minutes=number), raw, 7))
            turns = EXPECTED.get(session, [])
            if place < len(turns) and turns[place]:
                expected.add((session, turns[place], number))
    rows += [(900, None, "s", START, line("user"), 7), (901, "sound", "s", None, None, 7), rows[0], rows[1]]
    path = str(tmp_path_factory.mktemp("lines") / "session_lines.parquet")
    frame = spark.createDataFrame(rows, "line_id long, session_id string, source_id string, received_at timestamp, raw_line string, turn_no int")
    frame.repartition(3).write.parquet(path)
    return path, expected


def test_sound_sessions_only(spark, table):
    path, expected = table
    assert {tuple(r) for r in conversations(spark, path).collect()} == expected


def test_lines_without_a_session_go_nowhere(spark):
    lines = [(i, None, line("user"), START) for i in range(50)] + [(None, None, None, START), (None, None, None, None), (1, "s", line("user"), START)]
    frame = spark.createDataFrame(lines, "line_id long, session_id string, raw_line string, received_at timestamp")
    assert [r.session_id for r in parsed(frame).collect()] == ["s"]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "line_id long, session_id string, received_at timestamp, raw_line string").write.parquet(path)
    assert conversations(spark, path).collect() == []


def test_texts_and_moments():
    assert message_text("a") == "a" and message_text(None) == "" and message_text({"text": "x"}) == ""
    blocks = ["a", {"type": "text", "text": "b"}, {"text": "c"}, {"type": "thinking", "text": "d"}, {"type": "text"}, 5]
    assert message_text(blocks) == "a\nb\nc"
    same = {moment_of(t) for t in ("2025-01-05T10:00:00Z", "2025-01-05T10:00:00", "2025-01-05 05:00:00-05:00", "2025-01-05T12:00:00.000+02:00")}
    assert len(same) == 1
    assert [moment_of(t) for t in ("", "25:61", "n/a", None, 5)] == [None] * 5
    assert parse_line('{"type": "user", "message": {"content": "x"}}')[0] == 0  # a message without a role has none
    assert parse_line("[" * 100_000)[0] == 1
