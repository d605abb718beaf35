"""Rebuilding conversations from single message lines (problem 1).

The lines are a stream, keyed by session. A line is parsed to a few numbers (role,
moment, id) before anything is exchanged; the texts stay behind. The state of a
session buffers its lines, late and repeated ones too, until the watermark has
passed the session's last line by ``CLOSED_AFTER``; then the session is checked
and, if it is sound, its turns are given. A closed session is remembered for a
while, so that lines sent again much later don't open it anew.

A finite table is the same stream, read in one run and closed at its end: a last
record far in the future lifts the watermark over every session. All lines are
buffered before the watermark moves, so none can be too late, however the table
is ordered.

A line takes 33 bytes of state, and lines arrive in batches, so a session that
holds a great part of all lines needs no more than that for each of them.

Defined results: null and blank lines are ignored; lines without a session belong
to none and are left out before anything is exchanged, but for the mark of the
end (no line_id either, and a time from ``END`` on); lines that repeat a line_id are one; lines without a uuid are their own;
a message that is no object counts as none; a null block type counts as absent;
lines without an arrival time are kept, those without a line_id are left out; a session of one turn of each role is
sound; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sagekeep.runtime import shared_dir

WATERMARK, CLOSED_AFTER, REMEMBERED = timedelta(days=2), timedelta(hours=12), timedelta(days=30)
#: Milliseconds at which a finite stream is closed.
END = 7_258_118_400_000
SKIPPED, BROKEN, USER, ASSISTANT = 0, 1, 2, 3
ROLES = {"user": USER, "assistant": ASSISTANT}
#: What the state keeps of a line: line_id, moment, code, and a digest of what identifies it.
LINE = "<qqb16s"
#: What goes before it on the way to the state: the millisecond of its arrival. In a column of its own it would be converted for each session.
ARRIVAL = "<q"
PARSED = "session_id string, line binary, received_at timestamp"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def message_text(content: object) -> str:
    """The text of a content: a string, or the strings and text blocks of a list."""
    if isinstance(content, str):
        return content
    parts = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, str):
            parts.append(block)
        elif isinstance(block, dict) and block.get("type") in (None, "text") and isinstance(block.get("text"), str):
            parts.append(block["text"])
    return "\n".join(parts)


def moment_of(value: object) -> int | None:
    """Microseconds since 1970 of an ISO timestamp, in UTC where it names no zone."""
    try:
        moment = datetime.fromisoformat(value.strip())
    except (ValueError, AttributeError, TypeError):
        return None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=UTC)
    return (moment - EPOCH) // timedelta(microseconds=1)


def parse_line(raw: str) -> tuple[int, int, object]:
    """Code, moment and uuid of a line that isn't blank."""
    try:
        line = json.loads(raw)
    except (ValueError, RecursionError):
        return BROKEN, 0, None
    if not isinstance(line, dict):
        return BROKEN, 0, None
    message = line.get("message")
    inner = message if isinstance(message, dict) else None
    role = inner.get("role") if inner is not None else line.get("type")
    code = ROLES.get(role.strip().lower(), SKIPPED) if isinstance(role, str) else SKIPPED
    moment = 0
    if code != SKIPPED:
        content = inner.get("content") if inner is not None else None
        if not message_text(line.get("content") if content is None else content).strip():
            code = SKIPPED
        elif (at := moment_of(line.get("timestamp"))) is None:
            code = BROKEN
        else:
            moment = at
    return code, moment, line.get("uuid")


def parsed(lines: DataFrame) -> DataFrame:
    """The numbers of each line of a session that isn't blank; the mark of the end only carries its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sessions, ids, raws = (batch.column(i).to_pylist() for i in range(3))
            arrivals = batch.column(3).cast(pa.int64()).to_pylist()  # microseconds since 1970
            keep, packed = [], []
            for row, (session, line_id, raw, arrival) in enumerate(zip(sessions, ids, raws, arrivals, strict=True)):
                line = b""
                if session is not None:
                    if raw is None or line_id is None or not raw.strip():
                        continue
                    code, moment, uuid = parse_line(raw)
                    name = f"line {line_id}" if uuid is None or uuid == "" else f"uuid {json.dumps(uuid, sort_keys=True)}"
                    digest = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    line = struct.pack(ARRIVAL, (arrival or 0) // 1000) + struct.pack(LINE, line_id, moment, code, digest)
                keep.append(row)
                packed.append(line)
            at = pa.array(keep, pa.int64())
            columns = [batch.column(0).take(at), pa.array(packed, pa.binary()), batch.column(3).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["session_id", "line", "received_at"])

    picked = lines.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("line_id").cast("long").alias("line_id"),
        F.col("raw_line").cast("string").alias("raw_line"),
        F.col("received_at").cast("timestamp").alias("received_at"),
    )
    marks_end = F.col("line_id").isNull() & (F.unix_millis("received_at") >= END)
    return picked.filter(F.col("session_id").isNotNull() | marks_end).mapInArrow(run, PARSED)


def sound_turns(blob: bytes) -> tuple[list[int], list[int]] | None:
    """turn_no and line_id of each usable line of a sound session, else None."""
    seen, usable = set(), []
    for line_id, moment, code, digest in sorted(struct.iter_unpack(LINE, blob)):
        if digest in seen or line_id in seen:
            continue
        seen |= {digest, line_id}
        if code == BROKEN:
            return None
        if code != SKIPPED:
            usable.append((moment, line_id, code))
    usable.sort()
    if not usable or usable[0][2] != USER or usable[-1][2] != ASSISTANT:
        return None
    turns, turn, role = [], 0, None
    for _, _, code in usable:
        turn += code != role
        role = code
        turns.append(turn)
    return turns, [line_id for _, line_id, _ in usable]


def keep_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffer the lines of one session; give its turns once it is closed."""
    watermark = state.getCurrentWatermarkMs()
    if state.hasTimedOut:
        blob, latest, closed = state.get
        if closed or watermark >= END:
            state.remove()
        else:
            state.update((b"", latest, True))
            state.setTimeoutTimestamp(watermark + int(REMEMBERED.total_seconds() * 1000))
        turns = None if closed else sound_turns(bytes(blob))
        if turns is not None:
            yield pd.DataFrame({"session_id": key[0], "turn_no": turns[0], "line_id": turns[1]})
        return
    blob, latest, closed = state.get if state.exists else (b"", 0, False)
    parts = [bytes(blob)]
    for pdf in batches:
        if key[0] is None or closed:
            continue
        lines, start = pdf["line"].tolist(), struct.calcsize(ARRIVAL)
        parts.extend(line[start:] for line in lines)
        latest = max([latest, *(struct.unpack_from(ARRIVAL, line)[0] for line in lines)])
    if key[0] is None or closed:
        return
    state.update((b"".join(parts), latest, False))
    state.setTimeoutTimestamp(max(latest + int(CLOSED_AFTER.total_seconds() * 1000), watermark + 1))


def conversation_stream(lines: DataFrame, watermark: timedelta = WATERMARK) -> DataFrame:
    """session_id, turn_no, line_id of the sound sessions of a streaming frame of lines, as they are closed."""
    return (
        parsed(lines)
        .withWatermark("received_at", f"{int(watermark.total_seconds())} seconds")
        .groupBy("session_id")
        .applyInPandasWithState(
            keep_session,
            "session_id string, turn_no long, line_id long",
            "lines binary, latest long, closed boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def _stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the table may be a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """The turns of the sound sessions of a finite table of lines at ``path``."""
    lines = _stream_of(spark, path).select("session_id", "line_id", "raw_line", "received_at")
    closing = shared_dir(spark, "stream-end")
    end = spark.range(1).select(
        *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("session_id", "line_id", "raw_line")],
        F.timestamp_millis(F.lit(END + int(2 * WATERMARK.total_seconds() * 1000))).cast(lines.schema["received_at"].dataType).alias("received_at"),
    )
    end.write.parquet(closing)
    both = lines.unionByName(spark.readStream.schema(end.schema).parquet(closing))
    turns, target = conversation_stream(both), shared_dir(spark, "conversations")
    query = (
        turns.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", shared_dir(spark, "conversations-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(turns.schema).parquet(target)
