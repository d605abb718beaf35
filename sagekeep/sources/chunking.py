"""Cutting texts to overlapping chunks: by characters, and by whole blocks.

Where a chunk ends depends on where the one before it ended, so each text is
scanned once, in Arrow batches; texts are spread over tasks as Spark reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places to end a chunk at, the most wanted first.
BREAKS = ("\n\n", "\n", " ")
BLANKS = "\n "
GAP = 2


def char_spans(text: str, size: int, overlap: int, least_step: int = 1) -> Iterator[tuple[int, int]]:
    """Start and length of the chunks of a text.

    A chunk ends at the last paragraph, line or word break within ``size``
    characters, whichever kind is found first. The next one starts ``overlap``
    before that end, but at least ``least_step`` further on; with a step of 1 a
    break near the start of a window makes the chunks crawl. With a larger step a
    chunk that ends sooner is followed at its end, so that no text is left out;
    a break counts only behind the blanks that a window starts with, so that each
    chunk moves on.
    """
    start = 0
    while start < len(text) or start == 0:
        limit = start + size
        if limit >= len(text):
            yield start, len(text) - start
            return
        said = start
        while least_step > 1 and said < limit and text[said] in BLANKS:
            said += 1
        found = (text.rfind(mark, said, limit) for mark in BREAKS)
        end = next((at for at in found if at >= 0), limit)
        yield start, end - start
        start = max(start + 1, min(end, max(start + least_step, end - overlap)))


def char_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 20_000, overlap: int = 500, least_step: int = 1) -> DataFrame:
    """id, sequence_no, start_char, length_chars, text of each chunk; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, starts, lengths, texts = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for place, (start, length) in enumerate(char_spans(text, size, overlap, least_step), 1):
                    rows.append(row)
                    places.append(place)
                    starts.append(start)
                    lengths.append(length)
                    texts.append(text[start : start + length])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32())]
            columns += [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sequence_no", "start_char", "length_chars", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    return picked.mapInArrow(run, f"id {kind}, sequence_no int, start_char long, length_chars long, text string")


def block_chunks(blocks: DataFrame, key: str, order: str, block: str, stamp: str, size: int = 20_000, overlap: int = 500) -> DataFrame:
    """key, sequence_no, first_block, last_block, text, earliest: chunks of whole blocks.

    Blocks are packed while they fit into ``size`` with gaps between them. A full
    chunk hands on as many whole blocks from its end as reach ``overlap``. A block
    larger than ``size`` stands alone where nothing was handed on, else it is
    packed behind that. The blocks of a key come sorted and are read as a run, so
    that no more than one chunk of a key is held, however long it is.
    """
    schema = blocks.schema
    sorted_blocks = blocks.select(key, order, block, stamp).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, carried, place, offset = None, [], 0, 0, 0
        out: list[tuple] = []

        def close(last: int) -> None:
            nonlocal place
            place += 1
            part = held[:last]
            stamps = [s for _, s in part if s is not None]
            text = ("\n" * GAP).join(t for t, _ in part)
            out.append((current, place, offset + 1, offset + last, text, min(stamps) if stamps else None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            out.clear()
            names = [key, "sequence_no", "first_block", "last_block", "text", "earliest"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def add(text: str, at: object) -> None:
            nonlocal carried, offset
            width = lambda parts: sum(len(t) for t, _ in parts) + GAP * max(0, len(parts) - 1)
            if held and carried + GAP + len(text) > size:
                close(len(held))
                keep, kept = len(held), 0
                while overlap > 0 and keep > 0 and kept < overlap:
                    keep -= 1
                    kept = width(held[keep:])
                offset += keep
                del held[:keep]
                carried = width(held)
            held.append((text, at))
            if len(held) == 1 and len(text) > size:
                close(1)
                held.clear()
                offset, carried = offset + 1, 0
            else:
                carried = width(held) if len(held) < 2 else carried + GAP + len(text)

        for batch in batches:
            keys, texts, stamps = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for k, text, at in zip(keys, texts, stamps, strict=True):
                if k != current:
                    if held:
                        close(len(held))
                    current, carried, place, offset = k, 0, 0, 0
                    held.clear()
                add(text, at)
            yield flush()
        if held:
            close(len(held))
        yield flush()

    kind = schema[key].dataType.simpleString()
    names = f"{key} {kind}, sequence_no int, first_block long, last_block long, text string, earliest timestamp"
    return sorted_blocks.mapInArrow(run, names)
