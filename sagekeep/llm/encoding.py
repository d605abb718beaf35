"""Encoding of a corpus as token ids, and token counts (problem 6).

Defined results: the empty text and the null text give an empty list (and a count
of 0); a null id stays null; repeated rows are encoded once each; an empty table
gives an empty table; the names of special tokens in a text are ordinary text;
texts of any length are encoded whole. Only the columns asked for are read and
given, so further columns of any name do no harm. Code points that are no
characters (lone surrogates) can't occur in Spark strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagekeep.llm.bpe import VOCABULARY, encoder


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of ``df``: its id and ``ids``, the token ids of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = [bpe.encode(text) if text else [] for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens"
) -> DataFrame:
    """The columns ``keep`` of each row and the number of tokens of its text."""
    inputs = [*keep, "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            counts = [bpe.count(text) if text else 0 for text in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])
    return df.select(*keep, F.col(text_col).alias("__text")).select(*inputs).mapInArrow(run, schema)
