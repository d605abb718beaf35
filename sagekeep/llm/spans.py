"""Long exact spans shared between records (problem 8).

Tokens are the substrings of ``GRAM`` characters at every position of a text,
each with a hash. The compact windows of a text are the nodes of the Cartesian
tree over these hashes: a node stands for all stretches whose least hash is its
own. Only stretches of the wanted length (``least`` characters) matter here, so
only nodes at least that wide are kept; each start of a stretch belongs to
exactly one of them. They are found for whole slabs of text at once as the runs
of equal sliding minima, which is the same as walking the tree.

Two equal stretches have equal least hashes, so one hash function finds every
verbatim repetition (more would be needed for passages that only resemble each
other). Windows of several records with one signature are kept. Where the whole
surroundings of a window stand in another record too, all its stretches are
shared. For the rest, at the borders of shared passages, the stretches are
compared one by one: their hashes meet in a second exchange that only carries
least and greatest record. No pairs are formed, however many records share a
passage. The windows, and the stretches, of a passage that a great part of the
records hold are dealt to many tasks; each gives its least and greatest record,
and these are combined for the few passages of that kind.

Equality is decided by 128 bits: the least hash of the tokens in a stretch and a
hash of the whole of it, which are independent (for whole windows the least hash
and a hash over their first and last stretch).

Defined results: null, empty and shorter texts share nothing; rows of one id are
one record, they don't make each other's text shared; records without an id are
left out; texts of any length are read whole, in overlapping pieces; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.llm.hashing import MIX_A, MIX_B, SHIFT, gram_hashes, sliding_least
from sagekeep.operators.skew import salted_join
from sagekeep.runtime import hot_values, materialise

LEAST = 120
GRAM = 48
#: Characters that are worked on at once.
SLAB = 400_000
#: Share of the windows from which on a signature is dealt to several tasks, and their number.
SUPPORT, SALTS = 0.001, 64


def compact_windows(text: str, lengths: np.ndarray, least: int, gram: int, covers: bool = True) -> tuple[np.ndarray, ...]:
    """Compact windows of the pieces whose concatenation is ``text``.

    Gives start, number of stretches, signature and (0 without ``covers``) a hash
    of all characters that the stretches cover. Starts count in ``text``; no stretch leaves its piece.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = least - gram + 1
    signature = sliding_least(gram_hashes(codes, gram), width)
    whole = gram_hashes(codes, least) if covers else None
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    inside = left[: len(signature)] >= least
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (signature[1:] != signature[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if len(starts) and (ends - starts).max() >= width:  # a repetition inside the text: cut it to windows of usual width
        cuts = [np.arange(a, b + 1, width) for a, b in zip(starts, ends, strict=True)]
        lasts = [np.minimum(c + width - 1, b) for c, b in zip(cuts, ends, strict=True)]
        starts, ends = np.concatenate(cuts), np.concatenate(lasts)
    if not covers:
        return starts, ends - starts + 1, signature[starts].view(np.int64), np.zeros(len(starts), np.int64)
    cover = (whole[starts] * MIX_A + whole[ends]) * MIX_B + (ends - starts).astype(np.uint64)
    cover ^= cover >> SHIFT
    return starts, ends - starts + 1, signature[starts].view(np.int64), cover.view(np.int64)


def _pieces(texts: list[str | None], least: int) -> Iterator[list[tuple[int, int, str]]]:
    """Slabs of (row, offset, piece); long texts are cut so that each start of a stretch lies in one piece."""
    slab, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text or "") - least + 1), SLAB):
            piece = text[at : at + SLAB + least - 1]
            slab.append((row, at, piece))
            size += len(piece)
            if size >= SLAB:
                yield slab
                slab, size = [], 0
    if slab:
        yield slab


def window_table(df: DataFrame, least: int = LEAST, gram: int = GRAM, covers: bool = True) -> DataFrame:
    """doc, start, n, signature, cover (0 without ``covers``) for each compact window of the texts in (doc, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for slab in _pieces(texts, least):
                lengths = np.array([len(piece) for _, _, piece in slab])
                ends = np.cumsum(lengths)
                starts, n, signature, cover = compact_windows("".join(p for _, _, p in slab), lengths, least, gram, covers)
                piece = np.searchsorted(ends, starts, side="right")
                shift = np.array([at for _, at, _ in slab]) - (ends - lengths)
                rows = np.array([row for row, _, _ in slab])
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(pa.array(rows[piece])),
                        pa.array(starts + shift[piece], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(signature),
                        pa.array(cover),
                    ],
                    names=["doc", "start", "n", "signature", "cover"],
                )

    kind = df.schema["doc"].dataType.simpleString()
    return df.mapInArrow(run, f"doc {kind}, start long, n long, signature long, cover long")


def _stretches(df: DataFrame, least: int) -> DataFrame:
    """The hash of each stretch of the windows in (doc, body, windows), with the records known to hold it."""
    kind = df.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, windows = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            picked, pieces = [], []
            for row, (text, found) in enumerate(zip(texts, windows, strict=True)):
                for w in found:
                    piece = text[w["start"] : w["start"] + w["n"] - 1 + least]
                    if len(piece) >= least:
                        picked.append((row, w))
                        pieces.append(piece)
            for at in range(0, len(picked), 2_000):
                part = picked[at : at + 2_000]
                lengths = np.array([len(p) for p in pieces[at : at + 2_000]])
                codes = np.frombuffer("".join(pieces[at : at + 2_000]).encode("utf-32-le", "surrogatepass"), np.uint32)
                counts = lengths - least + 1
                which = np.repeat(np.arange(len(part)), counts)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                base = np.cumsum(lengths) - lengths
                hashes = gram_hashes(codes, least)[base[which] + inner]
                first = np.array([w["start"] for _, w in part])
                least_doc = pa.array([w["least_doc"] for _, w in part], docs.type)
                most_doc = pa.array([w["most_doc"] for _, w in part], docs.type)
                unsure = pa.array([w["open"] for _, w in part], pa.bool_())
                signature = pa.array([w["signature"] for _, w in part], pa.int64())
                of = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        signature.take(of),
                        docs.take(pa.array(np.array([row for row, _ in part])[which])),
                        pa.array(first[which] + inner, pa.int64()),
                        least_doc.take(of),
                        most_doc.take(of),
                        unsure.take(of),
                    ],
                    names=["stretch", "signature", "doc", "start", "least_doc", "most_doc", "open"],
                )

    return df.mapInArrow(
        run, f"stretch long, signature long, doc {kind}, start long, least_doc {kind}, most_doc {kind}, open boolean"
    )


def join_touching(intervals: DataFrame) -> DataFrame:
    """Unite the overlapping and touching intervals (doc, a, b) of each record."""
    order = W.partitionBy("doc").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        intervals.withColumn("fresh", (before.isNull() | (F.col("a") > before)).cast("int"))
        .withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc", "island")
        .agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"))
        .drop("island")
    )


def _dealt(df: DataFrame, hot: list) -> DataFrame:
    """The rows with ``hot`` and ``part``: rows of signatures that may have a great part of all are dealt by their record."""
    is_hot = F.col("signature").isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return df.withColumn("hot", is_hot).withColumn("part", part)


def _marked_windows(windows: DataFrame, hot: list) -> DataFrame:
    """The windows whose signature several records have, with the least and greatest record of their cover.

    ``open`` are those that only one record has as they are, ``sample`` one of each cover that such ones are to be
    compared with.
    """
    dealt = _dealt(windows, hot)
    same_signature, same_cover = W.partitionBy("signature", "part"), W.partitionBy("signature", "part", "cover")
    marked = (
        dealt.repartition("signature", "part")
        .withColumn("least_doc", F.min("doc").over(same_cover))
        .withColumn("most_doc", F.max("doc").over(same_cover))
        .withColumn("first", F.row_number().over(same_cover.orderBy("doc", "start")) == 1)
        .withColumn("open", F.col("least_doc") == F.col("most_doc"))
        .withColumn("any_open", F.max("open").over(same_signature))
        .withColumn("least_of_all", F.min("doc").over(same_signature))
        .withColumn("most_of_all", F.max("doc").over(same_signature))
        .filter("hot OR least_of_all <> most_of_all")
        .withColumn("sample", F.col("first") & F.col("any_open"))
        .withColumn("cover", F.when(F.col("hot"), F.col("cover")))
        .select("doc", "start", "n", "signature", "cover", "hot", "least_doc", "most_doc", "open", "sample")
    )
    marked = materialise(marked, "span-windows")
    columns = ["doc", "start", "n", "signature", "least_doc", "most_doc", "open", "sample"]
    if not hot:
        return marked.select(columns)
    of_hot = marked.filter("hot")
    covers = of_hot.groupBy("signature", "cover").agg(
        F.min("least_doc").alias("least_doc"), F.max("most_doc").alias("most_doc"), F.min(F.struct("doc", "start")).alias("head")
    )
    covers = covers.withColumn("open", F.col("least_doc") == F.col("most_doc"))
    whole = covers.groupBy("signature").agg(
        F.min("least_doc").alias("least_of_all"), F.max("most_doc").alias("most_of_all"), F.max("open").alias("any_open")
    )
    covers = covers.join(whole.filter("least_of_all <> most_of_all"), "signature")
    covers = covers.select(F.struct("signature", "cover").alias("group"), "least_doc", "most_doc", "head", "open", "any_open")
    rows = of_hot.select("doc", "start", "n", "signature", F.struct("signature", "cover").alias("group"))
    rows = salted_join(rows, covers, "group", "doc").withColumn("sample", F.col("any_open") & (F.col("head") == F.struct("doc", "start")))
    return marked.filter("NOT hot").select(columns).unionByName(materialise(rows.select(columns), "hot-windows"))


def _shared_stretches(stretches: DataFrame, hot: list) -> DataFrame:
    """doc, start of the open stretches that another record holds too; equal stretches have one signature."""
    dealt = _dealt(stretches, hot)
    same = W.partitionBy("stretch", "signature", "part")
    compared = (
        dealt.repartition("stretch", "signature", "part")
        .withColumn("least_of_all", F.min("least_doc").over(same))
        .withColumn("most_of_all", F.max("most_doc").over(same))
        .filter("hot OR open AND least_of_all <> most_of_all")
    )
    if not hot:
        return compared.select("doc", "start")
    later = [F.when(F.col("hot"), F.col(c)).alias(c) for c in ("stretch", "signature", "open", "least_of_all", "most_of_all")]
    compared = materialise(compared.select("doc", "start", "hot", *later), "stretches")
    of_hot = compared.filter("hot")
    whole = of_hot.groupBy("stretch", "signature").agg(F.min("least_of_all").alias("least"), F.max("most_of_all").alias("most"))
    group = F.struct("stretch", "signature").alias("group")
    several = whole.filter("least <> most").select(group)
    found = salted_join(of_hot.filter("open").select("doc", "start", group), several, "group", "doc")
    return compared.filter("NOT hot").select("doc", "start").unionByName(found.select("doc", "start"))


def shared_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM
) -> DataFrame:
    """The longest unbroken stretches of shared characters of each record: id, span_start, span_end.

    A character is shared if it lies in a substring of at least ``least``
    characters that stands in the text of another id as well.
    """
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).filter(
        F.col("doc").isNotNull() & (F.length("body") >= least)
    )
    hot = hot_values(window_table(texts, least, gram, covers=False).select("signature"), "signature", SUPPORT)
    marked = _marked_windows(window_table(texts, least, gram), hot)
    end = F.col("start") + F.col("n") - 1 + least
    closed = marked.filter("NOT open").select("doc", F.col("start").alias("a"), end.alias("b"))
    to_compare = (
        marked.filter("open OR sample")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "n", "signature", "least_doc", "most_doc", "open")).alias("windows"))
    )
    compared = _shared_stretches(_stretches(texts.join(to_compare, "doc"), least), hot)
    compared = compared.select("doc", F.col("start").alias("a"), (F.col("start") + least).alias("b"))
    return join_touching(closed.unionByName(compared)).withColumnRenamed("doc", id_col)


def shared_part(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each record its length, the number of shared characters and their part of the text (0 for an empty one)."""
    shared = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = df.groupBy(id_col).agg(F.coalesce(F.max(F.length(text_col)), F.lit(0)).cast("long").alias("n_chars"))
    return (
        sizes.join(shared, id_col, "left")
        .fillna(0, ["shared_chars"])
        .withColumn("shared_part", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
    )
