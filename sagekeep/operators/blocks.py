"""Similar pairs of two sets of vectors, block by block.

Rows are packed to matrices, which are written once. Every pair of matrices then
meets without an exchange: a task holds a few matrices of one table, and those of
the other flow past it, read from the shared folder. So the disk holds each vector
once, however many rows there are, and a task gives at most ``k`` matches for each
of its rows, however many vectors are equal.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagekeep.runtime import shared_dir

#: Rows of a matrix at most, and those of a small table, of which there should be enough for all cores.
ROWS_OF_A_PACK, LEAST_ROWS = 4_096, 512
#: Rows and columns of one product; a tile of this size stays in a core's cache.
SLICE, COLUMNS = 512, 1_024


def write_packs(rows: DataFrame, count: int, purpose: str = "packs", most: int = ROWS_OF_A_PACK) -> DataFrame:
    """A table of matrices of about ``count`` rows of id, vector (an array, or bytes) and further numbers, the first of which is an order.

    pack, ids, vectors (bytes), lists of the numbers, and low and high, the least
    and greatest order. Rows are packed as they lie in their partitions; nothing
    is exchanged.
    """
    spark = rows.sparkSession
    numbers = rows.columns[2:]
    size = max(1, min(most, max(LEAST_ROWS, math.ceil(count / (8 * spark.sparkContext.defaultParallelism)))))

    def packed(table: pa.Table) -> pa.RecordBatch:
        vectors = table.column("vector").combine_chunks()
        if pa.types.is_binary(vectors.type):
            data = b"".join(vectors.to_pylist())
        else:
            data = vectors.flatten().to_numpy(zero_copy_only=False).tobytes()
        lists = [table.column(name).to_pylist() for name in numbers]
        row = [uuid.uuid4().hex, table.column("id").to_pylist(), data, *lists, min(lists[0]), max(lists[0])]
        kinds = [pa.string(), pa.list_(pa.string()), pa.binary(), *(pa.list_(pa.int64()) for _ in numbers), pa.int64(), pa.int64()]
        columns = [pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["pack", "ids", "vectors", *numbers, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                table = pa.Table.from_batches(held)
                for at in range(0, n - n % size, size):
                    yield packed(table.slice(at, size))
                n %= size
                held = table.slice(table.num_rows - n).to_batches()
        if n:
            yield packed(pa.Table.from_batches(held))

    schema = f"pack string, ids array<string>, vectors binary, {', '.join(f'{name} array<long>' for name in numbers)}, low long, high long"
    path = shared_dir(spark, purpose)
    # Small files are what a scan can deal to its tasks; of a large table there would be too many.
    files = max(1, min(8, count // size // 500))
    rows.mapInArrow(run, schema).write.option("maxRecordsPerFile", files).parquet(path)
    return spark.read.schema(schema).parquet(path)


def meet(held: DataFrame, passing: DataFrame, run: Callable, schema: str, where: Column | None = None) -> DataFrame:
    """What ``run`` gives for all pairs of rows of two tables of matrices.

    ``run`` gets, for each task, an iterator over pairs of dictionaries: some rows
    of ``held``, each with all of a share of ``passing``. Both are tables in the
    shared folder and are read by each task that needs them. ``where`` is a
    condition on columns that are named ``held_`` and ``passing_``.
    """
    parts = max(1, held.rdd.getNumPartitions())
    shares = max(1, math.ceil(3 * held.sparkSession.sparkContext.defaultParallelism / parts))
    sides = [df.select([F.col(c).alias(f"{name}_{c}") for c in df.columns]) for name, df in (("passing", passing), ("held", held))]
    pairs = sides[0].coalesce(shares).crossJoin(sides[1].hint("shuffle_replicate_nl"))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
        for batch in batches:
            for at in range(batch.num_rows):
                both: tuple[dict, dict] = ({}, {})
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    side, _, rest = name.partition("_")
                    both[side == "passing"][rest] = column[at]
                yield both

    return (pairs if where is None else pairs.filter(where)).mapInArrow(lambda batches: run(pairs_of(batches)), schema)


class Best:
    """The k best others of each row of a matrix so far, ties by id; ``floor`` is what others must reach to count."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.floor = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, others: np.ndarray, similarities: np.ndarray) -> None:
        if len(rows):
            self.found.append((rows, others, similarities))
            self.size += len(rows)
            if self.size > 2 * self.k * len(self.ids) + 10_000:
                self.trim()

    def trim(self) -> None:
        if not self.found:
            return
        rows, others, similarities = (np.concatenate(column) for column in zip(*self.found, strict=True))
        at = np.lexsort((others, -similarities, rows))
        rows, others, similarities = rows[at], others[at], similarities[at]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(heads, np.diff(np.r_[heads, len(rows)]))
        last = rank == self.k - 1
        self.floor[rows[last]] = similarities[last]
        kept = rank < self.k
        self.found = [(rows[kept], others[kept], similarities[kept])]
        self.size = int(kept.sum())

    def table(self) -> pa.RecordBatch:
        """id, other, similarity."""
        self.trim()
        rows, others, similarities = self.found[0] if self.found else (np.zeros(0, int), np.zeros(0, str), np.zeros(0))
        columns = [pa.array(self.ids[rows].tolist(), pa.string()), pa.array(others.tolist(), pa.string()), pa.array(similarities, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "other", "similarity"])


BEST_SCHEMA = "id string, other string, similarity double"


def numbers_of(values: pa.Scalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


class Units:
    """Unit vectors of one pack, their places and groups, by id."""

    def __init__(self, pack: dict, width: str) -> None:
        ids = np.array(pack["ids"].as_py(), dtype=str)
        at = np.argsort(ids, kind="stable")
        self.ids = ids[at]
        self.places, self.groups = numbers_of(pack["places"])[at], numbers_of(pack["groups"])[at]
        raw = np.frombuffer(pack["vectors"].as_buffer(), width).reshape(len(ids), -1)[at].astype(np.float64)
        self.exact = raw / np.sqrt((raw * raw).sum(1))[:, None]
        self.near = self.exact.astype(np.float32)


def _best(near: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest finite values of each row stand, the first ones among equals."""
    if near.shape[1] <= k:
        return np.isfinite(near)
    least = np.partition(near, -k, axis=1)[:, -k, None]
    above, level = near > least, (near == least) & np.isfinite(near)
    return above | level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None])


def _add_matches(best: Best, mine: Units, theirs: Units, least: float, k: int, earlier: bool) -> None:
    """The matches of one pair of packs: products in float32 tell where float64 is needed."""
    error = (mine.near.shape[1] + 8) * 2.0**-22
    for i in range(0, len(mine.ids), SLICE):
        for j in range(0, len(theirs.ids), COLUMNS):
            rows, columns = slice(i, i + SLICE), slice(j, j + COLUMNS)
            lowest = np.maximum(least, best.floor[rows])
            mask = mine.near[rows] @ theirs.near[columns].T >= (lowest - error).astype(np.float32)[:, None]
            count = int(np.count_nonzero(mask))
            if not count:
                continue
            if count > 4 * k * len(mask):
                near = np.round(mine.exact[rows] @ theirs.exact[columns].T, 12)
                if earlier:
                    near[theirs.places[None, columns] >= mine.places[rows, None]] = -np.inf
                near[theirs.groups[None, columns] != mine.groups[rows, None]] = -np.inf
                near[theirs.ids[None, columns] == mine.ids[rows, None]] = -np.inf
                near[~(near >= lowest[:, None])] = -np.inf
                r, c = np.nonzero(_best(near, k))
                best.add(r + i, theirs.ids[c + j], near[r, c])
                continue
            r, c = np.nonzero(mask)
            r, c = r + i, c + j
            fit = (theirs.groups[c] == mine.groups[r]) & (theirs.ids[c] != mine.ids[r])
            if earlier:
                fit &= theirs.places[c] < mine.places[r]
            r, c = r[fit], c[fit]
            near = np.round((mine.exact[r] * theirs.exact[c]).sum(1), 12)
            good = near >= least
            best.add(r[good], theirs.ids[c[good]], near[good])


def best_matches(left: DataFrame, right: DataFrame, least: float, k: int, earlier: bool = False) -> DataFrame:
    """id, other, similarity: for each row of ``left`` the k most similar of ``right``, ties by id.

    Both have id, vector (usable ones only) and place; with ``earlier`` only rows
    of a smaller place count, and rows are packed by place, so that packs of which
    no row is earlier never meet. With a number ``group`` in both, only rows of one
    group are compared.
    """
    widths, sides = [], []
    for df in (left,) if right is left else (left, right):
        single = isinstance(df.schema["vector"].dataType.elementType, T.FloatType)
        group = F.col("group") if "group" in df.columns else F.lit(0)
        vector = F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")
        rows = df.select("id", vector, F.col("place").cast("long").alias("places"), group.cast("long").alias("groups"))
        count = rows.count()
        if earlier:
            rows = rows.repartitionByRange("places").sortWithinPartitions("places")
        widths.append("<f4" if single else "<f8")
        sides.append(write_packs(rows, count, "compared"))
    width, their_width = widths[0], widths[-1]

    def run(pairs: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Units, Best]] = {}
        passing, theirs = None, None
        for mine, other in pairs:
            key = mine["pack"].as_py()
            if key not in held:
                units = Units(mine, width)
                held[key] = units, Best(units.ids, k)
            if passing != other["pack"].as_py():
                passing, theirs = other["pack"].as_py(), Units(other, their_width)
            units, best = held[key]
            _add_matches(best, units, theirs, least, k, earlier)
        for _, best in held.values():
            yield best.table()

    where = F.col("passing_low") < F.col("held_high") if earlier else None
    partial = meet(sides[0], sides[-1], run, BEST_SCHEMA, where)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
