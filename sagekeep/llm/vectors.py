"""Most similar vectors by a block matrix join (problem 3).

Vectors are packed to matrices, which are written once; a task holds some of them
and all others flow past it, read from the shared folder, so no block is sent to
every other. Both matrices of a pair are quantised to int8; the product
of the int8 matrices (exact in float32) gives each cosine up to a bound that
follows from the true quantisation errors of the two vectors. Only pairs whose
bound reaches the wanted similarity, or the best found so far, are computed again
in float64 from the given floats. A task keeps the best of each vector that it
holds; the tasks' results are merged by rank.

The result is exact: the int8 stage only spares work.

Equal vectors are collapsed first, so that copies never form pairs among
themselves: a class of equal vectors is one row of a matrix, and stands for its
``k + 1`` smallest ids as neighbours. Equality is told by 128 bits of a vector.

Defined results: vectors that are null, of another length, all zero, or that
hold nulls, NaN or infinities take no part; neither do rows without an id; rows
that repeat an id are one, with the smallest of its vectors; similarities equal
to 12 decimals are ties, in which the smaller id comes first; fewer than two
vectors give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.operators.blocks import BEST_SCHEMA, Best, meet, numbers_of, write_packs
from sagekeep.operators.skew import salted_join
from sagekeep.runtime import materialise

DIM = 64
#: Rows of a block at most, and of the matrices that a history keeps.
BLOCK_ROWS, PACK_ROWS = 4_096, 4_096
#: Rows and columns of one product; a tile of this size stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 512, 1_024
DECIMALS = 12
#: Matches a row, beyond which two matrices meet twice: what tasks give of matrices that pass them grows with the number of tasks.
DENSE = 2.0


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM, keep: list[str] | None = None) -> DataFrame:
    """id, vector (float32 bytes) and the columns ``keep`` of rows that can be compared."""
    keep = keep or []
    values = F.col(vector_col).cast("array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f4")
            good = np.isfinite(flat).all(1) & (flat != 0).any(1)
            packed = pa.Array.from_buffers(
                pa.binary(dim * 4), len(flat), [None, pa.py_buffer(np.ascontiguousarray(flat).tobytes())]
            )
            columns = [batch.column(0), packed.cast(pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", *keep]).filter(pa.array(good))

    schema = ", ".join(["id string", "vector binary", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)])
    return (
        df.select(F.col(id_col).cast("string").alias("id"), values.alias("v"), *keep)
        .filter(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
        .mapInArrow(run, schema)
    )


def unpack(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f4").reshape(-1, dim)


class Quantised:
    """A matrix of unit vectors in int8 (held as float32, in which their products are exact)."""

    def __init__(self, raw: np.ndarray, scale: float | None = None) -> None:
        self.raw = raw
        wide = raw.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(1))
        unit = wide / self.norms[:, None]
        self.scale = scale or 127.0 / np.abs(unit).max()
        steps = np.clip(np.rint(unit * self.scale), -127, 127)
        self.steps = steps.astype(np.float32)
        self.errors = np.sqrt(((unit - steps / self.scale) ** 2).sum(1))


def exact_cosines(a: Quantised, rows: np.ndarray, b: Quantised, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), 50_000):
        i, j = rows[at : at + 50_000], columns[at : at + 50_000]
        dots = (a.raw[i].astype(np.float64) * b.raw[j]).sum(1)
        out[at : at + 50_000] = np.round(dots / (a.norms[i] * b.norms[j]), DECIMALS)
    return out


def error_of(a: Quantised, b: Quantised) -> float:
    """How far a cosine may lie from what the int8 matrices give."""
    return float(a.errors.max() + (1 + a.errors.max()) * b.errors.max()) + 1e-6


def possible(a: Quantised, b: Quantised, min_similarity: float) -> int:
    """Pairs that may reach ``min_similarity``."""
    low, count = (min_similarity - error_of(a, b)) * a.scale * b.scale, 0
    for i in range(0, len(a.raw), TILE_ROWS):
        for j in range(0, len(b.raw), TILE_COLUMNS):
            count += int(np.count_nonzero(a.steps[i : i + TILE_ROWS] @ b.steps[j : j + TILE_COLUMNS].T >= low))
    return count


def tile_pairs(
    a: Quantised,
    b: Quantised,
    min_similarity: float,
    best: int | None = None,
    both_ways: bool = False,
    order: tuple[np.ndarray, np.ndarray] | None = None,
    first: bool = False,
    floors: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and cosines of the pairs that reach ``min_similarity``.

    With ``best`` pairs that can't be among so many best of their row (and, with
    ``both_ways``, of their column) may be left out, with ``floors`` those under a
    row's own. With ``order`` only columns that come before the row count; with
    ``first`` columns must be in order, and those behind a row's first sure match
    may be left out.
    """
    error, unit = error_of(a, b), a.scale * b.scale
    low, sure, slack = (min_similarity - error) * unit, (min_similarity + error) * unit, 2 * error * unit
    for i in range(0, len(a.raw), TILE_ROWS):
        for j in range(0, len(b.raw), TILE_COLUMNS):
            near = a.steps[i : i + TILE_ROWS] @ b.steps[j : j + TILE_COLUMNS].T
            if order is not None:
                near[order[1][None, j : j + TILE_COLUMNS] >= order[0][i : i + TILE_ROWS, None]] = -np.inf
            if floors is None:
                mask = near >= low
            else:
                lows = (np.maximum(min_similarity, floors[i : i + TILE_ROWS]) - error) * unit
                mask = near >= lows.astype(np.float32)[:, None]
            count = int(np.count_nonzero(mask))
            if not count:
                continue
            if best is not None and count > 4 * best * len(near):
                kept = near >= (_kth(near, best) - slack)[:, None]
                if both_ways:
                    kept |= near >= (_kth(near.T, best) - slack)[None, :]
                mask &= kept
            if first and count > 4 * len(near):
                certain = near >= sure
                stop = np.where(certain.any(1), certain.argmax(1), near.shape[1])
                mask &= np.arange(near.shape[1])[None, :] <= stop[:, None]
            rows, columns = np.nonzero(mask)
            rows, columns = rows + i, columns + j
            for at in range(0, len(rows), 1_000_000):
                r, c = rows[at : at + 1_000_000], columns[at : at + 1_000_000]
                cosines = exact_cosines(a, r, b, c)
                good = cosines >= min_similarity
                yield r[good], c[good], cosines[good]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k]


def pack(df: DataFrame, blocks: int, rows: int) -> DataFrame:
    """block, ids, vectors (bytes) and orders: matrices of about PACK_ROWS rows of (id, vector, order)."""
    packs = max(1, math.ceil(rows / blocks / PACK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "block": [int(pdf["block"].iat[0])],
                "ids": [pdf["id"].tolist()],
                "vectors": [b"".join(pdf["vector"])],
                "orders": [pdf["order"].tolist()],
            }
        )

    return (
        df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .withColumn("pack", F.pmod(F.hash("id"), F.lit(packs)))
        .groupBy("block", "pack")
        .applyInPandas(run, "block int, ids array<string>, vectors binary, orders array<long>")
    )


class Block:
    """A pack as it is compared: its rows by order and id."""

    def __init__(self, row: dict, dim: int) -> None:
        self.pack = row["pack"].as_py()
        ids, orders = np.array(row["ids"].as_py(), dtype=str), numbers_of(row["orders"])
        at = np.lexsort((ids, orders))
        self.ids, self.orders = ids[at], orders[at]
        self.matrix = Quantised(unpack([row["vectors"].as_py()], dim)[at])


def matches_per_row(packs: DataFrame, min_similarity: float, dim: int = DIM) -> float:
    """About how many others a row has that may reach ``min_similarity``, told by one matrix, whose rows are any."""
    one = packs.filter(F.col("pack") == F.lit(packs.agg(F.min("pack")).first()[0])).coalesce(1)

    def run(pairs: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        a: Block | None = None
        count = 0
        for mine, other in pairs:
            a = a or Block(mine, dim)
            count += possible(a.matrix, Block(other, dim).matrix, min_similarity)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([len(a.ids)])], names=["n", "of"])

    return meet(one, packs, run, "n long, of long").agg(F.sum("n") / F.max("of") - 1).first()[0] or 0.0


def nearest(packs: DataFrame, k: int, min_similarity: float = -1.0, dim: int = DIM) -> DataFrame:
    """id, other, similarity: the k best others of each row of the matrices ``packs``, ids and vectors distinct.

    Where matches are few a pair of matrices is multiplied once, for the rows of
    both; a task then gives matches of the matrices that pass, too. Where that
    could be too many, they meet twice, and a task gives those of its own rows.
    """
    once = matches_per_row(packs, min_similarity, dim) <= DENSE

    def run(pairs: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Block, Best]] = {}
        passing: Block | None = None
        theirs = Best(np.zeros(0, str), k)
        for mine, other in pairs:
            if (key := mine["pack"].as_py()) not in held:
                block = Block(mine, dim)
                held[key] = block, Best(block.ids, k)
            block, best = held[key]
            if passing is None or passing.pack != other["pack"].as_py():
                if theirs.found:
                    yield theirs.table()
                passing = Block(other, dim)
                theirs = Best(passing.ids, k)
            same = passing.pack == block.pack
            floors = None if once else best.floor
            for r, c, s in tile_pairs(block.matrix, passing.matrix, min_similarity, k + same, both_ways=once and not same, floors=floors):
                others = r != c if same else slice(None)
                best.add(r[others], passing.ids[c[others]], s[others])
                if once and not same:
                    theirs.add(c, block.ids[r], s)
        for found in (theirs, *(best for _, best in held.values())):
            yield found.table()

    a, b = F.col("held_pack"), F.col("passing_pack")
    # Of the two ways in which two matrices meet one is left out, for half of all in either order, so that all tasks have as many.
    turn = F.hash(a).bitwiseXOR(F.hash(b)).bitwiseAND(F.lit(1)) == 1
    partial = meet(packs, packs, run, BEST_SCHEMA, (a == b) | ((a < b) == turn) if once else None)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


SIGN = ["h1", "h2"]


def one_vector(signed: DataFrame) -> DataFrame:
    """id and the sign of its smallest vector, of (id, vector, h1, h2).

    Only of ids that have several vectors are the vectors themselves exchanged.
    """
    ends = [F.min(h).alias(h) for h in SIGN] + [F.max(h).alias(f"{h}_most") for h in SIGN]
    rows = materialise(signed.groupBy("id").agg(*ends), "vector-signs")
    single = (F.col("h1") == F.col("h1_most")) & (F.col("h2") == F.col("h2_most"))
    several = rows.filter(~single).select("id")
    if several.isEmpty():
        return rows.select("id", *SIGN)
    smallest = signed.join(several, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    return rows.filter(single).select("id", *SIGN).unionByName(_signed(smallest).select("id", *SIGN))


def _signed(rows: DataFrame) -> DataFrame:
    """The rows with 128 bits of their vector."""
    return rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})


def similar_neighbours(
    df: DataFrame, id_col: str, vector_col: str, k: int = 5, min_similarity: float = -1.0, dim: int = DIM
) -> DataFrame:
    """id, other, similarity: for each vector the k most similar others that reach ``min_similarity``.

    The vectors are exchanged once and written once, as matrices; all else is done with their signs.
    """
    signed = _signed(usable_vectors(df, id_col, vector_col, dim))
    rows = one_vector(signed)
    place = F.row_number().over(W.partitionBy(*SIGN).orderBy("id"))
    heads = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = materialise(
        heads.groupBy(*SIGN).agg(F.sort_array(F.collect_list("id")).alias("heads")).withColumn("id", F.col("heads")[0]),
        "vector-classes",
    )
    distinct = signed.groupBy(*SIGN).agg(F.first("vector").alias("vector")).join(classes.select("id", *SIGN), SIGN)
    columns = ["id", "vector", F.lit(0).cast("long").alias("orders")]
    packs = write_packs(distinct.select(columns), classes.count(), "vector-packs", BLOCK_ROWS)
    near = nearest(packs, k, min_similarity, dim)
    members = classes.select("id", "heads")
    others = near.join(members.select(F.col("id").alias("other"), F.col("heads").alias("items")), "other").select(
        "id", F.explode("items").alias("item"), "similarity"
    )
    own = members.filter(F.size("heads") > 1).select("id", F.explode("heads").alias("item"), F.lit(1.0).alias("similarity"))
    order = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "item"))
    offers = (
        others.unionByName(own.filter(F.lit(min_similarity <= 1.0)))
        .withColumn("at", order)
        .filter(F.col("at") <= k + 1)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "item", "similarity"))).alias("offers"))
    )
    sign = F.struct(*SIGN).alias("sign")
    lists = offers.join(classes.select("id", sign), "id").select("sign", "offers")
    return (
        salted_join(rows.select("id", sign), lists, "sign", "id")
        .select("id", F.slice(F.filter("offers", lambda o: o["item"] != F.col("id")), 1, k).alias("offers"))
        .select("id", F.explode("offers").alias("o"))
        .select("id", F.col("o.item").alias("other"), F.col("o.similarity").alias("similarity"))
    )


def unordered_pairs(neighbours: DataFrame) -> DataFrame:
    """Each pair once, whichever of the two is the other's neighbour: id_a < id_b."""
    return neighbours.select(
        F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")
    ).dropDuplicates()


def best_of_block(a: Block, b: Block, min_similarity: float, earlier: bool, first: bool) -> Iterator[tuple]:
    """id, other, similarity, other_order: for each row of ``a`` its best of ``b``, or with ``first`` its first one in order."""
    found: dict[int, tuple] = {}
    by_id = np.argsort(np.argsort(b.ids, kind="stable"))
    order = (a.orders, b.orders) if earlier else None
    for r, c, s in tile_pairs(a.matrix, b.matrix, min_similarity, None if first else 1, order=order, first=first):
        key = c if first else by_id[c]
        for i, j, x, at in zip(r.tolist(), c.tolist(), s.tolist(), key.tolist(), strict=True):
            entry = (0.0 if first else -x, at, j, x)
            if i not in found or entry < found[i]:
                found[i] = entry
    return ((a.ids[i], b.ids[j], x, int(b.orders[j])) for i, (_, _, j, x) in found.items())


def match(
    left: DataFrame,
    right: DataFrame,
    min_similarity: float,
    earlier: bool = False,
    first: bool = False,
    dim: int = DIM,
    packed: bool = False,
) -> DataFrame:
    """id, other, similarity, other_order: the best row of ``right`` for each of ``left``.

    Both sides hold id, vector and order, and are read several times, so they
    should be tables; with ``packed`` the right one holds matrices instead, as
    ``pack`` gives them, named by ``pack``. Only matches of ``min_similarity`` count; with ``earlier``
    only rows of ``right`` of a smaller order; with ``first`` the one of smallest
    order is given instead of the most similar. Each pair of blocks gives one match a row.
    """
    spark = left.sparkSession
    schema = "id string, other string, similarity double, other_order long"
    names = ["id", "other", "similarity", "other_order"]
    sizes = [left.count(), int(not right.isEmpty()) if packed else right.count()]
    if not all(sizes):
        return spark.createDataFrame([], schema)
    column = ["id", "vector", F.col("order").alias("orders")]
    held = write_packs(left.select(column), sizes[0], "asked-packs", BLOCK_ROWS)
    passing = right if packed else write_packs(right.select(column), sizes[1], "matched-packs", BLOCK_ROWS)

    def run(pairs: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        block: Block | None = None
        for mine, other in pairs:
            if (key := mine["pack"].as_py()) not in blocks:
                blocks[key] = Block(mine, dim)
            if block is None or block.pack != other["pack"].as_py():
                block = Block(other, dim)
            rows = list(best_of_block(blocks[key], block, min_similarity, earlier, first))
            if rows:
                kinds = [pa.string(), pa.string(), pa.float64(), pa.int64()]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    where = F.col("passing_low") < F.col("held_high") if earlier and not packed else None
    partial = meet(held, passing, run, schema, where)
    key = F.struct("other_order", "other") if first else F.struct(-F.col("similarity"), F.col("other"))
    best = F.min_by(F.struct("other", "similarity", "other_order"), key)
    return partial.groupBy("id").agg(best.alias("m")).select("id", "m.other", "m.similarity", "m.other_order")
