"""Checking new batches against all that was accepted before (problem 4).

Texts are cut into chunks where a rolling hash of the last bytes says so, so that
equal passages give equal chunks wherever they stand. A persistent table leads
from chunks to records. A new record is looked up by its rarest chunks; the bytes
that it shares with each record found that way are summed over all chunks, and
the decision is made by coverage: the part of the new record, and of the old one,
that is shared. Chunks also have the places at which they stand, so it is told how
many bytes stand at the same places: a coverage of 1 of both, all of it in place,
means the same content. Nothing else decides that. What is accepted is appended.

The history is written once, by its appends. Chunks are partitioned by hash, and
a batch reads the partitions that its own hashes fall into, once;
vectors lie packed in matrices, which a batch's product with them reads as they
are. Texts of the history are never read again, and nothing of it is rewritten.

What has no equal text is compared by vectors with a block matrix join (coverage
of bytes says nothing about the cosine that problem 4 asks for). New records are
decided in their order: one that comes after an accepted duplicate of it is a
duplicate. This takes rounds; in each the records without an earlier undecided
neighbour are accepted. A round gives at most one neighbour for each record, so
groups of copies never form pairs.

Defined results: rows that repeat an id are one record (the smallest place,
then content, then vector); rows without an id are left out; a null content
equals nothing, blank contents equal each other; vectors that are null, all zero
or of another length match nothing; records without a batch or place come last;
records of one place are taken in the order of their ids; of several equal or
equally similar accepted records the smallest id is given; no history, or no new
records, is no error; texts of any length are read whole; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.llm.hashing import gram_hashes
from sagekeep.llm.vectors import DIM, PACK_ROWS, match, pack, usable_vectors
from sagekeep.operators.skew import salted_join
from sagekeep.runtime import WHITESPACE, materialise, shared_dir, strip

#: Bytes that the rolling hash sees, and the mean length of a chunk.
SEEN, MEAN = 12, 24
SIMILAR = 0.92
#: Partitions of the tables of a history, by hash.
PARTS = 32


CHUNK_SCHEMA = "record string, chunk long, size long, copies long, places long, total long"
PACK_SCHEMA = "block int, ids array<string>, vectors binary, orders array<long>"


def one_blank(column: Column) -> Column:
    """A text without outer white space, inner runs of it made one blank."""
    return strip(F.regexp_replace(column, f"[{WHITESPACE}]+", " "))


def chunks_of(data: bytes, ends: np.ndarray) -> dict[int, list[int]]:
    """Hash of each chunk to its length, number, and a sum that tells its places; ``ends`` are the places where chunks end."""
    found: dict[int, list[int]] = {}
    start = 0
    for end in [*ends.tolist(), len(data)]:
        if end > start or not data:
            piece = data[start:end]
            key = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
            entry = found.setdefault(key, [max(1, len(piece)), 0, 0])
            entry[1] += 1
            entry[2] = (entry[2] + mixed(start)) % 2**63
            start = end
    return found


def mixed(place: int) -> int:
    """64 bits of a number, as SplitMix64 mixes them."""
    x = (place + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def chunk_table(df: DataFrame) -> DataFrame:
    """record, chunk, size, copies, places, total for each distinct chunk of the texts in (record, body, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            rows, keys, sizes, copies, places = [], [], [], [], []
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                codes = np.frombuffer(b"".join(part), np.uint8)
                hashes = gram_hashes(codes, SEEN) if len(codes) >= SEEN else np.zeros(0, np.uint64)
                cuts = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(MEAN) == 0) + SEEN
                begin = 0
                for row, data in enumerate(part, at):
                    inside = cuts[np.searchsorted(cuts, begin + SEEN) : np.searchsorted(cuts, begin + len(data))] - begin
                    begin += len(data)
                    for key, (size, n, at_places) in chunks_of(data, inside).items():
                        rows.append(row)
                        keys.append(key)
                        sizes.append(size)
                        copies.append(n)
                        places.append(at_places)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64())]
            columns += [pa.array(values, pa.int64()) for values in (sizes, copies, places)] + [batch.column(2).take(pa.array(rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["record", "chunk", "size", "copies", "places", "total"])

    return df.mapInArrow(run, CHUNK_SCHEMA)


class ChunkHistory:
    """The persistent tables of accepted records: their chunks and vectors."""

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = PARTS) -> None:
        self.spark, self.path, self.parts = spark, path or shared_dir(spark, "chunk-history"), parts

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, table: str, by: str) -> None:
        rows = df.withColumn("part", self._part(by)).hint("rebalance", F.col("part"))
        rows.write.mode("append").partitionBy("part").parquet(f"{self.path}/{table}")

    def _touched(self, table: str, schema: str, keys: DataFrame, key: str) -> DataFrame:
        """The partitions of a table that the given keys fall into; their numbers are the only thing collected."""
        parts = [r[0] for r in keys.select(self._part(key)).distinct().collect()]
        rows = self.spark.read.schema(f"{schema}, part int").parquet(f"{self.path}/{table}")
        return rows.filter(F.col("part").isin(parts)).drop("part")

    def append(self, records: DataFrame) -> None:
        """Add accepted (id, body, vector); records of one content, or of one vector, are kept as one, of the smallest id.

        ``vector`` holds the bytes of floats that ``usable_vectors`` gives, or null.
        """
        digested = records.filter("body IS NOT NULL").withColumn("digest", F.sha2("body", 256))
        texts = digested.groupBy("digest").agg(F.min("id").alias("record"), F.first("body").alias("body"))
        texts = materialise(texts, "accepted-texts")
        size = F.greatest(F.octet_length("body"), F.lit(1)).cast("long")
        self._write(chunk_table(texts.select("record", "body", size.alias("total"))), "chunks", "chunk")
        vectors = records.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("id"))
        vectors = materialise(vectors.withColumn("order", F.lit(0).cast("long")), "accepted-vectors")
        count = vectors.count()
        packs = pack(vectors, max(1, round(count / PACK_ROWS)), count)
        packs.withColumn("pack", F.concat_ws("/", F.lit(uuid.uuid4().hex), "block")).write.mode("append").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        """The packed vectors of all accepted records: pack, ids, vectors, orders."""
        return self.spark.read.schema(f"{PACK_SCHEMA}, pack string").parquet(f"{self.path}/vectors")

    def covered(self, new: DataFrame, least: float = 1.0, least_back: float = 0.0) -> DataFrame:
        """record, accepted, coverage, back_coverage, equal (all covered, in place) for new (id, body) of distinct bodies.

        All accepted records that share at least ``least`` of the bytes of the
        new one, and ``least_back`` of their own. A record is looked up by its
        rarest chunks, as many as hold more than the bytes that may be missing,
        so no such record is overlooked. Where only records of its own size can
        reach both, rarity is counted, and looked up, among those of that size;
        so a passage that many records hold leads to few of them.
        """
        bodies = new.filter("body IS NOT NULL").select(
            F.col("id").alias("record"), "body", F.greatest(F.octet_length("body"), F.lit(1)).cast("long").alias("total")
        )
        own = materialise(chunk_table(bodies), "new-chunks")
        same_size = least >= 1 and least_back >= 1
        key = ["chunk", "total"] if same_size else ["chunk"]
        chunks = self._touched("chunks", CHUNK_SCHEMA, own, "chunk")
        hits = chunks.join(own.select(key).distinct(), key, "left_semi")
        hits = materialise(hits.withColumnsRenamed({"record": "accepted", "copies": "their_copies", "places": "their_places", "total": "their_total"}).drop("size"), "hits")
        if same_size:
            hits = hits.withColumn("total", F.col("their_total"))
        spread = hits.groupBy(key).agg(F.count(F.lit(1)).alias("spread"))
        by_rarity = W.partitionBy("record").orderBy("spread", "chunk")
        ahead = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(by_rarity.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = own.join(spread, key, "left").fillna(0, ["spread"]).withColumn("ahead", ahead)
        probes = ranked.filter(F.col("ahead") <= (1 - least) * F.col("total") + 1e-9).filter("spread > 0")
        fits = (F.col("their_total") >= least * F.col("total") - 1e-9) & (F.col("total") >= least_back * F.col("their_total") - 1e-9)
        if same_size:
            pairs = probes.select("record", *key).join(hits.select("accepted", *key), key)
        else:
            pairs = probes.select("record", "chunk", "total").join(hits.select("accepted", "chunk", "their_total"), "chunk").filter(fits)
        pairs = pairs.select("record", "accepted").distinct()
        in_place = (F.col("copies") == F.col("their_copies")) & (F.col("places") == F.col("their_places"))
        shared = (
            pairs.join(own.select("record", "chunk", "size", "copies", "places", F.col("total").alias("my_total")), "record")
            .join(hits.select("accepted", "chunk", "their_copies", "their_places", "their_total"), ["accepted", "chunk"])
            .groupBy("record", "accepted", "my_total", "their_total")
            .agg(
                F.sum(F.col("size") * F.least("copies", "their_copies")).alias("shared"),
                F.sum(F.when(in_place, F.col("size") * F.col("copies")).otherwise(F.lit(0))).alias("in_place"),
            )
            .withColumn("coverage", F.col("shared") / F.col("my_total"))
            .withColumn("back_coverage", F.col("shared") / F.col("their_total"))
            .filter((F.col("coverage") >= least) & (F.col("back_coverage") >= least_back))
        )
        equal = (F.col("in_place") == F.col("my_total")) & (F.col("in_place") == F.col("their_total"))
        return shared.select("record", "accepted", "coverage", "back_coverage", equal.alias("equal"))


def in_order(df: DataFrame, batch: str = "batch", seq: str = "seq") -> DataFrame:
    """The rows with ``order``: growing numbers by batch, place in it, and id; nulls last.

    The rows are sorted in ranges, and numbered within each, so the numbers have gaps.
    """
    ranged = df.orderBy(F.asc_nulls_last(batch), F.asc_nulls_last(seq), "id")
    return ranged.withColumn("order", F.monotonically_increasing_id() + 1)


def _first_by(df: DataFrame, key: str) -> DataFrame:
    """The earliest row of each key: key, first_order, first_id."""
    first = F.min(F.struct("order", "id"))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("f")).select(
        key, F.col("f.order").alias("first_order"), F.col("f.id").alias("first_id")
    )


def _blocked(rows: DataFrame, by: DataFrame, same_rows: bool, min_similarity: float, dim: int) -> DataFrame:
    """Ids of ``rows`` and, for each, ids of records in ``by`` that come before and are equal or similar to it.

    For each row at most: the first of its content, the first of its vector, and
    the first of the similar vectors. Where there is any there is one given.
    """
    by_text = salted_join(rows.filter("digest IS NOT NULL"), _first_by(by, "digest"), "digest", "id")
    with_vector = rows.filter("vector IS NOT NULL")
    firsts = materialise(_first_by(by, "vector"), "vector-firsts")
    by_vector = salted_join(with_vector, firsts, "vector", "id")
    queries = materialise(
        _first_by(rows, "vector").select(F.col("first_id").alias("id"), "vector", F.col("first_order").alias("order"))
        if same_rows
        else with_vector.select("id", "vector", "order"),
        "vector-queries",
    )
    right = firsts.select(F.col("first_id").alias("id"), "vector", F.col("first_order").alias("order"))
    near = match(queries, right, min_similarity, earlier=True, first=True, dim=dim).join(queries.select("id", "vector"), "id")
    if same_rows:
        near = salted_join(with_vector.select("id", "vector"), near.drop("id"), "vector", "id")
    same = [d.filter("first_order < order").select("id", F.col("first_id").alias("blocker")) for d in (by_text, by_vector)]
    return same[0].unionByName(same[1]).unionByName(near.select("id", F.col("other").alias("blocker")))


def accept_in_order(rows: DataFrame, min_similarity: float = SIMILAR, dim: int = DIM) -> DataFrame:
    """The rows of (id, order, digest, vector) that repeat no accepted row before them.

    Each round accepts what has no undecided neighbour before it and drops what
    has an accepted one; the earliest undecided row is always decided, and a
    group of copies is decided in one round.
    """
    undecided, accepted = rows, None
    while True:
        blocks = materialise(_blocked(undecided, undecided, True, min_similarity, dim), "blocked")
        free = materialise(undecided.join(blocks, "id", "left_anti"), "accepted")
        accepted = free if accepted is None else accepted.unionByName(free)
        beaten = blocks.join(free.select(F.col("id").alias("blocker")), "blocker", "left_semi").select("id").distinct()
        rest = materialise(
            undecided.join(free.select("id"), "id", "left_anti").join(beaten, "id", "left_anti"), "undecided"
        )
        if rest.isEmpty():
            return accepted
        late = _blocked(rest, free, False, min_similarity, dim).select("id").distinct()
        undecided = materialise(rest.join(late, "id", "left_anti"), "undecided")
        if undecided.isEmpty():
            return accepted


def repeats(
    new: DataFrame,
    history: ChunkHistory,
    new_cols: tuple[str, str, str, str, str] = ("commit_id", "batch_no", "seq_no", "content", "content_embedding"),
    min_similarity: float = SIMILAR,
    dim: int = DIM,
) -> DataFrame:
    """id, match, similarity of the new records that repeat an accepted one (similarity null for equal contents).

    ``history`` holds what was accepted before; what is accepted of the new records is appended to it.
    """
    key, batch, seq, content, vector = new_cols
    place = F.struct(F.coalesce(batch, F.lit(2**31 - 1)), F.coalesce(seq, F.lit(2**31 - 1)), F.col(content), F.col(vector))
    picked = F.min_by(F.struct(F.col(batch).alias("batch"), F.col(seq).alias("seq"), F.col(content).alias("text"), F.col(vector).alias("v")), place)
    distinct = (
        new.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("id"))
        .agg(picked.alias("r"))
        .select("id", "r.*")
        .withColumn("body", one_blank(F.col("text")))
        .withColumn("digest", F.sha2("body", 256))
    )
    texts = materialise(in_order(distinct).select("id", "order", "digest", "body", "v"), "new-records")
    vectors = usable_vectors(texts, "id", "v", dim)
    rows = materialise(texts.drop("v", "body").join(vectors, "id", "left"), "new-rows")
    contents = texts.filter("body IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("body").alias("body"))
    contents = materialise(contents, "new-contents")
    known = (
        history.covered(contents.select("id", "body"), 1.0, 1.0)
        .filter("equal")
        .join(contents.select(F.col("id").alias("record"), "digest"), "record")
        .groupBy("digest")
        .agg(F.min("accepted").alias("equal_to"))
    )
    known_rows = salted_join(rows.filter("digest IS NOT NULL"), known, "digest", "id").select("id", "equal_to")
    told = materialise(rows.join(known_rows, "id", "left"), "told")
    # Only what no coverage decided is compared by vectors.
    waiting = told.filter("equal_to IS NULL AND vector IS NOT NULL")
    asked = materialise(waiting.groupBy("vector").agg(F.min("id").alias("id"), F.min("order").alias("order")), "asked")
    like = match(asked, history.vectors(), min_similarity, dim=dim, packed=True).join(asked.select("id", "vector"), "id")
    like = like.select("vector", F.col("other").alias("like"), F.col("similarity").alias("like_similarity"))
    like_rows = salted_join(waiting, like, "vector", "id").select("id", "like", "like_similarity")
    judged = materialise(told.join(like_rows, "id", "left"), "judged")
    open_rows = judged.filter("equal_to IS NULL AND like IS NULL").select("id", "order", "digest", "vector")
    kept = materialise(accept_in_order(open_rows, min_similarity, dim), "kept")
    history.append(texts.select("id", "body").join(kept.select("id", "vector"), "id"))
    others = materialise(judged.join(kept.select("id"), "id", "left_anti"), "repeated")
    same = salted_join(others.filter("digest IS NOT NULL AND equal_to IS NULL"), _first_by(kept, "digest"), "digest", "id")
    same = materialise(same.filter("first_order < order").select("id", F.col("first_id").alias("equal_new")), "equal-new")
    near_asked = others.filter("equal_to IS NULL AND vector IS NOT NULL").join(same, "id", "left_anti")
    sides = [df.select("id", "vector", "order") for df in (materialise(near_asked, "near-asked"), kept.filter("vector IS NOT NULL"))]
    near = match(*sides, min_similarity, earlier=True, dim=dim).select(
        "id", F.col("other").alias("near"), F.col("similarity").alias("near_similarity")
    )
    best = F.when(
        F.col("like").isNotNull()
        & (
            F.col("near").isNull()
            | (F.col("like_similarity") > F.col("near_similarity"))
            | ((F.col("like_similarity") == F.col("near_similarity")) & (F.col("like") < F.col("near")))
        ),
        F.struct(F.col("like").alias("m"), F.col("like_similarity").alias("s")),
    ).otherwise(F.struct(F.col("near").alias("m"), F.col("near_similarity").alias("s")))
    equal = F.coalesce("equal_to", "equal_new")
    return (
        others.join(same, "id", "left")
        .join(near, "id", "left")
        .select("id", F.coalesce(equal, best["m"]).alias("match"), F.when(equal.isNull(), best["s"]).alias("similarity"))
    )
