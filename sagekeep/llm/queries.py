"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagekeep.llm import conversations, encoding, history, mixing, names, spans, vectors
from sagekeep.runtime import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return conversations.conversations(spark, f"{root}/session_lines.parquet")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    groups = names.link_names(read_table(spark, root, "entities"), read_table(spark, root, "name_aliases"))
    return names.linked_pairs(groups)


SIMILAR, NEIGHBOURS = 0.90, 5


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = None
    for table, column in (("memories", "content_embedding"), ("entities", "embedding")):
        near = vectors.similar_neighbours(read_table(spark, root, table), "id", column, NEIGHBOURS, SIMILAR)
        pairs = vectors.unordered_pairs(near)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def p4_repeats(spark: SparkSession, root: str) -> DataFrame:
    """id, match, similarity of the undecided commits that repeat something accepted; similarity is null where coverage decided."""
    memories = read_table(spark, root, "memories").filter("id IS NOT NULL")
    accepted = memories.select(F.col("id").cast("string").alias("id"), history.one_blank(F.col("content")).alias("body"), "content_embedding")
    usable = vectors.usable_vectors(accepted, "id", "content_embedding")
    bare = accepted.select("id", F.lit(None).cast("binary").alias("vector"), "body")
    known = history.ChunkHistory(spark)
    known.append(bare.unionByName(usable.select("id", "vector", F.lit(None).cast("string").alias("body"))))
    return history.repeats(read_table(spark, root, "commit_outcomes").filter("outcome IS NULL"), known)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    found = p4_repeats(spark, root)
    return found.select(F.least("id", "match").alias("id_a"), F.greatest("id", "match").alias("id_b"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode(read_table(spark, root, "documents"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read_table(spark, root, "documents"), read_table(spark, root, "mix_targets"))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.reached_shares(p7_mix(spark, root), read_table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, root, "documents"))


def p8_shared_part(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_part(read_table(spark, root, "documents"), p8_found(spark, root))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_repeats": p4_repeats,
    "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shared_part": p8_shared_part}
ORACLES: dict[str, str] = {}
