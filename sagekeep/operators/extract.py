"""Extraction and summaries with pluggable models.

A model is any object with the methods below; the defaults need none. Models are
called on Arrow batches inside tasks, so they must be serialisable, and calling
them twice with one text must do no harm (a task may be repeated).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagekeep.functions.text import evidence, identifier, norm_key, preview, shortened
from sagekeep.operators.skew import salted_join


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def entities(self, text: str) -> list[tuple[str, str, float, str]]: ...

    def memories(self, text: str) -> list[tuple[str, float, str]]: ...


@functools.lru_cache(maxsize=1 << 16)  # the same few thousand n-grams make most of all texts
def _place(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@dataclass(frozen=True)
class HashedEmbedder:
    """Character n-grams hashed to a unit vector: like texts get like vectors."""

    dim: int = 64
    size: int = 4

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        vector = [0.0] * self.dim
        padded = f" {text.lower()} "
        for at in range(max(1, len(padded) - self.size + 1)):
            place = _place(padded[at : at + self.size])
            vector[place % self.dim] += 1.0 if place >> 63 else -1.0
        norm = sum(x * x for x in vector) ** 0.5
        return [x / norm for x in vector] if norm else vector


@dataclass(frozen=True)
class RuleExtractor:
    """Capitalised words as entities, sentences as memories."""

    types: dict[str, str] = field(default_factory=dict)
    least_length: int = 10

    def entities(self, text: str) -> list[tuple[str, str, float, str]]:
        found = {}
        for match in re.finditer(r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]{3,}(?: [A-Z][a-z]+)*)", text):
            found.setdefault(match[1], text[max(0, match.start() - 30) : match.end() + 30])
        return [(name, self.types.get(name, "CONCEPT"), 0.8, near) for name, near in found.items()]

    def memories(self, text: str) -> list[tuple[str, float, str]]:
        parts = re.split(r"(?<=[.!?])\s+", text)
        return [(p.strip(), 1.0, "sentence") for p in parts if len(p.strip()) >= self.least_length]


def embed_texts(df: DataFrame, text_col: str, embedder: Embedder, dim: int, lower: bool = False, most_chars: int | None = None, keep_going: bool = False) -> DataFrame:
    """``df`` with ``vector``; null texts get none.

    A model that fails, or gives another length, fails the job; with ``keep_going``
    the texts of such a batch are tried one by one, and those that fail get none.
    """

    def checked(texts: list[str]) -> list[list[float]]:
        vectors = embedder.embed(texts)
        if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
            raise ValueError(f"the model gave a vector that isn't of length {dim}")
        return vectors

    def alone(text: str) -> list[float] | None:
        try:
            return checked([text])[0]
        except Exception:  # whatever a model raises
            return None

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()].tolist()
        try:
            vectors = checked(known)
        except Exception:
            if not keep_going:
                raise
            vectors = [alone(text) for text in known]
        given = iter(vectors)
        return pd.Series([next(given) if there else None for there in texts.notna()], dtype=object)

    text = F.lower(text_col) if lower else F.col(text_col)
    return df.withColumn("vector", run(text if most_chars is None else F.substring(text, 1, most_chars)))


def extract_entities(df: DataFrame, id_col: str, text_col: str, extractor: Extractor) -> DataFrame:
    """id, name, entity_type, confidence, evidence, norm_key; entities without a name or a type are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, *e) for i, text in zip(pdf["id"], pdf["text"], strict=True) for e in extractor.entities(text)]
            yield pd.DataFrame(rows, columns=["id", "name", "entity_type", "confidence", "evidence"])

    found = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col(text_col).isNotNull()).mapInPandas(
        run, "id string, name string, entity_type string, confidence double, evidence string"
    )
    kind = F.upper(F.trim("entity_type"))
    named = found.filter((F.trim("name") != "") & (kind != "")).withColumn("entity_type", kind)
    sure = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    return named.withColumn("confidence", sure).withColumn("norm_key", norm_key("name", "entity_type")).withColumn("evidence", evidence("evidence"))


def extract_memories(df: DataFrame, id_col: str, text_col: str, extractor: Extractor, least_confidence: float = 0.0, least_length: int = 10) -> DataFrame:
    """id, place, content, confidence, rationale of the memories in each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [
                (i, place, *m)
                for i, text in zip(pdf["id"], pdf["text"], strict=True)
                for place, m in enumerate(extractor.memories(text), 1)
            ]
            yield pd.DataFrame(rows, columns=["id", "place", "content", "confidence", "rationale"])

    found = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col(text_col).isNotNull()).mapInPandas(
        run, "id string, place int, content string, confidence double, rationale string"
    )
    return found.filter((F.col("confidence") >= least_confidence) & (F.length("content") >= least_length))


def entities_to_store(found: DataFrame, stored: DataFrame, least: float = 0.75) -> DataFrame:
    """entity_id, entity_type, canonical_name, norm_key, is_new: one entity for each key that is sure enough.

    Keys that an active stored entity has keep its id; of new ones the surest mention names them.
    """
    best = F.row_number().over(W.partitionBy("norm_key").orderBy(F.desc("confidence"), "name"))
    rows = found.filter(F.col("confidence") >= least).withColumn("rank", best).filter("rank = 1")
    known = stored.filter("expired_at IS NULL").groupBy("norm_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("known"))
    return rows.join(known, "norm_key", "left").select(
        F.coalesce("known", identifier("ent_", "norm_key")).alias("entity_id"),
        "entity_type",
        F.col("name").alias("canonical_name"),
        "norm_key",
        F.col("known").isNull().alias("is_new"),
    )


def mention_edges(found: DataFrame, entities: DataFrame, least: float = 0.75) -> DataFrame:
    """from_node, to_node, confidence, evidence: memories (id) to the entities they mention, the surest mention of each."""
    rows = found.filter(F.col("confidence") >= least).join(entities.select("norm_key", "entity_id"), "norm_key")
    best = F.max(F.struct("confidence", "evidence"))
    return rows.groupBy(F.col("id").alias("from_node"), F.col("entity_id").alias("to_node")).agg(best.alias("b")).select(
        "from_node", "to_node", "b.confidence", "b.evidence"
    )


def substring_links(members: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk_id, id, entity_id: entities of a chunk whose name stands in a memory of it, without case.

    Both sides are joined by chunk, so a name is only sought in the memories of its chunk.
    """
    names = entities.filter(F.length("canonical_name") > 0)
    pairs = members.filter("content IS NOT NULL").join(names, "chunk_id")
    return pairs.filter(F.contains(F.lower("content"), F.lower("canonical_name"))).select("chunk_id", "id", "entity_id").distinct()


def parse_forced(values: list[str]) -> list[tuple[str, str]]:
    """(name, type) of ``TYPE:Name`` values, first ones kept; a value without both raises."""
    found: dict[tuple[str, str], tuple[str, str]] = {}
    for value in values:
        kind, colon, name = value.partition(":")
        if not colon or not kind.strip() or not name.strip():
            raise ValueError(f"expected TYPE:Name, got {value!r}")
        found.setdefault((name.strip().lower(), kind.strip().upper()), (name.strip(), kind.strip().upper()))
    return list(found.values())


def summary_texts(members: DataFrame, most_bullets: int = 10, least: int = 2) -> DataFrame:
    """chunk_id, text, memory_ids: an extractive summary of each chunk with at least ``least`` memories, and those it shows.

    ``members`` has chunk_id, id, content and created_at. The earliest memories
    give one bullet each, their first sentence; only those are gathered, not the
    whole chunk.
    """
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy("created_at", "id"))
    rows = members.withColumn("place", rank).filter(F.col("place") <= most_bullets)
    sentence = F.regexp_extract("content", r"^(?s)(.*?[.!?])(\s|$)", 1)
    bullet = F.concat(F.lit("- "), preview(F.when(sentence == "", F.col("content")).otherwise(sentence), 200))
    items = F.array_sort(F.collect_list(F.struct("place", "id", bullet.alias("bullet"))))
    found = rows.groupBy("chunk_id").agg(items.alias("items")).filter(F.size("items") >= least)
    head = F.array(F.concat(F.lit("# Chunk "), "chunk_id"), F.lit(""), F.lit("**Key Insights:**"))
    return found.select(
        "chunk_id",
        F.array_join(F.concat(head, F.transform("items", lambda i: i["bullet"])), "\n").alias("text"),
        F.transform("items", lambda i: i["id"]).alias("memory_ids"),
    )


def summary_items(members: DataFrame, most_chars: int = 500) -> DataFrame:
    """chunk_id, id, item: each memory of a chunk as a model that writes its summary is shown it."""
    return members.select("chunk_id", "id", F.concat(F.lit("["), "id", F.lit("] "), shortened("content", most_chars)).alias("item"))


def summary_edges(summaries: DataFrame, members: DataFrame) -> DataFrame:
    """from_node, to_node, edge_type: a summary to all memories of its chunk, and its chunk to it both ways of saying it.

    ``members`` has chunk_id and id. A text shows a few memories of its chunk only;
    the links are a join, which nothing gathers, and a chunk that holds a great
    part of the memories is spread.
    """
    summary = identifier("mem_", F.lit("summary"), "chunk_id")
    rows = summaries.select("chunk_id", summary.alias("summary"))
    linked = salted_join(members.select("chunk_id", "id").distinct(), rows, "chunk_id", "id")
    cites = linked.select(F.col("summary").alias("from_node"), F.col("id").alias("to_node"), F.lit("SUMMARIZES").alias("edge_type"))
    kinds = F.explode(F.array(F.lit("CONTAINS"), F.lit("SUMMARIZED_BY"))).alias("edge_type")
    return cites.unionByName(rows.select(F.col("chunk_id").alias("from_node"), F.col("summary").alias("to_node"), kinds))
