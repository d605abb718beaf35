"""The write path: hygiene, duplicate decisions, and the rows that a commit adds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.functions.text import content_hash, evidence, identifier, normalise_content
from sagekeep.operators.blocks import best_matches
from sagekeep.operators.skew import salted_join
from sagekeep.operators.vector import usable
from sagekeep.runtime import materialise

#: Fixed value: replies that say nothing, as whole texts in lower case.
EMPTY_REPLIES = ["ok", "okay", "thanks", "thx", "lol", "haha", "yeah", "yep", "nope", "k"]
#: The event that an outcome is logged as; rejections are not logged.
OUTCOME_EVENTS = {"INSERTED_NEW": "ADD", "EXACT_DUPE": "REINFORCE_EXACT", "NEAR_DUPE": "REINFORCE_NEAR"}


@dataclass(frozen=True)
class Hygiene:
    min_chars: int = 12
    max_chars: int = 4000
    collapse: bool = True
    near_threshold: float = 0.92
    near_for_manual: bool = False
    near_enabled: bool = True
    dim: int = 64


def hygiene_reason(content: Column, rules: Hygiene = Hygiene()) -> Column:
    """Why a normalised content is refused: empty, too_short, too_long or no_substance; null if it isn't."""
    lower = F.lower(content)
    return (
        F.when(content.isNull() | (content == ""), "empty")
        .when(F.length(content) < rules.min_chars, "too_short")
        .when(F.length(content) > rules.max_chars, "too_long")
        .when(lower.isin(EMPTY_REPLIES) | lower.rlike(r"^\.+$"), "no_substance")
    )


def canonical_by_hash(memories: DataFrame) -> DataFrame:
    """content_hash, id: the earliest memory of each content, expired ones included."""
    rows = memories.withColumn("content_hash", content_hash("content")).filter("content_hash IS NOT NULL")
    return rows.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def nearest_memory(incoming: DataFrame, memories: DataFrame, least: float, dim: int) -> DataFrame:
    """id, other, similarity: the memory most like each incoming row (id, vector), expired ones and summaries included."""
    sides = [
        materialise(df.filter(usable("vector", dim)).withColumn("place", F.lit(0)), "compared")
        for df in (incoming.select("id", "vector"), memories.select("id", F.col("content_embedding").alias("vector")))
    ]
    return best_matches(*sides, max(least, 1e-12), 1)


def decide(memories: DataFrame, incoming: DataFrame, rules: Hygiene = Hygiene()) -> DataFrame:
    """What happens to each row of a batch: id, outcome, matched, reason, content, content_hash.

    ``incoming`` has id, place (its order), content, vector and source. Refused
    rows come first; then a row near a stored memory is a near duplicate, unless
    its source is manual; then a row of a stored content, or of one that came
    before it in the batch, is an exact duplicate; the rest is new.
    """
    rows = incoming.withColumn("content", normalise_content("content", rules.collapse))
    rows = rows.withColumn("reason", hygiene_reason(F.col("content"), rules)).withColumn("content_hash", F.sha2("content", 256))
    sound = rows.filter("reason IS NULL")
    asking = sound if rules.near_for_manual else sound.filter("source IS NULL OR source <> 'manual'")
    if rules.near_enabled:
        near = nearest_memory(asking.select("id", "vector"), memories, rules.near_threshold, rules.dim)
    else:
        near = asking.filter("false").select("id", F.col("id").alias("other"))
    judged = sound.join(near.select("id", F.col("other").alias("near")), "id", "left")
    stored = canonical_by_hash(memories).select("content_hash", F.col("id").alias("stored"))
    # The first row of each content stands for all of them; a content that a great part of the batch has is spread.
    judged = materialise(judged, "judged")
    heads = judged.groupBy("content_hash").agg(F.min_by("id", F.when(F.col("near").isNull(), F.struct("place", "id"))).alias("head"))
    heads = heads.join(stored, "content_hash", "left").select("content_hash", F.coalesce("stored", "head").alias("head"))
    judged = salted_join(judged, heads, "content_hash", "id").withColumn("first", F.when(F.col("near").isNull(), F.col("head")))
    outcome = (
        F.when(F.col("near").isNotNull(), "NEAR_DUPE")
        .when(F.col("first") != F.col("id"), "EXACT_DUPE")
        .otherwise("INSERTED_NEW")
    )
    columns = ["id", "outcome", "matched", "reason", "content", "content_hash"]
    decided = judged.withColumn("outcome", outcome).withColumn("matched", F.coalesce("near", "first")).select(columns)
    refused = rows.filter("reason IS NOT NULL").withColumn("outcome", F.lit("REJECTED_HYGIENE"))
    return decided.unionByName(refused.withColumn("matched", F.lit(None).cast("string")).select(columns))


def commit_events(decided: DataFrame, moment: Column, *more: str) -> DataFrame:
    """The events that a decided batch logs: event_id, memory_id, event_type, occurred_at, payload, and ``more`` columns of it."""
    kind = F.lit(None).cast("string")
    for outcome, event in OUTCOME_EVENTS.items():
        kind = F.when(F.col("outcome") == outcome, event).otherwise(kind)
    payload = F.to_json(F.struct("outcome", F.col("id").alias("commit_id"), "content_hash"))
    return decided.filter(F.col("outcome") != "REJECTED_HYGIENE").select(
        identifier("evt_", "id", "outcome").alias("event_id"),
        F.col("matched").alias("memory_id"),
        kind.alias("event_type"),
        moment.alias("occurred_at"),
        payload.alias("payload"),
        *more,
    )


def known_only(events: DataFrame, memories: DataFrame) -> DataFrame:
    """The events whose memory exists; an event of no memory isn't logged."""
    return events.join(memories.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi").select(events.columns)


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The edges of ``incoming`` that are added: one for each (from, to, type) without an active edge, the first kept.

    With ``nodes`` (node) edges whose ends don't exist are left out. Evidence is cut to its limit.
    """
    key = ["from_node", "to_node", "edge_type"]
    rank = F.row_number().over(W.partitionBy(key).orderBy("t_created", "edge_id"))
    fresh = incoming.withColumn("rank", rank).filter("rank = 1").drop("rank")
    fresh = fresh.join(existing.filter("t_expired IS NULL").select(key), key, "left_anti")
    if nodes is not None:
        for end in ("from_node", "to_node"):
            fresh = fresh.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return fresh.withColumn("evidence", evidence("evidence")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def dedupe_entities(entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first active entity of each norm_key, without those whose key an active stored entity has."""
    rank = F.row_number().over(W.partitionBy("norm_key").orderBy("created_at", "id"))
    rows = entities.filter("expired_at IS NULL AND norm_key IS NOT NULL").withColumn("rank", rank).filter("rank = 1").drop("rank")
    return rows if existing is None else rows.join(existing.filter("expired_at IS NULL").select("norm_key"), "norm_key", "left_anti")


def related_edges(memories: DataFrame, least: float = 0.6, most: int = 5, dim: int = 64) -> DataFrame:
    """from_node, to_node, weight, confidence, evidence: each memory to its most similar earlier ones."""
    rows = memories.filter(usable("content_embedding", dim) & F.col("created_at").isNotNull()).select(
        "id", F.col("content_embedding").alias("vector"), F.unix_micros("created_at").alias("place")
    )
    found = best_matches(rows, rows, least, most, earlier=True)
    return found.select(
        F.col("id").alias("from_node"),
        F.col("other").alias("to_node"),
        F.col("similarity").alias("weight"),
        F.col("similarity").alias("confidence"),
        F.format_string("semantic_similarity=%.3f", "similarity").alias("evidence"),
    )


# Updates. Each gives the whole new table; a store publishes it as its next version.


def set_vectors(rows: DataFrame, vectors: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``vectors`` (id, vector) has one."""
    new = vectors.select("id", F.col("vector").alias("__new"))
    return rows.join(new, "id", "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(rows.columns)


def deprecate(memories: DataFrame, ids: DataFrame, moment: Column, invalid_from: Column | None = None) -> DataFrame:
    """Active memories among ``ids`` are expired at ``moment``; their t_invalid becomes ``invalid_from``, be it null."""
    hit = F.col("__hit").isNotNull() & F.col("t_expired").isNull()
    marked = memories.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    ends = invalid_from if invalid_from is not None else F.lit(None).cast("timestamp")
    return (
        marked.withColumn("t_invalid", F.when(hit, ends).otherwise(F.col("t_invalid")))
        .withColumn("t_expired", F.when(hit, moment).otherwise(F.col("t_expired")))
        .select(memories.columns)
    )


def expire_entities(entities: DataFrame, merges: DataFrame, moment: Column) -> DataFrame:
    """Entities of ``merges`` (id, merged_into, which may be null) are expired and point to what they became."""
    new = merges.select("id", F.col("merged_into").alias("__into"), F.lit(True).alias("__hit"))
    marked = entities.join(new, "id", "left")
    return (
        marked.withColumn("expired_at", F.when(F.col("__hit"), moment).otherwise(F.col("expired_at")))
        .withColumn("merged_into", F.when(F.col("__hit"), F.col("__into")).otherwise(F.col("merged_into")))
        .select(entities.columns)
    )


def expire_edges(edges: DataFrame, ids: DataFrame, moment: Column) -> DataFrame:
    marked = edges.join(ids.select("edge_id").distinct().withColumn("__hit", F.lit(True)), "edge_id", "left")
    ends = F.when(F.col("__hit") & F.col("t_expired").isNull(), moment).otherwise(F.col("t_expired"))
    return marked.withColumn("t_expired", ends).select(edges.columns)


def delete_edges(edges: DataFrame, kind: str | None = None, from_node: str | None = None) -> DataFrame:
    """What is left without the edges of a kind, of a node, or of both."""
    hit = F.lit(True)
    if kind is not None:
        hit &= F.col("edge_type") == kind
    if from_node is not None:
        hit &= F.col("from_node") == from_node
    return edges.filter(~F.coalesce(hit, F.lit(False)))


def purge_entities(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No entities, and the edges that touched none of them."""
    gone = entities.select("id")
    left = edges
    for end in ("from_node", "to_node"):
        left = left.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return entities.filter("false"), left.select(edges.columns)


def resolve_merges(entities: DataFrame, most_steps: int = 20) -> DataFrame:
    """id, final: where each entity's chain of merges ends.

    Each step doubles the reach. Merges into ids that aren't there end at the
    last one that is; entities of a ring stop somewhere in it: as long as a chain
    goes on, fewer entities move in each step, so when their number stays the same
    only rings are left.
    """
    into = F.when(F.col("merged_into") != "", F.col("merged_into"))
    known = entities.select(F.col("id").alias("final"), F.lit(True).alias("there"))
    steps = entities.select("id", into.alias("final")).join(known, "final", "left")
    steps = materialise(steps.select("id", F.when(F.col("there"), F.col("final")).otherwise(F.col("id")).alias("final")), "merges")
    moving = None
    for _ in range(most_steps):
        onward = steps.select(F.col("id").alias("final"), F.col("final").alias("further"))
        moved = materialise(steps.join(onward, "final").select("id", F.col("further").alias("final"), F.col("final").alias("was")), "merges")
        steps = moved.drop("was")
        before, moving = moving, moved.filter("final <> was").count()
        if moving in (0, before):
            break
    return steps
