"""Recall and hybrid search: candidates by vector, re-ranked by entities, events, edges and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.functions.scores import DEFAULT, ScoreConfig, graph_boost, reinforcement, temporal_confidence
from sagekeep.operators.blocks import best_matches
from sagekeep.operators.graph import Graph
from sagekeep.operators.vector import cosine_to, usable
from sagekeep.runtime import materialise


def multipliers(graph: Graph, candidates: DataFrame, moment: Column, config: ScoreConfig = DEFAULT) -> DataFrame:
    """The candidates with reinforcement, boost, confidence and their product ``multiplier``.

    Events and edges are reduced to the candidates before their versions are told
    apart, so a search over few candidates neither ranks nor groups the whole log.
    """
    ids = candidates.select("id").distinct()
    of_memory = ids.withColumnRenamed("id", "memory_id")
    log = graph.view("memory_events", F.col("event_type").startswith("REINFORCE"), of_memory)
    strength = reinforcement(log, moment, config).withColumnsRenamed({"memory_id": "id", "multiplier": "reinforcement"})
    links = graph.edge_view("t_expired IS NULL", ids.withColumnRenamed("id", "to_node")).select("to_node")
    degrees = links.unionByName(graph.affects(of_memory).select("to_node"))
    degrees = degrees.groupBy(F.col("to_node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    scored = candidates.join(strength, "id", "left").join(degrees, "id", "left")
    return (
        scored.withColumn("reinforcement", F.coalesce("reinforcement", F.lit(1.0)))
        .withColumn("reinforcements", F.coalesce("reinforcements", F.lit(0)))
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("boost", graph_boost("degree", config))
        .withColumn("confidence", temporal_confidence(F.coalesce("t_valid", "created_at"), "temporal_stability", moment, config))
        .withColumn("multiplier", F.col("reinforcement") * F.col("boost") * F.col("confidence"))
    )


def entity_scores(graph: Graph, matched: DataFrame, least: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """id, entity_score: for each memory (of ``among``, id, where it is given) the best of match similarity times mention confidence.

    ``matched`` has entity_id and similarity. A missing confidence, and one of 0, counts as 1.
    """
    sure = F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 1.0).otherwise(F.col("confidence"))
    among = None if among is None else among.select(F.col("id").alias("from_node")).distinct()
    links = graph.along("MENTIONS", least=least, among=among)
    links = links.select(F.col("from_node").alias("id"), F.col("to_node").alias("entity_id"), sure.alias("sure"))
    return matched.join(links, "entity_id").groupBy("id").agg(F.max(F.col("similarity") * F.col("sure")).alias("entity_score"))


def match_entities(graph: Graph, asked: DataFrame, least: float, dim: int) -> DataFrame:
    """asked_id, entity_id, similarity: the entity of the same key (similarity 1), else the nearest of the type.

    ``asked`` has asked_id, entity_type, norm_key and vector. What the first way
    left open is compared in blocks of all entities, in which the type is a
    condition, so that no type is a group of its own.
    """
    keyed = graph.entities_by_key(asked.select("norm_key"))
    by_key = asked.join(keyed.filter("entity_id IS NOT NULL"), "norm_key").select("asked_id", "entity_id", F.lit(1.0).alias("similarity"))
    by_key = materialise(by_key, "by-key")
    rest = asked.join(by_key.select("asked_id"), "asked_id", "left_anti").filter(usable("vector", dim) & F.col("entity_type").isNotNull())
    pool = graph.active_entities().filter(usable("embedding", dim) & F.col("entity_type").isNotNull())
    columns = [F.lit(0).alias("place"), F.xxhash64("entity_type").alias("group")]
    # An id may stand on both sides, and is compared with itself as with any other.
    rest = materialise(rest.select(F.concat(F.lit("?"), "asked_id").alias("id"), "vector", *columns), "asked")
    pool = materialise(pool.select("id", F.col("embedding").alias("vector"), *columns), "pool")
    near = best_matches(rest, pool, least, 1)
    return by_key.unionByName(near.select(F.substring("id", 2, 2**31 - 1).alias("asked_id"), F.col("other").alias("entity_id"), "similarity"))


def hybrid_search(
    graph: Graph,
    query: list[float],
    matched: DataFrame | None,
    moment: Column,
    limit: int = 5,
    overfetch: int = 10,
    entity_weight: float = 0.3,
    include_expired: bool = False,
    config: ScoreConfig = DEFAULT,
) -> DataFrame:
    """The ``limit`` best memories for a query vector.

    Candidates are the ``limit * overfetch`` nearest; if any candidate mentions a
    matched entity, each score is ``(1 - w) * similarity + w * entity_score``.
    Entities only re-rank candidates, they never add any.
    """
    where = None if include_expired else F.col("t_expired").isNull()
    candidates = graph.compared_memories(query, ["id", "created_at", "t_valid", "temporal_stability"], where)
    candidates = materialise(candidates.orderBy(F.desc("similarity"), "id").limit(limit * overfetch), "candidates")
    if matched is not None:
        scores = entity_scores(graph, matched, among=candidates)
        candidates = candidates.join(scores, "id", "left")
        any_match = F.max(F.col("entity_score").isNotNull()).over(W.partitionBy(F.lit(1)))
        blended = (1 - entity_weight) * F.col("similarity") + entity_weight * F.coalesce("entity_score", F.lit(0.0))
        candidates = candidates.withColumn("base", F.when(any_match, blended).otherwise(F.col("similarity")))
    else:
        candidates = candidates.withColumn("base", F.col("similarity"))
    scored = multipliers(graph, candidates, moment, config).withColumn("score", F.col("base") * F.col("multiplier"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def recall(
    graph: Graph,
    query: list[float],
    moment: Column,
    limit: int | None = 5,
    overfetch: int = 5,
    include_expired: bool = False,
    config: ScoreConfig = DEFAULT,
) -> DataFrame:
    """Memories around the summaries nearest to a query.

    The nearest summaries lead to their chunks, those to all memories in them;
    each chunk is expanded once, each row scored once. Without a ``limit`` all
    summaries count as near, and all memories around them are given.
    """
    active = F.lit(True) if include_expired else F.col("t_expired").isNull()
    summaries = graph.compared_memories(query, ["id"], (F.col("kind") == "SUMMARY") & active)
    if limit is not None:
        summaries = summaries.orderBy(F.desc("similarity"), "id").limit(limit * overfetch)
    summaries = materialise(summaries.select("id"), "summaries")
    of_summaries = graph.along("CONTAINS", among=summaries.select(F.col("id").alias("to_node")))
    chunks = of_summaries.select("from_node").distinct()
    members = graph.along("CONTAINS", among=chunks).select(F.col("to_node").alias("id"))
    wanted = materialise(members.unionByName(summaries).distinct(), "members")
    rows = graph.memory_view(active, wanted)
    rows = rows.withColumn("similarity", F.coalesce(cosine_to("content_embedding", query), F.lit(0.0)))
    rows = rows.select("id", "kind", "content", "created_at", "t_valid", "temporal_stability", "similarity")
    scored = multipliers(graph, rows, moment, config).withColumn("score", F.col("similarity") * F.col("multiplier"))
    ordered = scored.orderBy(F.desc("score"), "id")
    return ordered if limit is None else ordered.limit(limit)


def expand_shared_entities(graph: Graph, seeds: DataFrame, limit: int | None = 3, least: float = 0.75, include_expired: bool = False) -> DataFrame:
    """id, shared: memories that mention the same entities as the seeds (id), best connected first."""
    mentions = graph.along("MENTIONS", least=least).select(F.col("from_node").alias("id"), F.col("to_node").alias("entity")).distinct()
    entities = mentions.join(seeds.select("id"), "id", "left_semi").select("entity").distinct()
    members = graph.memories if include_expired else graph.active_memories()
    found = (
        mentions.join(entities, "entity", "left_semi")
        .join(seeds.select("id"), "id", "left_anti")
        .join(members.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return found if limit is None else found.orderBy(F.desc("shared"), "id").limit(limit)


def expand_related(graph: Graph, seeds: DataFrame, limit: int | None = 3, least: float = 0.0, include_expired: bool = False) -> DataFrame:
    """id, weight, via: memories that a RELATED edge leads to from a seed, by the best edge and its seed."""
    links = graph.along("RELATED", least=least).join(seeds.select(F.col("id").alias("from_node")), "from_node", "left_semi")
    members = graph.memories if include_expired else graph.active_memories()
    best = F.struct("weight", "from_node")
    found = (
        links.select(F.col("to_node").alias("id"), "weight", "from_node")
        .join(seeds.select("id"), "id", "left_anti")
        .join(members.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.max(best).alias("b"))
        .select("id", F.col("b.weight").alias("weight"), F.col("b.from_node").alias("via"))
    )
    return found if limit is None else found.orderBy(F.desc("weight"), "id").limit(limit)


def expand(graph: Graph, seeds: DataFrame, via_entities: int = 3, via_related: int = 3) -> DataFrame:
    """Both expansions: reason, id, score, via."""
    shared = expand_shared_entities(graph, seeds, via_entities).select(
        F.lit("shared_entities").alias("reason"), "id", F.col("shared").cast("double").alias("score"), F.lit(None).cast("string").alias("via")
    )
    related = expand_related(graph, seeds, via_related).select(F.lit("related").alias("reason"), "id", F.col("weight").alias("score"), "via")
    return shared.unionByName(related)
