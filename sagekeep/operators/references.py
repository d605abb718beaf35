"""References to records that do not exist (problem 5).

Parents and children are put into one long table, tagged, and grouped by parent
table and key. A group without a parent row holds only orphans; where there is a
parent, its times tell whether a reference came too early (``late``) or after
the parent's end (``deleted``).

Defined results:

* null or blank keys are no references; keys are compared without outer white
  space and without case;
* an edge type that names no target table gives no reference;
* a record without a time has a null period and can only be ``missing``;
* a record delivered more than once counts once, by its id; records without an
  id count as one per field;
* parents delivered more than once, or whose keys differ only in case or outer
  blanks, are one parent: its earliest creation and its earliest end hold;
* an empty child table gives no rows, an empty parent table makes every
  reference to it ``missing``; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.runtime import hot_values, read_table, strip

#: The tables that each edge type leads from and to.
EDGE_TARGETS = {
    "PRODUCED": ("sources", "memories"),
    "CONTAINS": ("chunks", "memories"),
    "MENTIONS": ("memories", "entities"),
    "RELATED": ("memories", "memories"),
    "LINKED": ("chunks", "entities"),
    "SUMMARIZES": ("memories", "memories"),
}

HOT_SUPPORT = 0.005
SALTS = 32


@dataclass(frozen=True)
class Parent:
    """A table that references lead to."""

    name: str
    frame: DataFrame
    key: str
    created_at: str
    deleted_at: str | None = None


@dataclass(frozen=True)
class Child:
    """A table that holds references: ``fields`` maps each field to a column that names its target table."""

    name: str
    frame: DataFrame
    ref_id: str
    time: str
    fields: dict[str, Column] = field(default_factory=dict)


def _key(column: str) -> Column:
    return F.lower(strip(column))


def edge_target(side: int) -> Column:
    """The target table of an edge's from_node (side 0) or to_node (side 1)."""
    kind = F.upper(strip("edge_type"))
    target = F.lit(None).cast("string")
    for name, tables in EDGE_TARGETS.items():
        target = F.when(kind == name, F.lit(tables[side])).otherwise(target)
    return target


def _children(children: list[Child]) -> DataFrame:
    """All references in long form; each table is scanned once however many fields it has."""
    long = None
    for child in children:
        refs = F.array(
            *[
                F.struct(F.lit(name).alias("ref_field"), target.alias("target"), _key(name).alias("key"))
                for name, target in child.fields.items()
            ]
        )
        part = (
            child.frame.select(
                F.lit(child.name).alias("ref_table"),
                F.col(child.ref_id).cast("string").alias("ref_id"),
                F.col(child.time).cast("timestamp").alias("at"),
                F.explode(refs).alias("r"),
            )
            .select("ref_table", "ref_id", "at", "r.ref_field", "r.target", "r.key")
            .filter("target IS NOT NULL AND key <> ''")
        )
        long = part if long is None else long.unionByName(part)
    return long


def orphan_references(
    parents: list[Parent], children: list[Child], hot_support: float = HOT_SUPPORT, salts: int = SALTS
) -> DataFrame:
    """One row for each reference that leads nowhere: ref_table, ref_id, ref_field, period, reason.

    A key that may hold more than ``hot_support`` of all references is split
    over ``salts`` groups, and its parent row is repeated in each of them, so
    that no task gets one key's rows alone. There are at most
    ``1 / hot_support`` such keys.
    """
    refs = _children(children)
    place = F.concat_ws("|", "target", "key")
    hot = hot_values(refs.select(place.alias("place")), "place", hot_support)
    is_hot = place.isin(hot) if hot else F.lit(False)
    refs = refs.withColumn(
        "salt", F.when(is_hot, F.pmod(F.xxhash64("ref_id", "ref_field"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).withColumn("is_parent", F.lit(False))
    long = refs
    for parent in parents:
        ends = F.col(parent.deleted_at) if parent.deleted_at else F.lit(None)
        rows = (
            parent.frame.select(
                F.lit(parent.name).alias("target"),
                _key(parent.key).alias("key"),
                F.col(parent.created_at).cast("timestamp").alias("created"),
                ends.cast("timestamp").alias("ended"),
            )
            .filter("key <> ''")
            .withColumn("is_parent", F.lit(True))
            .withColumn("salts", F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
            .select("target", "key", "created", "ended", "is_parent", F.explode("salts").alias("salt"))
        )
        long = long.unionByName(rows, allowMissingColumns=True)
    group = W.partitionBy("target", "key", "salt")
    seen = (
        long.withColumn("has_parent", F.max("is_parent").over(group))
        .withColumn("created", F.min("created").over(group))
        .withColumn("ended", F.min("ended").over(group))
        .filter(~F.col("is_parent"))
    )
    reason = (
        F.when(~F.col("has_parent"), "missing")
        .when(F.col("created") > F.col("at"), "late")
        .when(F.col("ended") < F.col("at"), "deleted")
    )
    return (
        seen.select("ref_table", "ref_id", "ref_field", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason"))
        .filter("reason IS NOT NULL")
        .dropDuplicates(["ref_table", "ref_id", "ref_field"])
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, period and reason."""
    return orphans.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def graph_orphans(spark: SparkSession, root: str) -> DataFrame:
    """The references of edges, memory_events and entities of the tables under ``root``."""
    memories, entities = read_table(spark, root, "memories"), read_table(spark, root, "entities")
    return orphan_references(
        [
            Parent("memories", memories, "id", "created_at", "t_expired"),
            Parent("entities", entities, "id", "created_at", "expired_at"),
            Parent("chunks", read_table(spark, root, "chunks"), "chunk_id", "created_at"),
            Parent("sources", read_table(spark, root, "sources"), "source_id", "created_at"),
        ],
        [
            Child(
                "edges",
                read_table(spark, root, "edges"),
                "edge_id",
                "t_created",
                {"from_node": edge_target(0), "to_node": edge_target(1)},
            ),
            Child(
                "memory_events",
                read_table(spark, root, "memory_events"),
                "event_id",
                "occurred_at",
                {"memory_id": F.lit("memories")},
            ),
            Child("entities", entities, "id", "created_at", {"chunk_id": F.lit("chunks")}),
        ],
    )
