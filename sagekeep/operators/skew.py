"""Joins on keys that may hold a great part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.runtime import hot_values, materialise

SUPPORT, SALTS = 0.01, 64


def salted_join(
    rows: DataFrame, groups: DataFrame, key: str, row_id: str, support: float = SUPPORT, salts: int = SALTS
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row for each key) on ``key``.

    Keys that may hold more than ``support`` of the rows are spread over
    ``salts`` parts, and their group's row is repeated for each part. There are
    at most ``1 / support`` such keys, whatever the size of the data.
    """
    place = F.xxhash64(key)
    hot = hot_values(rows.select(place.alias("place")), "place", support)
    is_hot = place.isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("__part", part)
    right = groups.withColumn("__part", F.explode(parts))
    return left.join(right, [key, "__part"]).drop("__part")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """The rows with their number, from 1, among those of their ``key`` by ``order`` (which should tell them all apart).

    The table is sorted in ranges, so a key that has a great part of the rows lies
    in many of them. Each range numbers its own rows; of a key only one row for
    each range is gathered, to say how many came in the ranges before.
    """
    ids = F.monotonically_increasing_id()
    ranged = materialise(rows.orderBy(key, *order).withColumn("__at", ids), "ranges").withColumn("__range", F.shiftright("__at", 33))
    heads = ranged.groupBy(key, "__range").agg(F.min("__at").alias("__head"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnRenamed(key, "__key")
    same = F.equal_null(F.col(key), F.col("__key"))
    found = ranged.join(heads.withColumnRenamed("__range", "__r"), same & (F.col("__range") == F.col("__r")))
    return found.select(*rows.columns, (F.col("__at") - F.col("__head") + F.col("__before") + 1).alias(name))
