"""Connected components of links, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagekeep.runtime import hot_values, materialise

#: Parts to which the links of a node are dealt that may have a great part of all.
SALTS = 32


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for the nodes of (a, b).

    Labels spread along the links, and each label takes over that of the node it
    names, so that long chains need few rounds. Links of a node that many others
    have are dealt to several parts, to each of which its label goes. Nodes that
    repeat, links of a node to itself and links given twice or both ways do no
    harm; null ends are left out.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hot = hot_values(both.select("b"), "b")
    is_hot = F.col("b").isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = both.withColumn("part", part)
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).select(F.col("a").alias("node"), "l"), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), "l").withColumn("part", F.explode(parts))
        offers = dealt.join(known, ["b", "part"]).groupBy("a").agg(F.min("l").alias("o"))
        nearer = labels.join(offers.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("l").alias("was"), F.least("l", "o").alias("l")
        )
        far = labels.select(F.col("node").alias("l"), F.col("l").alias("beyond"))
        moved = materialise(
            nearer.join(far, "l", "left").select("node", "was", F.least("l", F.coalesce("beyond", "l")).alias("l")), "labels"
        )
        if moved.filter("was <> l").isEmpty():
            return moved.select("node", F.col("l").alias("component"))
        labels = moved.drop("was")
