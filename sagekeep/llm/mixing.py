"""Mixing sources to target weights (problem 7).

Documents are counted by exact token length. Each source gets a budget of tokens;
whole passes over the source fill most of it where documents may be repeated, an
even share of every length fills most of the rest, and a bounded knapsack over
the lengths that are left (counts, not documents) meets the last tokens. Which
documents of a length are taken is drawn by a seeded hash.

The size of the mix is the largest at which every source can give its share
without using a document more than ``max_repeats`` times, or ``total`` if that
is smaller.

Defined results:

* sources are compared without case and outer white space; documents of other
  sources, or without a source, are left out;
* a source without usable documents can't give its share; it gives nothing and
  the other shares keep their proportions;
* a target without a positive share, or with fewer than one use, gives nothing;
  a missing number of uses is one; a source named twice has the sum of its
  shares and the larger number of uses;
* documents without tokens (empty or null texts) are never chosen;
* rows that repeat an id are one document, the one of the smallest source and
  length; documents without an id are left out;
* no documents or no targets give an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.llm.bpe import VOCABULARY
from sagekeep.llm.encoding import count_tokens
from sagekeep.runtime import materialise, strip

SEED = 17
#: Tokens that the knapsack may rearrange; a larger number makes an exact fit likelier.
ROOM = 20_000


def even_take(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """About the same part of every length, longest first, never more than ``budget`` tokens in all."""
    take = np.zeros(len(lengths), np.int64)
    part, due = budget / max(1, int((lengths * counts).sum())), 0.0
    for i in np.argsort(-lengths, kind="stable"):
        due += part * counts[i] * lengths[i]
        take[i] = max(0, min(counts[i], int(due + 1e-6) // int(lengths[i])))
        due -= take[i] * lengths[i]
    while (over := int((take * lengths).sum()) - budget) > 0:  # rounding of a float sum
        i = next(i for i in range(len(lengths)) if take[i] and (lengths[i] >= over or i == len(lengths) - 1))
        take[i] -= 1
    return take


def knapsack(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """How many of each length to take so that their sum is ``target``, or as near below it as can be."""
    take = np.zeros(len(lengths), np.int64)
    if target <= 0:
        return take
    items: list[tuple[int, int]] = []
    reached, by = np.zeros(target + 1, bool), np.full(target + 1, -1, np.int64)
    reached[0] = True
    for i in range(len(lengths)):
        left, size = min(int(counts[i]), target // int(lengths[i])), 1
        while left > 0:
            size = min(size, left)
            weight = size * int(lengths[i])
            if weight <= target:
                fresh = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
                by[fresh] = len(items)
                reached[fresh] = True
                items.append((i, size))
            left -= size
            size *= 2
        if reached[target]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, size = items[by[at]]
        take[i] += size
        at -= size * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int) -> tuple[int, np.ndarray]:
    """Whole passes over all documents, and how many documents of each length get one more use."""
    available = int((lengths * counts).sum())
    passes = min(repeats, budget // available) if available else 0
    rest = budget - passes * available
    if not available or passes == repeats or rest <= 0:
        return passes, np.zeros(len(lengths), np.int64)
    take = even_take(lengths, counts, rest)
    # Give back a few documents, so that the knapsack has room to meet the budget exactly.
    missing = rest - int((take * lengths).sum())
    for i in np.argsort(lengths, kind="stable"):
        if take[i] and missing + lengths[i] <= max(ROOM, 2 * int(lengths[i])):
            take[i] -= 1
            missing += int(lengths[i])
    return passes, take + knapsack(lengths, counts - take, missing)


def _budgets(totals: dict[str, int], targets: list, total: int | None) -> dict[str, tuple[int, int]]:
    """Tokens and most uses of each source that can give something."""
    wanted: dict[str, tuple[float, int]] = {}
    for row in targets:
        share, uses = row["target_share"] or 0.0, 1 if row["max_repeats"] is None else row["max_repeats"]
        if share > 0 and uses >= 1 and totals.get(row["source"]):
            old = wanted.get(row["source"], (0.0, 1))
            wanted[row["source"]] = (old[0] + share, max(old[1], uses))
    whole = sum(share for share, _ in wanted.values())
    size = min((totals[s] * uses * whole / share for s, (share, uses) in wanted.items()), default=0)
    size = size if total is None else min(size, total)
    return {s: (min(totals[s] * u, int(size * share / whole + 1e-6)), u) for s, (share, u) in wanted.items()}


def mix(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    total: int | None = None,
    seed: int = SEED,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The chosen documents: id, source, n_tokens and uses.

    Only the targets and one total per target come to the driver.
    """
    spark = documents.sparkSession
    goals = targets.select(F.lower(strip("source")).alias("source"), "target_share", "max_repeats").filter(
        "source IS NOT NULL"
    )
    rows = goals.collect()
    names = sorted({r["source"] for r in rows})
    named = documents.select(
        F.col(id_col).alias("doc"), F.lower(strip(source_col)).alias("source"), F.col(text_col).alias("body")
    ).filter(F.col("source").isin(names) & F.col("doc").isNotNull())
    counted = (
        count_tokens(named, ["doc", "source"], "body")
        .groupBy("doc")
        .agg(F.min(F.struct("source", "n_tokens")).alias("d"))
        .select("doc", "d.source", "d.n_tokens")
        .filter("n_tokens > 0")
    )
    counted = materialise(counted.withColumn("draw", F.xxhash64(F.lit(seed), "doc")), "mix-counts")
    by_length = counted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    totals = by_length.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t")).collect()
    budgets = _budgets({r["source"]: r["t"] for r in totals}, rows, total)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        budget, repeats = budgets.get(pdf["source"].iat[0], (0, 1))
        lengths, counts = pdf["n_tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
        passes, extra = fit_budget(lengths, counts, budget, repeats)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": lengths, "passes": passes, "extra": extra})

    plan = by_length.groupBy("source").applyInPandas(fit, "source string, n_tokens long, passes long, extra long")
    plan = materialise(plan.filter("passes > 0 OR extra > 0"), "mix-plan")
    # A length may hold a great part of all documents: its draws are ranked in slices of their own.
    sliced = counted.join(plan, ["source", "n_tokens"]).withColumn("slice", F.shiftright("draw", 54))
    before = W.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        sliced.groupBy("source", "n_tokens", "slice")
        .agg(F.count(F.lit(1)).alias("docs"))
        .select("source", "n_tokens", "slice", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("before"))
    )
    rank = F.row_number().over(W.partitionBy("source", "n_tokens", "slice").orderBy("draw", "doc"))
    return (
        sliced.withColumn("rank", rank)
        .join(slices, ["source", "n_tokens", "slice"])
        .withColumn("uses", F.col("passes") + F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0))
        .filter("uses > 0")
        .select(F.col("doc").alias(id_col), "source", "n_tokens", "uses")
    )


def reached_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: what it should give and what it gives.

    source, target_share, max_repeats, documents, most_uses, tokens, share; a
    source that gives nothing has zeros. The total is formed over the targets,
    never over documents.
    """
    goals = (
        targets.select(F.lower(strip("source")).alias("source"), "target_share", "max_repeats")
        .filter("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    given = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("uses").alias("most_uses"),
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"),
    )
    filled = goals.join(given, "source", "left").fillna(0, ["documents", "most_uses", "tokens"])
    whole = F.sum("tokens").over(W.partitionBy(F.lit(1)))
    return filled.withColumn("share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)))
