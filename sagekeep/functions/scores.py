"""Scores that depend on time and connections, as column expressions and one windowed operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000, 3_600_000_000


@dataclass(frozen=True)
class ScoreConfig:
    """Time constants in days, cool-down in hours."""

    tau_days: float = 21.0
    cooldown_hours: float = 24.0
    burst_discount: float = 0.2
    k: float = 0.35
    graph_k: float = 0.15
    graph_enabled: bool = True
    decay_enabled: bool = True
    dynamic_tau_days: float = 90.0
    ephemeral_tau_days: float | None = None
    enabled: bool = True

    @property
    def ephemeral_tau(self) -> float:
        return self.ephemeral_tau_days or max(3.0, min(7.0, self.dynamic_tau_days / 4))


DEFAULT = ScoreConfig()


def days_before(column: Column | str, moment: Column) -> Column:
    """Days from ``column`` to ``moment``, negative where it lies after."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.unix_micros(moment) - F.unix_micros(column)) / F.lit(float(DAY))


def reinforcement(events: DataFrame, moment: Column, config: ScoreConfig = DEFAULT) -> DataFrame:
    """memory_id, multiplier, reinforcements for each memory that has an event.

    An event weighs ``exp(-age / tau)``, less where it came within the cool-down of
    the next newer one. Weights of events after ``moment`` exceed 1.
    """
    newest_first = W.partitionBy("memory_id").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    newer = F.lag("occurred_at").over(newest_first)
    gap = (F.unix_micros(newer) - F.unix_micros("occurred_at")) / F.lit(float(HOUR))
    weight = F.exp(-days_before("occurred_at", moment) / F.lit(config.tau_days))
    discounted = F.when(gap < config.cooldown_hours, weight * config.burst_discount).otherwise(weight)
    total = 1 + F.lit(config.k) * F.log1p(F.sum("weight"))
    return (
        events.filter("memory_id IS NOT NULL AND occurred_at IS NOT NULL")
        .select("memory_id", discounted.alias("weight"))
        .groupBy("memory_id")
        .agg((total if config.enabled else F.lit(1.0)).alias("multiplier"), F.count(F.lit(1)).alias("reinforcements"))
    )


def graph_boost(degree: Column | str, config: ScoreConfig = DEFAULT) -> Column:
    """``1 + graph_k * log1p(degree)``; 1 without inbound edges or if switched off."""
    degree = F.col(degree) if isinstance(degree, str) else degree
    if not (config.enabled and config.graph_enabled):
        return F.lit(1.0)
    return F.when(degree > 0, 1 + F.lit(config.graph_k) * F.log1p(degree)).otherwise(F.lit(1.0))


def temporal_confidence(valid_from: Column | str, stability: Column | str, moment: Column, config: ScoreConfig = DEFAULT) -> Column:
    """How far a fact still holds: 1 for static, unknown, future and undated ones, else a decay not below 0.01.

    Labels other than static, unknown and ephemeral decay as dynamic ones; a null label counts as unknown.
    """
    valid_from = F.col(valid_from) if isinstance(valid_from, str) else valid_from
    stability = F.col(stability) if isinstance(stability, str) else stability
    if not config.decay_enabled:
        return F.lit(1.0)
    age = days_before(valid_from, moment)
    tau = F.when(stability == "ephemeral", config.ephemeral_tau).otherwise(config.dynamic_tau_days)
    holds = stability.isNull() | stability.isin("static", "unknown") | valid_from.isNull() | (age < 0)
    return F.when(holds, F.lit(1.0)).otherwise(F.greatest(F.lit(0.01), F.exp(-age / tau)))


def age_label(column: Column | str, moment: Column) -> Column:
    """A compact age: just now, minutes, hours, days, weeks or months; unknown without a time."""
    column = F.col(column) if isinstance(column, str) else column
    seconds = ((F.unix_micros(moment) - F.unix_micros(column)) / F.lit(1_000_000.0)).cast("double")
    part = lambda unit, sign: F.concat(F.floor(seconds / unit).cast("string"), F.lit(sign))
    return (
        F.when(column.isNull(), "unknown")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, part(60, "m"))
        .when(seconds < 86_400, part(3600, "h"))
        .when(seconds < 7 * 86_400, part(86_400, "d"))
        .when(seconds < 30 * 86_400, part(7 * 86_400, "w"))
        .otherwise(part(30 * 86_400, "mo"))
    )
