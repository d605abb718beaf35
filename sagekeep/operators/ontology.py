"""Entity types as a small table: loading, lookups, and a check of types that doesn't refuse any."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagekeep.functions.text import entity_type

SCHEMA = "name string, description string, tier int, synonyms array<string>, examples array<string>"


@dataclass(frozen=True)
class Ontology:
    """Types by name; names and synonyms are compared in upper case, trimmed."""

    types: tuple[tuple, ...]

    @classmethod
    def of(cls, items: list) -> Ontology:
        """From names alone, or from objects with name and description, and perhaps tier, synonyms and examples."""
        rows: dict[str, tuple] = {}
        for item in items:
            entry = {"name": item} if isinstance(item, str) else dict(item)
            name = str(entry.get("name") or "").strip().upper()
            if not name:
                raise ValueError(f"a type without a name: {item!r}")
            if name in rows:
                raise ValueError(f"{name} stands twice")
            words = [[str(x) for x in entry.get(k) or []] for k in ("synonyms", "examples")]
            rows[name] = (name, entry.get("description") or "", int(entry.get("tier", 2)), *words)
        return cls(tuple(rows.values()))

    @classmethod
    def load(cls, path: str | Path) -> Ontology:
        return cls.of(json.loads(Path(path).read_text()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.types), SCHEMA)

    def names(self, tier: int | None = None) -> list[str]:
        return [t[0] for t in self.types if tier is None or t[2] == tier]

    def example_types(self) -> dict[str, str]:
        """Examples to types: what the rule extractor can look up."""
        return {example: t[0] for t in self.types for example in t[4]}


def checked_types(rows: DataFrame, ontology: Ontology, column: str = "entity_type") -> DataFrame:
    """``rows`` with ``resolved_type`` (a synonym's type, else the type itself) and ``is_known``."""
    types = ontology.frame(rows.sparkSession)
    words = types.select(F.col("name"), F.explode(F.array_distinct(F.concat(F.array("name"), F.transform("synonyms", lambda s: F.upper(F.trim(s)))))).alias("word"))
    first = words.groupBy(F.col("word").alias("__word")).agg(F.min("name").alias("__name"))
    marked = rows.withColumn("__word", entity_type(column)).join(first, "__word", "left")
    return marked.withColumn("resolved_type", F.coalesce("__name", "__word")).withColumn("is_known", F.col("__name").isNotNull()).drop("__word", "__name")
