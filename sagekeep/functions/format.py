"""Results as text blocks; only the few rows of a result are joined to one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagekeep.functions.scores import age_label
from sagekeep.functions.text import shortened

#: What an empty result says, and what stands between the blocks of a recall and of a search.
NOTHING, RULE, GAP = "No memories found.", "\n\n---\n\n", "\n\n"
#: The lines of a search block, and its times.
SEARCH_BLOCK, SEARCH_TIME = "ID: %s\nScore: %.4f\nCreated: %s\nContent: %s", "yyyy-MM-dd HH:mm:ss 'UTC'"


def search_block() -> Column:
    """Id, score, time (of a session that reads times as UTC) and the first 100 characters of a found memory."""
    created = F.coalesce(F.date_format("created_at", SEARCH_TIME), F.lit("unknown"))
    return F.format_string(SEARCH_BLOCK, "id", "score", created, F.coalesce(shortened("content", 100), F.lit("")))


def recall_block(moment: Column) -> Column:
    """A memory with its score, age and stability."""
    head = F.format_string("(score=%.4f, age=%s, stability=%s)", "score", age_label("created_at", moment), "temporal_stability")
    return F.concat_ws("\n", head, "content")


def explained_block(moment: Column) -> Column:
    """A memory with what raised or lowered its score; parts that changed nothing are left out."""
    parts = [
        F.format_string("similarity %.4f", "similarity"),
        F.when(F.col("reinforcement") > 1, F.format_string("reinforced %d times x%.3f", "reinforcements", "reinforcement")),
        F.when(F.col("boost") > 1, F.format_string("%d connections x%.3f", "degree", "boost")),
        F.when(F.col("confidence") < 1, F.format_string("%s, aged x%.3f", "temporal_stability", "confidence")),
    ]
    return F.concat_ws("\n", recall_block(moment), F.concat(F.lit("because: "), F.concat_ws("; ", *parts)))


def as_text(found: DataFrame, block: Column, rule: str = RULE) -> str:
    """The blocks of a limited result, best first."""
    rows = found.select(block.alias("block"), "score", "id").orderBy(F.desc("score"), "id").collect()
    return rule.join(r.block for r in rows) or NOTHING
