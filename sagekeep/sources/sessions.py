"""Session files: format detection, roles and blocks of messages, and conversation texts.

Lines are JSON objects; parsing is done with variants in the JVM, so lines of any
shape stay in the plan. A line that is no JSON is skipped, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagekeep.functions.text import tail
from sagekeep.runtime import strip

SEPARATOR = "\n\n"


@dataclass(frozen=True)
class SessionConfig:
    roles: tuple[str, ...] = ("user", "assistant")
    block_types: tuple[str, ...] = ("text",)
    drop_thinking: bool = True
    drop_tools: bool = True


def _field(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "string")


def parsed_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """The lines with ``document`` (null where it is no JSON object), ``role`` and ``stamp``.

    The role is that of the message where there is one, else the line's type.
    """
    document = F.try_parse_json(line)
    kind = F.when(F.schema_of_variant("document").startswith("OBJECT"), F.col("document"))
    return (
        lines.withColumn("document", document)
        .withColumn("document", kind)
        .withColumn("role", F.lower(strip(F.coalesce(_field(F.col("document"), "$.message.role"), _field(F.col("document"), "$.type")))))
        .withColumn("stamp", iso_moment(_field(F.col("document"), "$.timestamp")))
    )


def iso_moment(column: Column) -> Column:
    """A timestamp in UTC; one without a zone is read as UTC, an unreadable one is null."""
    return F.when(column.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(column))


def message_texts(parsed: DataFrame, key: list[str], config: SessionConfig = SessionConfig()) -> DataFrame:
    """``key``, role and text of each line that says something.

    A string content is the text itself; of a list the strings and the blocks of
    allowed types are kept, blocks without a type too, blanks trimmed, empty ones
    dropped. Thinking and tool blocks are dropped whatever the allowed types.
    """
    content = F.coalesce(
        F.try_variant_get("document", "$.message.content", "variant"), F.try_variant_get("document", "$.content", "variant")
    )
    rows = parsed.filter(F.col("role").isin(*config.roles)).withColumn("content", content)
    shape = F.schema_of_variant("content")
    items = F.when(shape == "STRING", F.array("content")).when(shape.startswith("ARRAY"), F.try_variant_get("content", "$", "array<variant>"))
    listed = rows.select(*key, "role", F.posexplode(items).alias("at", "block"))
    kind = _field(F.col("block"), "$.type")
    dropped = F.lit(False)
    if config.drop_thinking:
        dropped |= kind == "thinking"
    if config.drop_tools:
        dropped |= kind.isin("tool_use", "tool_result")
    allowed = kind.isNull() | (kind.isin(*config.block_types) & ~dropped)
    text = F.when(F.schema_of_variant("block") == "STRING", _field(F.col("block"), "$")).otherwise(_field(F.col("block"), "$.text"))
    blocks = listed.filter(F.coalesce(allowed, F.lit(True))).select(*key, "role", "at", strip(text).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    said = blocks.filter("text <> ''").groupBy(*key, "role")
    return said.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def lines_once(parsed: DataFrame) -> DataFrame:
    """Each line of a session once by its uuid, the one with the smallest line_id; lines without a uuid all stay."""
    uuid = F.to_json(F.try_variant_get("document", "$.uuid", "variant"))
    name = F.when(uuid.isNull() | uuid.isin("null", '""'), F.concat(F.lit("line "), F.col("line_id"))).otherwise(F.concat(F.lit("uuid "), uuid))
    rank = F.row_number().over(W.partitionBy("session_id", "name").orderBy("line_id"))
    return parsed.withColumn("name", name).withColumn("rank", rank).filter("rank = 1").drop("name", "rank")


def session_blocks(lines: DataFrame, config: SessionConfig = SessionConfig(), by_uuid: bool = True) -> DataFrame:
    """session_id, line_id, block, stamp: one ``role: text`` block for each line that counts.

    Lines sent again count once by their id, and with ``by_uuid`` also once by
    their uuid, as they may come again under a new id.
    """
    once = lines.filter("raw_line IS NOT NULL AND line_id IS NOT NULL").dropDuplicates(["session_id", "line_id"])
    parsed = parsed_lines(once).filter("document IS NOT NULL")
    parsed = lines_once(parsed) if by_uuid else parsed
    texts = message_texts(parsed, ["session_id", "line_id", "stamp"], config)
    return texts.select("session_id", "line_id", F.concat_ws(": ", "role", "text").alias("block"), "stamp")


def session_texts(blocks: DataFrame) -> DataFrame:
    """session_id, text, blocks: the blocks of a session in the order of their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_id", "block")))
    return blocks.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), SEPARATOR).alias("text"), F.count(F.lit(1)).alias("blocks")
    )


def earliest_stamps(lines: DataFrame) -> DataFrame:
    """session_id, earliest: the first readable timestamp of any line, whatever its role."""
    parsed = parsed_lines(lines.filter("raw_line IS NOT NULL"))
    return parsed.groupBy("session_id").agg(F.min("stamp").alias("earliest"))


def detected_formats(lines: DataFrame) -> DataFrame:
    """session_id, format: ``session`` if a line with a known role comes before any line that is no JSON, else ``plain``."""
    parsed = parsed_lines(lines.filter("raw_line IS NOT NULL")).filter(strip("raw_line") != "")
    broken = F.min(F.when(F.try_parse_json("raw_line").isNull(), F.col("line_id")))
    spoken = F.min(F.when(F.col("role").isin("user", "assistant"), F.col("line_id")))
    found = parsed.groupBy("session_id").agg(broken.alias("broken"), spoken.alias("spoken"))
    is_session = F.col("spoken").isNotNull() & (F.col("broken").isNull() | (F.col("spoken") < F.col("broken")))
    return found.select("session_id", F.when(is_session, "session").otherwise("plain").alias("format"))


def recall_queries(texts: DataFrame, length: int = 500) -> DataFrame:
    """session_id, query: the end of a conversation as a query text."""
    return texts.select("session_id", tail("text", length).alias("query"))


def conversation_texts(inputs: DataFrame, key: str, text: str = "text", config: SessionConfig = SessionConfig()) -> DataFrame:
    """key, text of what a recall is asked with: plain texts as they are, JSON arrays of messages as the blocks they hold.

    A message is an object with role and content, as a session line has them. An
    array without any message that says something gives no row; a null text none.
    """
    messages = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    parsed = inputs.filter(F.col(text).isNotNull()).withColumn("messages", messages)
    plain = parsed.filter("messages IS NULL").select(key, F.col(text).alias("text"))
    each = parsed.filter("messages IS NOT NULL").select(F.col(key).alias("session_id"), F.posexplode("messages").alias("line_id", "document"))
    role = F.coalesce(_field(F.col("document"), "$.message.role"), _field(F.col("document"), "$.role"), _field(F.col("document"), "$.type"))
    said = message_texts(each.withColumn("role", F.lower(strip(role))), ["session_id", "line_id"], config)
    blocks = said.select("session_id", "line_id", F.concat_ws(": ", "role", "text").alias("block"))
    return plain.unionByName(session_texts(blocks).select(F.col("session_id").alias(key), "text"))


def read_documents(spark, paths: list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path, text, modified of whole files, by Spark's binary source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(paths)
    return rows.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def text_lines(documents: DataFrame) -> DataFrame:
    """path, line_id, raw_line of whole texts."""
    return documents.select("path", F.posexplode(F.split("text", "\r\n|\n")).alias("line_id", "raw_line"))


def latest_version_per_path(documents: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("modified")))
    return documents.withColumn("rank", rank).filter("rank = 1").drop("rank")
