"""Scalar text functions of the memory store, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sagekeep.runtime import WHITESPACE, strip

#: Fixed value: ASCII punctuation that is cut from both ends of a normalised name.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EVIDENCE_LIMIT = 200


def normalise_content(column: Column | str, collapse: bool = True) -> Column:
    """Outer white space removed and, if ``collapse``, inner runs of it made one blank."""
    column = F.col(column) if isinstance(column, str) else column
    return strip(F.regexp_replace(column, f"[{WHITESPACE}]+", " ") if collapse else column)


def content_hash(column: Column | str, collapse: bool = True) -> Column:
    """SHA-256 of the normalised content, lower-case hex; null for a null content."""
    return F.sha2(normalise_content(column, collapse), 256)


def norm_key(name: Column | str, kind: Column | str) -> Column:
    """``KIND:name``: lower case, inner white space collapsed, then punctuation cut from both ends.

    Blanks that the cut exposes stay, as do punctuation marks inside the name.
    """
    name = F.col(name) if isinstance(name, str) else name
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.btrim(F.lower(normalise_content(name)), F.lit(PUNCTUATION)))


def preview(column: Column | str, length: int) -> Column:
    """The text itself, or its first ``length - 3`` characters and three dots where it is longer."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(column) > length, F.concat(F.substring(column, 1, length - 3), F.lit("..."))).otherwise(column)


def shortened(column: Column | str, length: int) -> Column:
    """The text itself, or its first ``length`` characters with three dots after them where it is longer."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(column) > length, F.concat(F.substring(column, 1, length), F.lit("..."))).otherwise(column)


def evidence(column: Column | str) -> Column:
    """Evidence of an edge, cut to its limit."""
    return preview(column, EVIDENCE_LIMIT)


def tail(column: Column | str, length: int) -> Column:
    """The text itself, or three dots and its last ``length - 3`` characters where it is longer."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(column) > length, F.concat(F.lit("..."), F.right(column, F.lit(length - 3)))).otherwise(column)


def entity_type(column: Column | str) -> Column:
    """An entity type as it is compared: upper case, trimmed."""
    return F.upper(strip(column))


def identifier(prefix: str, *parts: Column | str) -> Column:
    """A deterministic id: a prefix and a hash of what the record is made of."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
