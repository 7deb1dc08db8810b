"""Instants from ISO-8601 strings; a string without an offset is no instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a date-time with a mandatory offset.
ISO_OFFSET = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})\s*$"


def instant(col: Column | str) -> Column:
    """UTC timestamp of an ISO-8601 string; null for null, broken or offset-less strings."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.trim(c), ",", ".")
    return F.when(c.rlike(ISO_OFFSET), F.try_to_timestamp(F.upper(text)))
