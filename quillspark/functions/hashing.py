"""The partition number of hashed loads: one expression for Spark, and its twin in Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.partition import IntRange


def hashed(column: Column, scheme: IntRange) -> Column:
    """The first 56 bits of the SHA-256 of the text, modulo the range's end; a null counts as empty."""
    digest = F.sha2(F.coalesce(column.cast("string"), F.lit("")).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % F.lit(scheme.end)).cast("long")


def hashed_value(text: str | None, scheme: IntRange) -> int:
    return int(hashlib.sha256((text or "").encode()).hexdigest()[:14], 16) % scheme.end
