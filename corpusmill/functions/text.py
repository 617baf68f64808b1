"""Scalar text functions, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.config import MAX_CHARS, MIN_CHARS

# Every code point that counts as white space when text is split.
LOW_SPACES = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
HIGH_SPACES = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# One range over all of HIGH_SPACES; texts without any such character, nearly all, are
# matched against the low spaces alone, which is about four times as fast.
HIGH_RANGE = r"[\u1680-\u3000]"


def length_ok(text: Column) -> Column:
    """Length in code points strictly between the two limits; null and empty fail."""
    size = F.length(text)
    return F.coalesce((size > MIN_CHARS) & (size < MAX_CHARS), F.lit(False))


def normalize(text: Column) -> Column:
    """Lower-case, collapse white space runs to one space, trim; null stays null."""
    lowered = F.lower(text)
    collapsed = F.when(
        text.rlike(HIGH_RANGE), F.regexp_replace(lowered, f"[{LOW_SPACES}{HIGH_SPACES}]+", " ")
    ).otherwise(F.regexp_replace(lowered, f"[{LOW_SPACES}]+", " "))
    return F.trim(collapsed)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(text, 256))
