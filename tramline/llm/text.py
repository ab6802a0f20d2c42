"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lower-cased and every other character as it is.

    lower() is much faster than translate(); it is right where no character beyond ASCII has a
    lower-case form, so only the other texts are translated.
    """
    other_case = text.rlike(r"[\P{ASCII}&&[\p{IsUppercase}\p{Lt}]]")
    return F.when(other_case, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for rows whose label no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
