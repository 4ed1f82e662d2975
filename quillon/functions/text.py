"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits, taken out before lower-casing; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: F.lower(x))


def clean(text: Column) -> Column:
    """White space runs as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
