"""Entries of catalog listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean, strip

_ENTRY = r"^[-*]\s+\**\[([^\]]+)\]\(([^)]+)\)\**\s*[-–—:]*\s*(.*)"


def parse_listing(docs: DataFrame, text: str = "text") -> DataFrame:
    """``- [name](url) - description`` entries; images and anchors are dropped."""
    keep = [c for c in docs.columns if c != text]
    lines = F.filter(F.split(clean(F.col(text)), "\n"), lambda l: l.rlike(_ENTRY))
    rows = docs.select(*keep, F.explode(lines).alias("_l")).select(
        *keep, strip(F.regexp_extract("_l", _ENTRY, 1)).alias("name"), strip(F.regexp_extract("_l", _ENTRY, 2)).alias("url"),
        strip(F.regexp_replace(F.regexp_extract("_l", _ENTRY, 3), r"^\s*[-–—:]+\s*", "")).alias("description"),
    )
    return rows.where(~F.col("url").rlike(r"(?i)\.(png|jpg|svg|gif)$") & ~F.col("url").startswith("#"))
