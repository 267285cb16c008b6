"""Vector similarity as an expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_score(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2))
