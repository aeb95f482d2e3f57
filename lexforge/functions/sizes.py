"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows to be broadcast; ValueError where there are more than so many of them."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what} in a batch: split it")
    return F.broadcast(rows)
