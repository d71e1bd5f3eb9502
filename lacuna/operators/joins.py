"""Joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest relation that is ever broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when ``rows`` of ``row_bytes`` fit the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
