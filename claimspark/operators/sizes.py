"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df
