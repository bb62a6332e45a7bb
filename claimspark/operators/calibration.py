"""Scores as probabilities: a monotone curve through outcomes, by pooling neighbours whose means are out of order.

Outcomes of one score are one block of (lowest and highest score, sum, number). Blocks of a range of scores are pooled in their task, in order, and what is left of all
ranges is pooled again: a block of a range that has been pooled is a block like any other, so this gives the curve of one pass over all outcomes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators.sizes import BROADCAST_ROWS

#: Outcomes that a curve needs, and of each kind.
LEAST, LEAST_CLASS = 30, 5
BLOCK = "lo double, hi double, total double, n long"


class TooFewOutcomes(ValueError):
    """There is too little to fit a curve on."""


def pooled(blocks: Iterable[tuple[float, float, float, int]]) -> list[tuple[float, float, float, int]]:
    """Blocks in order of score, neighbours joined until their means rise."""
    out: list[tuple[float, float, float, int]] = []
    for lo, hi, total, n in blocks:
        while out and out[-1][2] * n >= total * out[-1][3]:
            first, _, before, many = out.pop()
            lo, total, n = first, before + total, n + many
        out.append((lo, hi, total, n))
    return out


def curve(rows: DataFrame, least: int = LEAST, least_class: int = LEAST_CLASS) -> DataFrame:
    """boundary, value, n of a monotone calibration of (score, y): both ends of each block of scores, its share of ones and its outcomes.

    Rows without a score or an outcome (0 or 1) are left out. Raises TooFewOutcomes where there are fewer than `least`, or fewer than `least_class` of a kind. Blocks rise
    strictly; a block of one score has one row.
    """
    known = rows.select(F.col("score").cast("double").alias("score"), F.col("y").cast("double").alias("y")).where("score is not null and not isnan(score) and y is not null")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("ones")).first()
    if n["n"] < least or min(n["ones"], n["n"] - n["ones"]) < least_class:
        raise TooFewOutcomes(f"{n['n']} outcomes, {n['ones']:.0f} of them ones: a curve needs {least}, and {least_class} of each kind")
    each = known.groupBy("score").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("score").alias("lo"), F.col("score").alias("hi"), "total", "n")

    def pool(batches: Iterator) -> Iterator:
        import pandas as pd

        yield pd.DataFrame(pooled(tuple(r) for batch in batches for r in batch.itertuples(index=False)), columns=["lo", "hi", "total", "n"])

    ranged = each.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(pool, BLOCK)
    whole = ranged.coalesce(1).sortWithinPartitions("lo").mapInPandas(pool, BLOCK)  # some cube root of the outcomes is left of them, as a rule
    ends = F.array_distinct(F.array("lo", "hi"))
    return whole.select(F.explode(ends).alias("boundary"), (F.col("total") / F.col("n")).alias("value"), "n")


def probabilities(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """scores with `probability`: the curve's value at the score, between two boundaries by a straight line, beyond the ends that of the end; null for no score.

    A curve goes to every task, so one of more than BROADCAST_ROWS boundaries is refused; it would have as many blocks of outcomes.
    """
    points = sorted((r["boundary"], r["value"]) for r in fitted.select("boundary", "value").limit(BROADCAST_ROWS + 1).collect())
    if len(points) > BROADCAST_ROWS:
        raise ValueError("the curve has too many boundaries")

    @F.pandas_udf("double")
    def at(score):
        import numpy as np
        import pandas as pd

        x = score.to_numpy(float)
        return pd.Series(np.interp(x, [p[0] for p in points], [p[1] for p in points]))

    score = F.col("score").cast("double")
    return scores.withColumn("probability", F.when(score.isNotNull() & ~F.isnan(score), at(F.coalesce(score, F.lit(0.0)))))
