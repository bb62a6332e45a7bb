"""Running totals that no single task has to make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import materialize


def running_totals(df: DataFrame, key: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums (name: column): the total of the column over the key's rows so far, in order.

    Rows are range-partitioned by key and order, so the rows of a key that holds a third of all are in many ranges. Each range
    totals its own part of a key, the totals before each range are summed over the ranges, and a window inside the range does the rest.
    """
    ranged = materialize(df.repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id()), "running")
    parts = ranged.groupBy(key, "__range").agg(*[F.sum(c).alias(f"__of_{name}") for name, c in sums.items()])
    earlier = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(key, "__range", *[F.coalesce(F.sum(f"__of_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums])
    inside = W.partitionBy(key, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.join(broadcast_if_small(before), [key, "__range"])
    return out.withColumns({name: F.sum(c).over(inside) + F.col(f"__before_{name}") for name, c in sums.items()}).drop("__range", *[f"__before_{name}" for name in sums])
