"""One row for each claim: what it states, what was found, and a verdict that keeps both apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text as X

#: Puffery of full weight, hedging of full weight, the gap from which a contradicted claim is called so.
PUFFERY_FULL, HEDGING_FULL, DISAGREEMENT = 5.0, 5.0, 0.5


def inflation(specific: Column, puffery: Column, forward: Column) -> Column:
    """Mean of vagueness, puffery up to its full weight, and looking forward."""
    return ((1 - specific / 6) + F.least(puffery / PUFFERY_FULL, F.lit(1.0)) + F.when(forward, 1.0).otherwise(0.0)) / 3


def mean_of(parts: list[Column]) -> Column:
    """Mean of the parts that are known, null without any."""
    known = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known))


def evidence_gap(supports: Column, contradicts: Column, hedging: Column) -> Column:
    """How far what was found disagrees, null if nothing was: the contradicting share of the sides taken, and hedging above 0."""
    share = F.when(supports + contradicts > 0, contradicts / (supports + contradicts))
    return mean_of([share, F.when(hedging > 0, F.least(hedging / HEDGING_FULL, F.lit(1.0)))])


def verdict(gap: Column, contradicts: Column) -> Column:
    return F.when(gap.isNull(), "abstain").when((contradicts > 0) & (gap >= DISAGREEMENT), "contradicted").otherwise("consistent")


def claim_rows(claims: DataFrame, stances: DataFrame, hedging: DataFrame, forward: Column) -> DataFrame:
    """id, inflation, gap, checked, verdict. claims: (id, text); stances: (id, stance) of each agent; hedging: (id, hedging)."""
    sides = stances.groupBy("id").agg(F.count_if(F.col("stance") == "supports").alias("supports"), F.count_if(F.col("stance") == "contradicts").alias("contradicts"))
    out = claims.join(sides, "id", "left").join(hedging, "id", "left").fillna(0, ["supports", "contradicts"])
    loud = inflation(X.specificity_score(X.specificity(F.col("text"))), X.puffery_density("text"), forward)
    gap = evidence_gap(F.col("supports"), F.col("contradicts"), F.col("hedging"))
    out = out.select("id", F.round(loud, 4).alias("inflation"), F.round(gap, 4).alias("gap"), (F.col("supports") + F.col("contradicts")).alias("checked"), "contradicts")
    return out.select("id", "inflation", "gap", "checked", verdict(F.col("gap"), F.col("contradicts")).alias("verdict"))


def roll_up(rows: DataFrame, by: Column) -> DataFrame:
    """ledger, claims, abstained, contradicted, consistent, abstain_rate, evidence."""
    out = rows.groupBy(by.alias("ledger")).agg(F.count(F.lit(1)).alias("claims"), *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("abstain", "abstained"), ("contradicted", "contradicted"), ("consistent", "consistent"))], F.sum("checked").alias("evidence"))
    return out.withColumn("abstain_rate", F.round(F.col("abstained") / F.col("claims"), 3))
