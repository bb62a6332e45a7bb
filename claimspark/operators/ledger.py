"""The evidence ledger: observations, units, log odds, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.text import family_key
from claimspark.operators.components import components

#: Fixed value: a question's cost is raised by this before its priority is worked out.
EPSILON = 0.5


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def provenance_groups(items: DataFrame) -> DataFrame:
    """group, members, first from (id, quote): equal wording is one observation."""
    return items.groupBy(family_key("quote").alias("group")).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))


def evidence_hash(groups: DataFrame) -> DataFrame:
    """claim, evidence_hash of the active (claim, group, version, active)."""
    text = F.when(F.col("active"), F.concat_ws(":", "group", "version"))
    return groups.groupBy("claim").agg(F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(text))), 256), 1, 16).alias("evidence_hash"))


def latest(events: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version; of equals the greatest row. Rows that repeat an event change nothing."""
    rest = [c for c in events.columns if c not in key and c != version]
    best = events.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("v"))
    return best.select(*key, *[F.col(f"v.{c}").alias(c) for c in (version, *rest)])


def accumulate(scores: DataFrame, prior: float, tempering: float = 1.0) -> DataFrame:
    """claim, units, log_odds, probability from (claim, unit, log_evidence, weight); null unless every unit has a score."""
    total = F.sum(F.col("weight") * F.col("log_evidence"))
    full = F.count("log_evidence") == F.count(F.lit(1))
    odds = F.when(full, logit(F.lit(prior)) + tempering * total)
    out = scores.groupBy("claim").agg(F.count(F.lit(1)).alias("units"), odds.alias("log_odds"))
    return out.withColumn("probability", sigmoid(F.col("log_odds")))


def history(scores: DataFrame, prior: float) -> DataFrame:
    """Running probability of each claim by place, its predecessor and the change, from (claim, place, log_evidence)."""
    w = W.partitionBy("claim").orderBy("place")
    running = logit(F.lit(prior)) + F.sum("log_evidence").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = scores.withColumn("value", sigmoid(running))
    out = out.withColumn("before", F.coalesce(F.lag("value").over(w), F.lit(prior)))
    return out.withColumn("change", F.col("value") - F.col("before"))


def gate(evidence: DataFrame, proposed: str) -> DataFrame:
    """claim, status from (claim, proposed, relationship, comparable, active): a verdict stands only on comparable active evidence in its direction."""
    usable = F.col("comparable") & F.col("active")
    out = evidence.groupBy("claim").agg(
        F.max(proposed).alias("proposed"),
        F.coalesce(F.bool_or(usable & (F.col("relationship") == "supports")), F.lit(False)).alias("supports"),
        F.coalesce(F.bool_or(usable & (F.col("relationship") == "contradicts")), F.lit(False)).alias("contradicts"),
    )
    p = F.col("proposed")
    fails = ((p == "supported") & ~F.col("supports")) | ((p == "contradicted") & ~F.col("contradicts"))
    return out.select("claim", "proposed", F.when(fails, "insufficient").otherwise(p).alias("status"))


def majority(votes: DataFrame) -> DataFrame:
    """claim, status, n: the commonest status, of equals the one seen first, from (claim, place, status)."""
    counted = votes.groupBy("claim", "status").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    best = counted.groupBy("claim").agg(F.max(F.struct("n", -F.col("place"), "status")).alias("b"))
    return best.select("claim", F.col("b.status").alias("status"), F.col("b.n").alias("n"))


def priority(materiality: Column, open_: Column, answerability: Column, cost: Column) -> Column:
    return materiality * F.when(open_, 1.0).otherwise(0.0) * answerability / (cost + EPSILON)


def after_withdrawals(admitted: DataFrame, withdrawn: DataFrame, key: list[str]) -> DataFrame:
    """What is left of the admitted items."""
    return admitted.join(withdrawn.select(*key).distinct(), key, "left_anti")


def units(edges: DataFrame) -> DataFrame:
    """unit, members, key: groups that calculations read together, joined over any number of steps; edges: (a, b)."""
    label = components(edges)
    return label.groupBy(F.col("label").alias("unit")).agg(F.count(F.lit(1)).alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "+"), 256).alias("key"))
