"""Checks on what a model wrote or cited: quotes, figures, neighbours, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions import text as X


def values(text: Column | str) -> Column:
    """The numbers of a text as doubles."""
    return F.transform(X.number_tokens(text), lambda n: n.try_cast("double"))


def value_in_source(text: Column | str, value: Column) -> Column:
    """Whether a passage holds a figure."""
    return F.exists(values(text), lambda v: v == value)


def numbers_supported(text: Column | str, allowed: Column) -> Column:
    """Whether every number of a text is among the allowed ones."""
    return F.forall(values(text), lambda v: F.array_contains(allowed, v))


def citation_errors(items: DataFrame, spans: DataFrame) -> DataFrame:
    """id, error of (id, span, quote) whose span is not among (span, text), or whose quote is blank or not in it word for word."""
    found = items.join(spans.select("span", "text"), "span", "left")
    error = F.when(F.col("text").isNull(), "no such span").when(F.trim("quote") == "", "blank quote").when(~F.col("text").contains(F.col("quote")), "not a quote")
    return found.select("id", error.alias("error")).where("error is not null")


def neighbours(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, pos) next to a hit and not hits themselves; hits and spans: (doc, pos)."""
    beside = hits.select("doc", F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos")).distinct()
    return spans.select("doc", "pos").join(beside, ["doc", "pos"], "left_semi").join(hits.select("doc", "pos"), ["doc", "pos"], "left_anti")


def budgeted(calls: DataFrame, budget: float) -> DataFrame:
    """Adds status: run while the costs so far of the group are within the budget, then not_run; calls: (group, place, cost, ...)."""
    spent = F.sum("cost").over(W.partitionBy("group").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return calls.withColumn("status", F.when(spent <= budget, "run").otherwise("not_run"))


def differences_that_count(differs: Column, stated: dict[str, Column]) -> Column:
    """Of the bases on which evidence differs, those that count: metric, unit and period only if the claim states them, the others always."""
    drop = F.array_compact(F.array(*[F.when(~F.coalesce(F.trim(value) != "", F.lit(False)), F.lit(name)) for name, value in stated.items()]))
    return F.filter(differs, lambda d: ~F.array_contains(drop, d))


def log_loss(rows: DataFrame, labels: list[str], clip: float = 1e-15) -> DataFrame:
    """n, brier, log_loss of (gold, p: map of a share for each label)."""
    share = F.coalesce(F.element_at("p", F.col("gold")), F.lit(0.0))
    brier = F.lit(0.0)
    for x in labels:
        brier = brier + F.pow(F.coalesce(F.element_at("p", F.lit(x)), F.lit(0.0)) - (F.col("gold") == x).cast("double"), 2)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(brier).alias("brier"), F.avg(-F.log(F.greatest(share, F.lit(clip)))).alias("log_loss"))
