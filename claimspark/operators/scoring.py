"""Scores of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.operators.calibration import LEAST, LEAST_CLASS, curve

MISSING = "__MISSING__"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def precision_recall(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall (null where undefined) from (y, p), 0 or 1."""
    y, p = F.col("y") == 1, F.col("p") == 1
    out = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    return out.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def brier_nll(rows: DataFrame, clip: float = 1e-12) -> DataFrame:
    """n, brier, nll from (y, score)."""
    y, s = F.col("y"), F.least(F.greatest(F.col("score"), F.lit(clip)), F.lit(1 - clip))
    nll = -F.avg(y * F.log(s) + (1 - y) * F.log(1 - s))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("score") - y, 2)).alias("brier"), nll.alias("nll"))


def align(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every gold row with its prediction, MISSING where there is none, so that it stays in the denominator."""
    return gold.join(predictions, key, "left").withColumn("prediction", F.coalesce("prediction", F.lit(MISSING)))


def confusion(rows: DataFrame) -> DataFrame:
    """gold, prediction, n."""
    return rows.groupBy("gold", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """label, precision, recall, f1 (0 where undefined), support from (gold, prediction)."""
    c = confusion(rows)
    sides = c.select(F.col("gold").alias("label"), F.col("n").alias("support"), F.when(F.col("gold") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).alias("made"))
    made = c.select(F.col("prediction").alias("label"), F.lit(0).alias("support"), F.lit(0).alias("hit"), F.col("n").alias("made"))
    total = sides.unionByName(made).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("support", "hit", "made")]).where(F.col("label") != MISSING)
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = total.select("label", zero(F.col("hit"), F.col("made")).alias("precision"), zero(F.col("hit"), F.col("support")).alias("recall"), F.col("support"))
    p, r = F.col("precision"), F.col("recall")
    return out.select("label", "precision", "recall", zero(2 * p * r, p + r).alias("f1"), "support")


def reliability(rows: DataFrame, bands: int = 5) -> DataFrame:
    """band, mean_score, rate, n of equal bands of the score; the last holds 1, empty ones are left out."""
    band = F.lit(bands - 1)
    for i in range(bands - 2, -1, -1):
        band = F.when(F.col("score") < (i + 1) / bands, i).otherwise(band)
    return rows.groupBy(band.alias("band")).agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))


def selective(rows: DataFrame, accept: Column) -> DataFrame:
    """attempted, accepted, coverage, error among the accepted (null if none) from (y, p)."""
    wrong = (F.col("y") != F.col("p")).cast("double")
    out = rows.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(accept).alias("accepted"), F.avg(F.when(accept, wrong)).alias("error"))
    return out.select("attempted", "accepted", ratio(F.col("accepted"), F.col("attempted")).alias("coverage"), "error")


def isotonic(rows: DataFrame, least: int = LEAST, least_class: int = LEAST_CLASS) -> DataFrame:
    """(boundary, value) of a monotone calibration of (y, score); refuses too few outcomes or too few of a class."""
    return curve(rows, least, least_class).select("boundary", "value")
