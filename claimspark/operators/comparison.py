"""Figures of outputs against those of documents and references, within a tolerance, as joins on bands.

A number's band is its size in tolerances, rounded down: numbers of one band are near each other, those of a neighbouring one may be, all others aren't. So of a band
only its least and greatest number count, and what a number is near to is found by one join on its band: no pairs of numbers, however many of a document share a
band. Numbers are decimals, so that a difference of just the tolerance is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.operators.answers import RATIO_UNITS

#: How near a number must be, as so many to a unit, and identifiers whose digits are no figures.
PER_UNIT, IDENTIFIERS = 20, r"doc-[0-9a-f]{16}(?:-s\d+)?"
NUMBER = "decimal(30,8)"


def numbers(rows: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """(keep…, number): the distinct numbers written in the texts. Identifiers of passages hold none; a number of over 22 digits before the point is left out."""
    written = X.number_tokens(F.regexp_replace(F.coalesce(text, F.lit("")), IDENTIFIERS, " "))
    return rows.select(*keep, F.explode(written).alias("written")).select(*keep, F.col("written").try_cast(NUMBER).alias("number")).where("number is not null").distinct()


def with_near(rows: DataFrame, others: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows (on…, number, …) with `name`: whether one of the others (on…, number) is near the number, signs aside; false for a null number."""
    band = lambda c: F.floor(F.abs(F.col(c)) * PER_UNIT).cast("decimal(38,0)")
    size = others.where("number is not null").select(*on, band("number").alias("__band"), F.abs("number").alias("n")).groupBy(*on, "__band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    null = F.lit(None).cast(NUMBER)
    seen = lambda step, same, below, above: F.struct(F.lit(step).alias("step"), F.lit(same).alias("same"), below.alias("below"), above.alias("above"))
    # A band is told to itself, its greatest number to the band above it and its least to the one below.
    told = F.array(seen(0, True, null, null), seen(1, False, F.col("hi"), null), seen(-1, False, null, F.col("lo")))
    at = size.select(*on, "__band", F.explode(told).alias("t")).select(*on, (F.col("__band") + F.col("t.step")).cast("decimal(38,0)").alias("__band"), "t.same", "t.below", "t.above")
    at = at.groupBy(*on, "__band").agg(F.max("same").alias("__same"), F.max("below").alias("__below"), F.min("above").alias("__above"))
    own = F.abs(F.col("number"))
    near = F.col("__same") | (own - F.col("__below") <= F.lit(1) / F.lit(PER_UNIT).cast("decimal(4,0)")) | (F.col("__above") - own <= F.lit(1) / F.lit(PER_UNIT).cast("decimal(4,0)"))
    return rows.withColumn("__band", band("number")).join(at, [*on, "__band"], "left").withColumn(name, F.coalesce(near, F.lit(False))).select(*rows.columns, name)


def computed_forms(computed: DataFrame) -> DataFrame:
    """case, arm, number of (case, arm, value, unit): a computed share of 1 counts in percent too."""
    value = F.regexp_replace(F.col("value"), r"[^0-9.\-]", "").try_cast(NUMBER)
    share = F.lower(F.trim(F.coalesce("unit", F.lit("")))).isin(*RATIO_UNITS)
    forms = F.when(share, F.array(value, (value * 100).cast(NUMBER))).otherwise(F.array(value))
    return computed.select("case", "arm", F.explode(forms).alias("number")).where("number is not null").distinct()


def key_numbers(keys: DataFrame, outputs: DataFrame, computed: DataFrame, passages: DataFrame) -> DataFrame:
    """case, arm, key_numbers, found: how many of a case's key numbers (case, number) an arm's output (case, arm, text) reached.

    A key number is reached where a computed one (case, arm, value, unit) is near it, or where the text states one near it and no passage (case, text) of the case's documents does:
    restating isn't calculating. Outputs without a text, and cases without keys, count none.
    """
    arms = outputs.select("case", "arm").distinct()
    rows = arms.join(keys.where("number is not null").select("case", F.col("number").cast(NUMBER).alias("number")).distinct(), "case")
    rows = with_near(rows, numbers(passages, ["case"], F.col("text")), ["case"], "held")
    rows = with_near(rows, computed_forms(computed), ["case", "arm"], "made")
    rows = with_near(rows, numbers(outputs, ["case", "arm"], F.col("text")), ["case", "arm"], "stated")
    got = rows.groupBy("case", "arm").agg(F.count(F.lit(1)).alias("key_numbers"), F.count_if(F.col("made") | (F.col("stated") & ~F.col("held"))).alias("found"))
    return arms.join(got, ["case", "arm"], "left").select("case", "arm", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("key_numbers", "found")])


def unverified(outputs: DataFrame, passages: DataFrame, references: DataFrame) -> DataFrame:
    """case, arm, number: what outputs state that is near no number of the case's passages, nor near a reference (case, number) or a hundredth of one."""
    known = references.where("number is not null").select("case", F.col("number").cast(NUMBER).alias("n")).select("case", F.explode(F.array(F.col("n"), (F.col("n") / 100).cast(NUMBER))).alias("number"))
    stated = numbers(outputs, ["case", "arm"], F.col("text"))
    rows = with_near(stated, numbers(passages, ["case"], F.col("text")).unionByName(known), ["case"], "known")
    return rows.where("not known").select("case", "arm", "number")
