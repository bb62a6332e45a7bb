"""Claims against filed facts and later events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import numbers as N
from claimspark.functions import text as X
from claimspark.functions import wording as V
from claimspark.session import materialize

#: Days that a quarter's and a year's fact may last; months in which a later event counts.
QUARTER_DAYS, YEAR_DAYS, MONTHS = (60, 120), (300, 400), 24


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim, filed, stance: each claim against the first fact of its company and tags that ends in its period and lasts as long.

    claims: (claim, company, period, stated, step, tags: array in order of preference); facts: (company, tag, start, end, value).
    """
    asked = claims.withColumn("w", N.period_window(F.col("period"))).select("*", F.posexplode_outer("tags").alias("preference", "tag"))
    lo, hi = (F.when(F.upper("period").rlike("Q[1-4]"), F.lit(a)).otherwise(F.lit(b)) for a, b in zip(QUARTER_DAYS, YEAR_DAYS))
    fits = F.col("end").between(F.col("w.lo"), F.col("w.hi")) & (F.col("start").isNull() | F.date_diff("end", "start").between(lo, hi))
    hit = asked.join(facts, ["company", "tag"]).where(fits)
    first = hit.groupBy("claim").agg(F.min_by("value", F.struct("preference", -F.unix_date(F.col("end").cast("date")), "value")).alias("filed"))
    close = F.abs(F.col("filed") - F.col("stated")) <= F.col("step")
    return claims.join(first, "claim", "left").select("claim", "filed", F.when(F.col("filed").isNull(), "not_found").when(close, "supports").otherwise("contradicts").alias("stance"))


def outcomes(calls: DataFrame, events: DataFrame, months: int = MONTHS) -> DataFrame:
    """claim, filed, months_after, status: the first event of the company in the months from the call. calls: (claim, company, day); events: (company, filed)."""
    hit = calls.join(events, "company").where(F.col("filed").between(F.col("day"), F.add_months("day", months)))
    first = hit.groupBy("claim").agg(F.min("filed").alias("filed"))
    out = calls.join(first, "claim", "left")
    return out.select("claim", "filed", N.months_between(F.col("day"), F.col("filed")).alias("months_after"), F.when(F.col("filed").isNull(), "not_found").otherwise("context").alias("status"))


#: Claims about what will be have nothing filed yet.
FORWARD = ("future_target", "policy_commitment")


def stated_value(value: Column, unit: Column) -> Column:
    """The one number that a claim states, times the first scale word of the value or else the unit; null if it
    states none, or several of which not exactly one is written as an amount (a currency sign or a scale word)."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    plain = lambda n: F.replace(n, F.lit(","), F.lit(""))
    figures = F.transform(X.found(raw, r"-?\d[\d,]*\.?\d*"), plain)
    amount = r"[$£€]\s*(-?\d[\d,]*\.?\d*)|(-?\d[\d,]*\.?\d*)\s*(?i:thousand|million|billion|trillion)"
    amounts = F.array_distinct(F.zip_with(F.regexp_extract_all(raw, F.lit(amount), F.lit(1)), F.regexp_extract_all(raw, F.lit(amount), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b)))
    of_several = N.bound_to(amounts, lambda a: F.when(F.size(a) == 1, plain(F.get(a, 0))))
    one = N.bound_to(figures, lambda f: F.when(F.size(F.array_distinct(f)) == 1, F.get(f, 0)).when(F.size(f) > 1, of_several))
    power = F.coalesce(F.nullif(N.scale(raw), F.lit(0)), N.scale(unit))
    return one.try_cast("double") * F.pow(F.lit(10.0), power)


def magnitude(x: Column) -> Column:
    """The place of the first digit; 0 for 0."""
    return F.when(x == 0, 0.0).otherwise(F.floor(F.log10(F.abs(x))).cast("double"))


def stated_step(value: Column, stated: Column) -> Column:
    """Half of the last digit written, at the stated number's magnitude."""
    first = F.replace(F.regexp_extract(F.coalesce(value, F.lit("")), r"-?\d[\d,]*\.?\d*", 0), F.lit(","), F.lit(""))
    written = lambda f: F.when(f != "", f.try_cast("double")).otherwise(stated)
    digits = lambda f: F.length(F.regexp_extract(f, r"\.(\d*)$", 1))
    return N.bound_to(first, lambda f: 0.5 * F.pow(F.lit(10.0), magnitude(stated) - magnitude(written(f)) - digits(f)))


def refusal(stated: Column, tags: Column, window: Column) -> Column:
    """Why a claim (text, metric, value, unit, assertion) with the number, tags and period made of it can't be held against a filed figure; null if it can."""
    wording = F.concat_ws(" ", F.coalesce("metric", F.lit("")), F.coalesce("text", F.lit("")))
    rated = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("value", "unit", "metric")])
    return (
        F.when(F.col("assertion").isin(*FORWARD), "future")
        .when(wording.rlike(V.ADJUSTED), "company-defined measure")
        .when(wording.rlike(V.SUBSET), "part of the company")
        .when(F.size(tags) == 0, "unknown metric")
        .when(rated.rlike(V.RATE), "rate of change")
        .when(stated.isNull(), "no number")
        .when(window.isNull(), "no period")
    )


def check(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim, stance, note, stated, tag, filed: claims (claim, company, text, metric, value, unit, assertion, period) against facts (company, tag, start, end, value).

    A claim that can't be held against a filed figure is not_found with the reason. The others are compared with the first fact of their tags, in order, that ends in
    the period and lasts as long (of several, the one that ends last), to the precision that they state.
    """
    made = claims.withColumns({"stated": stated_value(F.col("value"), F.col("unit")), "tags": V.tags_of(F.col("metric")), "w": N.period_window(F.col("period"))})
    noted = made.withColumn("note", refusal(F.col("stated"), F.col("tags"), F.col("w"))).withColumn("step", F.when(F.col("note").isNull(), stated_step(F.col("value"), F.col("stated"))))
    read = materialize(noted.select("claim", "company", "period", "note", "stated", "step", "tags", "w"), "claims-read")  # wording is read once
    asked = read.where("note is null").select("claim", "company", "period", "w", F.posexplode("tags").alias("preference", "tag"))
    lo, hi = (F.when(F.upper("period").rlike("Q[1-4]"), F.lit(a)).otherwise(F.lit(b)) for a, b in zip(QUARTER_DAYS, YEAR_DAYS))
    fits = F.col("end").between(F.col("w.lo"), F.col("w.hi")) & (F.col("start").isNull() | F.date_diff("end", "start").between(lo, hi))
    hit = asked.join(facts, ["company", "tag"]).where(fits)
    first = hit.groupBy("claim").agg(F.min(F.struct("preference", (-F.unix_date(F.col("end").cast("date"))).alias("age"), F.col("value").alias("filed"), "tag")).alias("f")).select("claim", "f.filed", "f.tag")
    out = read.join(first, "claim", "left")
    close = F.abs(F.col("filed") - F.col("stated")) <= F.col("step")
    stance = F.when(F.col("filed").isNull(), "not_found").when(close, "supports").otherwise("contradicts")
    return out.select("claim", stance.alias("stance"), F.coalesce("note", F.when(F.col("filed").isNull(), "nothing filed")).alias("note"), F.when(F.col("note").isNull(), F.col("stated")).alias("stated"), "tag", "filed")
