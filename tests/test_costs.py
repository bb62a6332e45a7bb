"""What a row costs: how often a plan searches a text, sorts or shuffles, as that decides how a query grows."""

import re

import pytest
from pyspark.sql import functions as F

from claimspark.functions import numbers as N
from claimspark.operators import verification
from claimspark.plans import catalogue
from claimspark.sources import html


def searches(df):
    """Searches by pattern in the optimized plan; one that is written twice is made twice."""
    return len(re.findall(r"regexp_\w+\(|rlike|RLIKE|split\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_a_bound_is_a_few_searches(spark, sf):
    assert searches(catalogue.QUERIES["claim_relation_bounds"](spark, sf)) <= 8


@pytest.mark.parametrize(
    "claim, kind",
    [
        ("no\n less  than 5", "ge"), ("not more than about 5", "le"), ("more than\n5", "plain"), ("9at least 5", "ge"), ("format least 5", "plain"), ("5 % units of it or more", "ge"), ("5 a b c d or more", "plain"),
        ("5 or so or more", "plain"), ("therefrom it is 5", "plain"), ("from it. It is 5", "plain"), ("from " + "x" * 38 + " 5", "range"), ("from " + "x" * 39 + " 5", "plain"), ("no number", "plain"), (None, "plain"),
    ],
)
def test_bounds_at_the_edges(spark, claim, kind):
    assert spark.range(1).select(N.bound(F.lit(claim).cast("string"), F.lit("5"))).first()[0] == kind


def test_wording_of_a_claim_is_read_once(spark, sf):
    """What check joins is read already; a stated number is a few searches of its value."""
    assert searches(catalogue.QUERIES["verify_guards"](spark, sf)) <= 4
    claims = spark.createDataFrame([("about 3 to $1,234.5 million", "USD")], "value string, unit string")
    read = claims.select(verification.stated_value(F.col("value"), F.col("unit")).alias("stated"))
    assert searches(read) <= 7 and read.first()["stated"] == 1234500000.0


@pytest.mark.parametrize("value, unit, stated, step", [("1,234", "", 1234.0, 0.5), ("$2.50 billion", "million", 2.5e9, 5e6), ("12 and 12", "thousand", 12000.0, 500.0), ("1 to 2", "million", None, None), ("5 of $3", "", 3.0, 0.5), ("", "", None, None), (None, None, None, None)])
def test_stated_numbers(spark, value, unit, stated, step):
    df = spark.createDataFrame([(value, unit)], "value string, unit string").withColumn("stated", verification.stated_value(F.col("value"), F.col("unit")))
    assert df.select("stated", verification.stated_step(F.col("value"), F.col("stated"))).first() == (stated, step)


def test_cells_are_shuffled_once_for_all_that_is_read_from_them(spark, sf):
    plan = catalogue.QUERIES["html_spans"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10


@pytest.mark.parametrize("pieces, characters", [(1, 10**6), (3, 10**6), (10**4, 10), (10**4, 10**6)])
def test_pages_share_batches(spark, monkeypatch, pieces, characters):
    """Where a batch ends changes nothing; ids of any type come through, and pages without text have no row."""
    monkeypatch.setattr(html, "PIECES", pieces)
    monkeypatch.setattr(html, "CHARACTERS", characters)
    page = "<p>One² two</p><table><caption>C</caption><tr><th></th><th>2020</th></tr><tr><td rowspan=2>é\u200b a</td><td>5</td></tr><tr><td>6</td></tr></table>"
    rows = [(f"d{i}", None if i % 5 == 0 else "" if i % 5 == 1 else page) for i in range(20)]
    got = {}
    for r in html.pieces(spark.createDataFrame(rows, "doc string, html string").repartition(2)).collect():
        got.setdefault(r["doc"], []).append(tuple(r)[1:])
    assert set(got) == {d for d, h in rows if h} and all(v == html.read_page(page) for v in got.values())
    assert [p[5] for p in html.read_page(page)] == ["One^² two".replace("²", "2"), "", "2020", "é a", "5", "é a", "6"]


def test_a_program_carries_only_its_figures(spark, sf):
    """What a fold carries is copied with every step, so neither constants nor a second list of results are in it."""
    plan = catalogue.QUERIES["program_execute"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "[[const_1," not in plan and "struct(figures" not in plan
