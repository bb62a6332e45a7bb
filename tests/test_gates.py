"""References that may be scored, annotated evidence, Python's own samples, and evidence under change."""

import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import gates

REFERENCE = "example string, mode string, review string, reviewed_mode string, reviewed_material string, reviewed_evidence string, draft_material string, draft_evidence string, ready string, allowed_evidence int, full_original boolean, cutoff string"


def references(spark):
    whole, draft = ("ready", 3, True, "2024-01-01"), ("present", "mixed")
    return spark.createDataFrame([
        ("r1", "retrospective", "adjudicated", "retrospective", "absent", "supported", *draft, None, None, None, None), ("r2", "retrospective", "draft", None, None, None, *draft, None, None, None, None),
        ("r3", "retrospective", "adjudicated", "independent", "absent", "supported", *draft, None, None, None, None), ("r4", "retrospective", "adjudicated", "retrospective", "maybe", "supported", *draft, None, None, None, None),
        ("i1", "independent", "adjudicated", "independent", "absent", "supported", *draft, *whole), ("i2", "independent", "adjudicated", "independent", "absent", "supported", *draft, "ready", 0, True, "2024-01-01"),
        ("i3", "independent", None, None, None, None, *draft, *whole), (None, None, None, None, None, None, None, None, None, None, None, None),
    ], REFERENCE)


@pytest.mark.parametrize(
    "mode, allow, want",
    [
        ("retrospective", False, {"r1": None, "r2": "unreviewed", "r3": "adjudicated_for_other_mode", "r4": "labels", "i1": "mode", "i2": "mode", "i3": "mode", None: "mode"}),
        ("retrospective", True, {"r1": None, "r2": None, "r3": "adjudicated_for_other_mode", "r4": "labels", "i1": "mode", "i2": "mode", "i3": "mode", None: "mode"}),
        ("independent", False, {"r1": "mode", "r2": "mode", "r3": "mode", "r4": "mode", "i1": None, "i2": "incomplete", "i3": "unreviewed", None: "mode"}),
        ("independent", True, {"r1": "mode", "r2": "mode", "r3": "mode", "r4": "mode", "i1": "draft_forbidden", "i2": "draft_forbidden", "i3": "draft_forbidden", None: "mode"}),
    ],
)
def test_reference_targets(spark, mode, allow, want):
    got = gates.reference_targets(references(spark), mode, allow).collect()
    assert {r["example"]: r["problem"] for r in got} == want
    assert all((r["material"] is None) == (r["problem"] is not None) and r["draft"] == (None if r["problem"] else r["example"] == "r2") for r in got)


def test_oracle_inputs(spark):
    inputs = spark.createDataFrame([("a", "q1"), ("b", "q2")], "example string, text string")
    pieces = spark.createDataFrame([("a", 2, "second", "d", 7), ("a", 1, "first", "d", 3), ("z", 1, "other", "d", 1)], "example string, place int, text string, document string, page int")
    got = {r["example"]: r for r in gates.oracle_inputs(inputs, pieces).collect()}
    assert [(p["text"], p["page"]) for p in got["a"]["oracle_evidence"]] == [("first", 3), ("second", 7)] and got["b"]["oracle_evidence"] == []
    assert got["a"]["text"] == "q1" and got["b"]["evidence_setting"] == gates.ORACLE


def test_samples_are_pythons(spark):
    rows = [(f"k{i:03d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, v long").repartition(5)
    got = [(r["key"], r["v"]) for r in gates.seeded_sample(df, ["key"], 60, 5).orderBy("draw").collect()]
    assert got == random.Random(5).sample(rows, 60)
    with pytest.raises(ValueError):
        gates.seeded_sample(df, ["key"], 201, 5)


def test_mean_squared(spark):
    df = spark.createDataFrame([(0.5, 1), (0.0, 1)], "p double, y int")
    assert gates.mean_squared(df).first()["brier"] == 0.625 and gates.mean_squared(df.limit(0)).first()["brier"] == 0.0


def test_evidence_under_change(spark):
    item = "claim long, id long, span string, target string, quote string, repeats string"
    items = spark.createDataFrame([(1, 1, "s1", "claim", "Output doubled.", None), (1, 2, "s2", "claim", "It is said to have doubled", "s1"), (2, 3, "s1", "claim", "Alone", None), (3, 4, "s9", "claim", "Same", None), (3, 5, "s8", "claim", "same!", None)], item)
    assert {r["claim"]: r["holds"] for r in gates.repeating_adds_nothing(items, F.col("id") > 0).collect()} == {1: True, 2: True, 3: True}
    assert {r["claim"]: r["holds"] for r in gates.withdrawal_recomputes(items, F.col("id").isin(2, 3)).collect()} == {1: True, 2: True}
