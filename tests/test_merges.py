"""Merges with history: refusals, versions on both sides, admissions that follow a merge, and holders at any time."""

import random

import pytest

from claimspark.operators import merges as m

EVENT = "claim long, seq long, action string, `group` string, `into` string"


def past(spark, rows, claim=1):
    events = [(claim, i, *r) if len(r) == 3 else (claim, i, *r, None) for i, r in enumerate(rows)]
    return m.history(spark.createDataFrame(events, EVENT))


def told(df):
    return sorted((r["seq"], r["group"], r["version"], r["members"], r["into"], r["outcome"]) for r in df.collect())


def test_merge_and_refusals(spark):
    found = told(past(spark, [("admit", "a"), ("admit", "b"), ("admit", "c"), ("merge", "a", "a"), ("merge", "b", "a"), ("merge", "c", "b"), ("merge", "z", "c")]))
    assert found == [
        (0, "a", 1, 1, None, "new"), (1, "b", 1, 1, None, "new"), (2, "c", 1, 1, None, "new"), (3, "a", 1, 1, None, "self"), (4, "a", 2, 2, None, "merged"), (4, "b", 2, 0, "a", "merged"),
        (5, "c", 1, 1, None, "inactive"), (6, "z", None, 0, None, "inactive"),
    ]


def test_items_follow_their_group(spark):
    found = told(past(spark, [("admit", "a"), ("admit", "b"), ("merge", "b", "a"), ("admit", "b"), ("withdraw", "b"), ("withdraw", "a"), ("withdraw", "a"), ("withdraw", "a"), ("admit", "b")]))
    assert found[4:] == [(3, "a", 2, 3, None, "admitted"), (4, "a", 3, 2, None, "withdrawn"), (5, "a", 4, 1, None, "withdrawn"), (6, "a", 5, 0, None, "withdrawn"), (7, "a", 5, 0, None, "none"), (8, "a", 6, 1, None, "again")]


def test_an_emptied_group_merges_only_when_it_is_filled_again(spark):
    found = told(past(spark, [("admit", "a"), ("admit", "b"), ("withdraw", "b"), ("merge", "b", "a"), ("merge", "a", "b"), ("admit", "b"), ("merge", "a", "b")]))
    assert [f[5] for f in found] == ["new", "new", "withdrawn", "inactive", "inactive", "again", "merged", "merged"]


def slow_holder(stands, group, at):
    while (step := next(((k, t) for d, k, t in stands if d == group and t <= at), None)) is not None:
        group = step[0]
    return group


@pytest.mark.parametrize("shape", ["chain", "random", "star"])
def test_holders_at_any_time(spark, shape):
    r = random.Random(3)
    rows = [("admit", f"g{i}") for i in range(30)]
    pairs = {"chain": [(i, i + 1) for i in range(29)], "star": [(i, 29) for i in range(29)], "random": [(r.randrange(30), r.randrange(30)) for _ in range(60)]}[shape]
    history = past(spark, rows + [("merge", f"g{a}", f"g{b}") for a, b in pairs])
    stands = m.merges(history)
    known = [(x["drop"], x["keep"], x["at"]) for x in stands.collect()]
    assert len({d for d, _, _ in known}) == len(known) and (len(known) == 29 if shape != "random" else len(known) > 10)
    asked = spark.createDataFrame([(1, f"g{i}", s, "x") for i in range(30) for s in (0, 29, 30, 35, 44, 70, 100)] + [(2, "g1", 100, "other"), (None, "g1", 100, "none")], "claim long, `group` string, seq long, note string")
    found = m.groups_at(asked, stands).collect()
    assert len(found) == 212 and all(x["holder"] == (slow_holder(known, x["group"], x["seq"]) if x["claim"] == 1 else "g1") for x in found)


def test_lineage_is_rewritten(spark):
    stands = m.merges(past(spark, [("admit", "a"), ("admit", "b"), ("admit", "c"), ("merge", "b", "a"), ("merge", "c", "a")]))
    reads = spark.createDataFrame([(1, "n", g, s) for g in "abc" for s in (2, 3, 4)], "claim long, calculation string, `group` string, seq long")
    found = {}
    for r in m.rewritten(reads, stands).collect():
        found.setdefault(r["seq"], []).append(r["group"])
    assert {s: sorted(g) for s, g in found.items()} == {2: ["a", "b", "c"], 3: ["a", "c"], 4: ["a"]}


def test_text_claims_nulls_and_empty_tables(spark):
    rows = [("x", 1, "admit", None, None), ("x", 2, "merge", None, "a"), (None, 1, "admit", "a", None), (None, 2, "admit", "b", None), (None, 3, "merge", "b", "a")]
    found = m.history(spark.createDataFrame(rows, EVENT.replace("claim long", "claim string"))).collect()
    assert sorted(r["outcome"] for r in found) == ["inactive", "merged", "merged", "new", "new", "new"]
    assert m.history(spark.createDataFrame([], EVENT)).count() == 0
