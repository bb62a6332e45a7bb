"""Reconciled items hang together as their wordings do: rows against all links, and how many nodes are made."""

import random

from pyspark.sql import functions as F

from claimspark.operators import gates, reconcile
from claimspark.streaming import groups as live

TYPE = "claim long, id long, span string, target string, quote string, repeats string"


def items(seed, n=120):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, None]), i, f"s{r.randrange(25)}", r.choice(["claim", "q"]), r.choice([None, *(f"Finding {k}!" for k in range(12))]), f"s{r.randrange(25)}" if r.random() < 0.3 else None) for i in range(n)]


def test_rows_are_those_of_all_links(spark):
    """Without nulls, which the live form doesn't take; each item in a group of one name."""
    rows = [x for x in items(5, 200) if x[0] is not None and x[4] is not None]
    df = spark.createDataFrame(rows, TYPE)
    keys = {r["id"]: r["wording"] for r in df.select("id", reconcile.family_key("quote").alias("wording")).collect()}
    want = set()
    for claim in {x[0] for x in rows}:
        own = live.admitted([live.Item(x[1], x[2], x[3], keys[x[1]], x[5], None, None, None) for x in rows if x[0] == claim])
        want |= {(claim, i, group, origin) for i, (_, group, origin) in live.regrouped(own, live.originals_of(own)).items()}
    assert {tuple(r) for r in reconcile.groups(df).collect()} == want


def test_items_of_no_wording_or_claim_stay(spark):
    rows = items(6)
    df = spark.createDataFrame(rows, TYPE)
    got = reconcile.groups(df)
    assert got.count() == reconcile.admitted(df).count() and got.where("claim is null and origin = 'repetition'").isEmpty()
    pair = [(1, 1, "a", "claim", None, None), (1, 2, "b", "claim", "Said", "a"), (1, 3, "c", "claim", None, None), (2, 4, "a", "claim", None, None)]
    got = {r["id"]: (r["group"], r["origin"]) for r in reconcile.groups(spark.createDataFrame(pair, TYPE)).collect()}
    said = got[2][0]
    assert said is not None and got == {1: (said, "independent"), 2: (said, "repetition"), 3: (said, "independent"), 4: (None, "independent")}


def test_nodes_are_wordings_not_items(spark, monkeypatch):
    """A thousand items of five wordings, each of which repeats another: at most the pairs of wordings are edges."""
    seen, whole = [], reconcile.components
    monkeypatch.setattr(reconcile, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    rows = spark.range(1000).select(F.lit(1).alias("claim"), "id", F.concat(F.lit("s"), "id").alias("span"), F.lit("claim").alias("target"), (F.col("id") % 5).cast("string").alias("quote"), F.concat(F.lit("s"), (F.col("id") * 7 % 1000).cast("string")).alias("repeats"))
    assert reconcile.groups(rows).count() == 1000 and seen[0] <= 25


def test_both_sides_of_a_withdrawal_are_grouped_at_once(spark, monkeypatch):
    calls, whole = [], reconcile.groups
    monkeypatch.setattr(reconcile, "groups", lambda rows: calls.append(1) or whole(rows))
    rows = [(1, 1, "a", "claim", "One", None), (1, 2, "b", "claim", "One", None), (2, 3, "a", "claim", "Two", None), (2, 4, "a", "claim", "Two", None), (3, 5, "a", "claim", "Two", None)]
    out = gates.withdrawal_recomputes(spark.createDataFrame(rows, TYPE), F.col("id").isin(2, 4))
    assert sorted(map(tuple, out.collect())) == [(1, True), (2, False)] and len(calls) == 1
