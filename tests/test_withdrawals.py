"""withdrawals_recompute takes every item of the table, those that repeat a span too."""

import json
import random
from collections import Counter
from datetime import datetime

from claimspark.plans import catalogue
from claimspark.streaming import groups as live

KINDS = ["view", "click", "error", "signup", "purchase"]


def run(spark, d, rows):
    """rows: (event, claim, kind, k)."""
    events = [(i, c, datetime(2024, 1, 1), kind, 1.0, json.dumps({"k": k})) for i, c, kind, k in rows]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return sorted(map(tuple, catalogue.QUERIES["withdrawals_recompute"](spark, str(d)).collect()))


def sizes(spark, items):
    """Members of each group, by the live form."""
    held = live.admitted(items)
    return Counter(group for _, group, _ in live.regrouped(held, live.originals_of(held)).values())


def brute_force(spark, rows):
    quotes = spark.createDataFrame([(k, f"Finding no. {k % 11 * 10 + k % 3}{'!' if k % 2 == 0 else ''}") for k in {r[3] for r in rows}], "k int, quote string")
    key = {r["k"]: r["key"] for r in quotes.select("k", live.family_key("quote").alias("key")).collect()}
    out = []
    for claim in sorted({r[1] for r in rows if r[0] % 10 == 3}):
        items = [live.Item(i, f"s{k}", "claim" if kind == "purchase" else "question", key[k], f"s{k - 10}" if kind == "click" and k >= 10 else None, None, None, None) for i, c, kind, k in rows if c == claim]
        out.append((claim, sizes(spark, items) != sizes(spark, [x for x in items if x.id % 10 != 3])))
    return out


def test_items_that_repeat_a_span_are_withdrawn_and_counted(spark, tmp_path):
    """Claim 1 loses only an item that repeats; claim 2 one whose span an item that repeats holds too; claim 3 loses none."""
    rows = [(1, 1, "view", 5), (13, 1, "click", 15), (23, 2, "view", 20), (24, 2, "click", 20), (31, 3, "view", 5), (32, 3, "click", 15)]
    assert run(spark, tmp_path, rows) == [(1, True), (2, False)] == brute_force(spark, rows)


def test_rows_are_those_of_all_items(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.randrange(60), r.choice(KINDS), r.randrange(40)) for i in range(600)]
    assert run(spark, tmp_path, rows) == brute_force(spark, rows)
