"""Numbers within a tolerance against every pair, and which key numbers count as reached."""

import random
from decimal import Decimal

from claimspark.operators import comparison as c


def test_near_is_that_of_all_pairs(spark):
    r = random.Random(9)
    number = lambda: Decimal(r.randrange(-400, 400)) / 100 if r.random() < 0.9 else Decimal(r.choice(["1000000000000.05", "0.00000001", "1.05", "1.1", "0.05"]))
    left, right = [(r.randrange(4), number()) for _ in range(300)] + [(1, None)], [(r.randrange(5), number()) for _ in range(30)] + [(2, None)]
    made = c.with_near(spark.createDataFrame(left, "case long, number decimal(30,8)"), spark.createDataFrame(right, "case long, number decimal(30,8)"), ["case"], "near")
    close = lambda a, b: a is not None and b is not None and abs(abs(a) - abs(b)) <= Decimal("0.05")
    want = sorted((k, str(n if n is None else float(n)), any(k == j and close(n, m) for j, m in right)) for k, n in left)
    got = sorted((x["case"], str(x["number"] if x["number"] is None else float(x["number"])), x["near"]) for x in made.collect())
    assert got == want and 20 < sum(x[2] for x in got) < 280


def test_key_numbers(spark):
    keys = spark.createDataFrame([("a", "41.7"), ("a", "12"), ("a", "300"), ("b", "5")], "case string, number string")
    outputs = spark.createDataFrame([("a", "x", "It fell 41.65% to 12 in all, see doc-0123456789abcdef-s300."), ("a", "y", None), ("b", "x", "nothing")], "case string, arm string, text string")
    computed = spark.createDataFrame([("a", "y", "0.417", "Ratio "), ("a", "y", "n/a", None), ("b", "x", "0.05", "t")], "case string, arm string, value string, unit string")
    passages = spark.createDataFrame([("a", "Sites: 12 of 1,300."), ("b", None)], "case string, text string")
    got = {(r["case"], r["arm"]): (r["key_numbers"], r["found"]) for r in c.key_numbers(keys, outputs, computed, passages).collect()}
    assert got == {("a", "x"): (3, 1), ("a", "y"): (3, 1), ("b", "x"): (1, 0)}


def test_unverified(spark):
    outputs = spark.createDataFrame([("a", "x", "1,300 and 7 and 0.417 and 41.7 and 9.99, 9.99")], "case string, arm string, text string")
    passages = spark.createDataFrame([("a", "of 1300.04"), ("b", "7")], "case string, text string")
    references = spark.createDataFrame([("a", "41.7"), ("b", "9.99"), ("a", None)], "case string, number string")
    assert sorted(float(r["number"]) for r in c.unverified(outputs, passages, references).collect()) == [7.0, 9.99]
    assert c.unverified(outputs.limit(0), passages, references).count() == 0
