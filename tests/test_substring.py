"""The substring join against every pair, and long runs in long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.operators import answers, substring


def rows(seed, docs=6, spans=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé漢😀 ") for _ in range(r.randint(0, 14)))
    held = [(f"d{d}", p, word() + word()) for d in range(docs) for p in range(spans)]
    claims = []
    for i in range(300):
        d, _, text = r.choice(held)
        a = r.randrange(len(text) + 1)
        claims.append((i, d, text[a : a + r.choice([1, 2, 5, 8, 9, 20])] if r.random() < 0.8 else word()))
    return held, claims


@pytest.mark.parametrize("handed", [substring.HANDED, 0])
def test_first_holder_is_that_of_all_pairs(spark, monkeypatch, handed):
    monkeypatch.setattr(substring, "HANDED", handed)
    held, claims = rows(1)
    held += [("d0", 77, None), ("d0", 78, ""), (None, 1, "aa bb"), ("d1", 5, "a second line of one place aab")]
    claims += [(900, "d0", None), (901, "d0", ""), (902, None, "aa"), (903, "none", "a"), (904, "d1", "line of one"), (905, "d1", "line of one"), (905, "d1", "line of one")]
    found = substring.first_holder(spark.createDataFrame(claims, "claim long, doc string, text string"), spark.createDataFrame(held, "doc string, pos long, text string").repartition(3)).collect()
    first = lambda d, t: min((p for e, p, s in held if e == d is not None and s and t and t in s), default=None)
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, first(d, t))) for i, d, t in claims)


@pytest.mark.parametrize(("together", "searched"), [(0, 1e10), (10**6, 250_000), (10**6, 1e10)])
def test_small_and_large_documents_have_the_same_rows(spark, monkeypatch, together, searched):
    """All documents by pieces, some of them, and none."""
    monkeypatch.setattr(substring, "TOGETHER", together)
    monkeypatch.setattr(substring, "SEARCHED", searched)
    held, claims = rows(3)
    held += [("big", p, f"{p} a line of many") for p in range(600)] + [("d0", None, "only here, of no place"), (None, 3, "x")]
    claims += [(1000 + p, "big", f"{p} a line") for p in range(600)] + [(2000, "d1", ""), (2001, None, "x"), (2002, "d1", None), (2003, "d2", "\n")]
    found = substring.first_holder(spark.createDataFrame(claims, "claim long, doc string, text string"), spark.createDataFrame(held, "doc string, pos long, text string").repartition(3)).collect()
    first = lambda d, t: min((p for e, p, s in held if e == d is not None and s and t and t in s and p is not None), default=None)
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, first(d, t))) for i, d, t in claims)


def test_no_pieces_of_small_documents(spark, monkeypatch):
    """Pieces of every character of every text were written and shuffled."""
    monkeypatch.setattr(substring, "with_pieces", None)
    claims, spans = spark.createDataFrame([(1, 7, "so")], "claim long, doc long, text string"), spark.createDataFrame([(7, 2, "and so"), (7, 1, "so on"), (8, 0, "so")], "doc long, pos long, text string")
    assert [tuple(r) for r in substring.first_holder(claims, spans).collect()] == [(1, 1)]


def test_pairs_are_those_of_rare_pieces(spark):
    """A document of many lines that begin alike: a claim meets one line, not all."""
    spans = spark.range(20_000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.concat(F.lit("the company says that number "), F.col("id").cast("string"), F.lit(" is right")).alias("text"))
    claims = spans.where("pos % 7 = 0").select(F.col("pos").alias("claim"), "doc", F.expr("substring(text, 5)").alias("text"))
    found = substring.first_holder(claims, spans)
    assert found.where("claim = pos").count() == found.count() == claims.count()
    assert substring.first_holder(claims.limit(0), spans).count() == 0 and substring.first_holder(claims, spans.limit(0)).where("pos is null").count() == claims.count()


def test_long_texts(spark):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(10**6))
    spans = spark.createDataFrame([(1, 0, "short"), (1, 1, text)], "doc long, pos long, text string")
    assert substring.first_holder(spark.createDataFrame([(1, 1, text[500_000:500_300]), (2, 1, text)], "claim long, doc long, text string"), spans).where("pos = 1").count() == 2
    assert substring.longest_run(text, text[300_000:700_000] + "#") == 400_000


def naive(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_longest_run_is_that_of_the_table():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("ab漢\0") for _ in range(r.randint(0, 40))) for _ in range(2))
        assert substring.longest_run(a, b) == naive(a, b)
    assert substring.longest_run("a" * 50_000, "a" * 49_999 + "b") == 49_999


def test_hashes_of_one_length_are_of_what_they_hold():
    text = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    of = substring.Runs(text, 9).of(3)
    assert of[0] == of[3] and len(set(of.tolist())) == 4 and len(of) == 7


def test_finding_of_claim_with_text_ids(spark):
    quotes = spark.createDataFrame([("c", "f2", "It says: we cut emissions by 40% in 2025."), ("c", "f1", "We cut  EMISSIONS by 40% in 2025, it says."), ("c", "f3", None), ("d", "x", "unlike")], "case string, finding string, quote string")
    wanted = spark.createDataFrame([("c", "we cut emissions by 40% in 2025"), ("d", "another claim entirely"), ("e", "no finding")], "case string, wanted string")
    assert [tuple(r) for r in answers.finding_of_claim(quotes, wanted).collect()] == [("c", "f1", 1.0)]
