"""Search as of cutoffs against a search over what each admits, calibration against the min-max of means."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import asof, calibration, matching, retrieval

CUTOFFS = ["2003-01-01", "2001-01-01", "2002-01-01"]


@pytest.mark.parametrize("handed", [True, False])
def test_each_cutoff_gives_a_search_over_what_it_admits(spark, monkeypatch, handed):
    if not handed:
        monkeypatch.setattr(matching, "asked", lambda *a, **k: None)
    r = random.Random(8)
    words = "alder birch cedar elm fir hazel ivy".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    day = lambda: datetime.date(2000, 6, 1) + datetime.timedelta(r.randrange(1200)) if r.random() < 0.9 else None
    docs = [(f"d{i:02d}", text(r.randrange(12)) if i % 11 else None, day()) for i in range(60)]
    passages = spark.createDataFrame(docs, "id string, text string, day date").repartition(3)
    queries = spark.createDataFrame([(1, "Alder, elm!"), (2, "hazel ivy fir"), (3, "unknown"), (4, "")], "id long, text string")
    found = {}
    for x in asof.bm25_at(queries, passages, CUTOFFS, 4).collect():
        found.setdefault(x["cutoff"], []).append((x["query"], x["id"], x["score"], x["rank"]))
    monkeypatch.undo()
    for c in CUTOFFS:
        kept = passages.where(F.col("day") <= F.lit(c).cast("date")).select("id", F.coalesce("text", F.lit("")).alias("text"))
        assert sorted(found[c]) == sorted((x["query"], x["id"], x["score"], x["rank"]) for x in retrieval.bm25(queries, kept, 4).collect())
    late = {(x["cutoff"], x["id"]) for x in asof.later(passages, CUTOFFS).collect()}
    assert late == {(c, i) for c in CUTOFFS for i, _, d in docs if d is None or str(d) > c}
    assert asof.bm25_at(queries, passages.limit(0), CUTOFFS, 4).count() == 0 and asof.bm25_at(queries.limit(0), passages, CUTOFFS, 4).count() == 0


def by_force(points):
    scores = sorted({s for s, _ in points})
    mean = lambda a, b: (lambda ys: sum(ys) / len(ys))([y for s, y in points if a <= s <= b])
    return {s: max(min(mean(a, b) for b in scores if b >= s) for a in scores if a <= s) for s in scores}


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4)])
def test_curve_is_the_min_max_of_means(spark, seed, parts):
    r = random.Random(seed)
    points = [(round(r.random(), 2 if seed == 1 else 1), None) for _ in range(80)]
    points = [(s, int(r.random() < s)) for s, _ in points]
    df = spark.createDataFrame([*points, (None, 1), (0.5, None), (float("nan"), 1)], "score double, y int").repartition(parts)
    fitted = calibration.curve(df)
    want = by_force(points)
    got = {x["boundary"]: x["value"] for x in fitted.collect()}
    assert all(abs(want[b] - v) < 1e-12 for b, v in got.items()) and len({round(v, 9) for v in got.values()}) == len({round(v, 9) for v in want.values()})
    asked = spark.createDataFrame([(s,) for s in (*want, None, -1.0, 9.0)], "score double")
    made = {x["score"]: x["probability"] for x in calibration.probabilities(asked, fitted).collect()}
    assert made[None] is None and made[-1.0] == min(want.values()) and made[9.0] == max(want.values())
    assert all(abs(made[s] - want[s]) < 1e-9 for s in want)


def test_a_pooled_range_is_a_block_like_any_other():
    r = random.Random(3)
    rows = [(i / 100, i / 100, float(r.randrange(2)), 1) for i in range(100)]
    parts = [calibration.pooled(rows[a : a + 17]) for a in range(0, 100, 17)]
    assert calibration.pooled(b for p in parts for b in p) == calibration.pooled(rows)


@pytest.mark.parametrize("ones, n", [(10, 29), (4, 60), (56, 60), (0, 0)])
def test_too_few_outcomes(spark, ones, n):
    df = spark.createDataFrame([(i / 100, int(i < ones)) for i in range(n)], "score double, y int")
    with pytest.raises(calibration.TooFewOutcomes):
        calibration.curve(df)
