import math
import random

import pytest
from pyspark.sql import functions as F

from claimspark.functions import numbers as N
from claimspark.functions import text as X
from claimspark.operators import audit, ledger, replay, retrieval, scoring, transcript, verification
from claimspark.operators.components import components
from claimspark.sources import html
from claimspark.streaming import ledger as live


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("written, value", [("$ 50", 50), ("US$ 1,234.5", 1234.5), ("(32)", -32), ("-32 ( 32 )", -32), ("12.5%", 12.5), ("about fifty", None), ("", None)])
def test_parse_number(spark, written, value):
    found = one(spark, N.parse_number(F.lit(written)))
    assert (None if found is None else float(found)) == value


@pytest.mark.parametrize(
    "claim, number, kind",
    [
        ("saved at least 15% of water", "15", "ge"), ("a fee under €9", "9", "lt"), ("up to 12 depots", "12", "le"), ("$70 million or higher", "70", "ge"), ("9 tonnes or fewer", "9", "le"),
        ("over the winter orders fell 8%", "8", "plain"), ("between 18 and 22 days", "22", "range"), ("more than roughly 33 units", "33", "gt"), ("no less than US$ 4", "4", "ge"), ("From May on. It was 6", "6", "plain"),
    ],
)
def test_bounds(spark, claim, number, kind):
    assert one(spark, N.bound(F.lit(claim), F.lit(number))) == kind


def test_relation(spark):
    said = lambda result, number, kind="plain": one(spark, N.relation(F.lit(float(result)), F.lit(float(number)), N.half_step(F.lit(number)), F.lit(kind)))
    assert said(24.7, "25") == "agrees" and said(24.7, "25.0") == "disagrees" and said(31, "25", "ge") == "agrees" and said(24, "25", "ge") == "disagrees" and said(27, "30", "range") == "none"
    assert said(-12, "12") == said(12, "-12") == said(-11.6, "12") == "none" and said(-20, "12") == "disagrees" and said(-39.6, "-40") == "agrees"
    assert said(-12, "10", "le") == said(-45, "40", "gt") == said(5, "-3", "ge") == "none" and said(0, "10", "le") == "agrees" and said(-5, "-3", "ge") == "disagrees"


def test_periods(spark):
    w = one(spark, N.period_window(F.lit("2015-Q1")))
    assert (str(w["lo"]), str(w["hi"])) == ("2015-01-01", "2015-04-30")
    assert str(one(spark, N.period_window(F.lit("FY2024")))["hi"]) == "2024-12-31"
    assert one(spark, N.period_window(F.lit("soon"))) is None
    assert one(spark, N.call_period(F.lit("2015-02-03").cast("date"))) == "2014-Q4"


def test_text_measures(spark):
    assert one(spark, X.puffery_density(F.lit("a world-class and brightest conquest"))) == pytest.approx(60.0)
    assert one(spark, X.puffery_density(F.lit(""))) == 0.0
    assert one(spark, X.family_key(F.lit("Observation A."))) == "grp-02dc50ff6e0b"
    assert one(spark, X.packed(X.sentences(F.lit("One. Two. Three.")), 9)) == ["One. Two.", "Three."]
    assert one(spark, X.number_tokens(F.lit("1,234.5 and 7."))) == ["1234.5", "7"]


def test_densities(spark):
    lexicon = spark.createDataFrame([("will", "Strong_Modal"), ("may", "Weak_Modal"), ("could", "Weak_Modal")], "word string, category string")
    docs = spark.createDataFrame([(1, "We will grow fast"), (2, ""), (3, None)], "id long, text string")
    rows = {r["id"]: r for r in X.densities(docs, lexicon, "id", "text").collect()}
    assert rows[1]["Strong_Modal"] == 25.0 and rows[1]["Weak_Modal"] == 0.0 and rows[2]["Strong_Modal"] == 0.0 and rows[3]["words"] == 0


def test_novelty(spark):
    now = spark.createDataFrame([(1, "demand for chips may fall"), (2, "entirely fresh wording here"), (3, "")], "id long, text string")
    old = spark.createDataFrame([(7, "demand for chips may fall sharply"), (8, "demand for chips may fall sharply")], "id long, text string")
    rows = {r["id"]: r for r in retrieval.best_match(now, old).collect()}
    assert rows[1]["closest"] == 1.0 and rows[1]["closest_id"] == 7 and rows[1]["status"] == "carried_over"
    assert rows[2]["closest"] == 0.0 and rows[2]["closest_id"] is None and rows[3]["status"] == "added"
    assert retrieval.best_match(now, old.limit(0)).where("status = 'added'").count() == 3
    assert retrieval.dropped(now.where("id = 2"), old).count() == 2


def test_fusion_and_cutoffs(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query long, id string, rank int")
    b = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "query long, id string, rank int")
    assert [r["id"] for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == ["a", "c", "b"]
    docs = spark.createDataFrame([(1, "2020-01-01"), (2, "2022-01-01"), (3, None)], "id long, day string")
    kept = lambda mode: [r["id"] for r in docs.where(retrieval.admissible(F.lit(mode), F.lit("2021-01-01"), F.col("day"))).orderBy("id").collect()]
    assert kept("replay") == [1] and kept("live") == [1, 2, 3]


def test_cosine_in_blocks(spark):
    angle = lambda i: 0.7 * i * i
    rows = [(i, [math.cos(angle(i)), math.sin(angle(i))]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    found = retrieval.cosine_search(v, v.where("id % 20 = 0"), 3, block=1).collect()
    for q in (0, 20):
        want = sorted((-math.cos(angle(q) - angle(i)), i) for i in range(40) if i != q)[:3]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q] == [i for _, i in want]


def test_cosine_ties_go_to_the_least_ids(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in random.Random(3).sample(range(100, 130), 30)] + [(1, [2.0, -1.0, 0.0]), (200, [1.0, 2.0, 0.6])]
    v = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    found = retrieval.cosine_search(v, v.where("id in (115, 200)"), 5).collect()
    of = lambda q: [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q]
    assert of(115) == [100, 101, 102, 103, 104] and of(200) == [100, 101, 102, 103, 104]


def test_calls(spark):
    lines = ["hello", "our results", "we now open for questions", "first answer", "second answer"]
    s = spark.createDataFrame([(1, i, "A" if i != 3 else None, t) for i, t in enumerate(lines)], "call long, idx int, speaker string, text string")
    seg = transcript.segments(s, "open for questions")
    assert [r["segment"] for r in seg.orderBy("idx").collect()] == ["prepared"] * 3 + ["qa"] * 2
    assert {r["segment"] for r in transcript.segments(s, "hello").collect()} == {"unknown"}
    assert [(r["first"], r["last"]) for r in transcript.turns(seg).orderBy("first").collect()] == [(0, 2), (3, 3), (4, 4)]
    delta = transcript.within_speaker(seg, F.length("text").cast("double")).collect()
    assert [(r["idx"], round(r["delta"], 3)) for r in delta] == [(4, round(13 - (5 + 11 + 25) / 3, 3))]


def test_headings_climb(spark):
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate([1, 3, 2, 3, 7, 1])], "doc long, pos int, rank int")
    assert [r["rank"] for r in transcript.climbing(rows, "doc", "pos", "rank").orderBy("pos").collect()] == [1, 3, 7]


def test_verify(spark):
    facts = spark.createDataFrame([("c", "Revenues", "2015-01-01", "2015-03-31", 43_120_000.0), ("c", "Revenues", "2014-04-01", "2015-03-31", 1.0)], "company string, tag string, start string, end string, value double")
    facts = facts.withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})
    claims = spark.createDataFrame([("a", "c", "2015-Q1", 43.1e6, 5e4, ["Net", "Revenues"]), ("b", "c", "2015-Q1", 41e6, 5e4, ["Revenues"]), ("d", "c", "2013-Q1", 43.1e6, 5e4, ["Revenues"])], "claim string, company string, period string, stated double, step double, tags array<string>")
    assert {r["claim"]: r["stance"] for r in verification.verify(claims, facts).collect()} == {"a": "supports", "b": "contradicts", "d": "not_found"}


EVENTS = [(1, 1, "admit", "a", math.log(2)), (1, 2, "admit", "b", math.log(6)), (1, 3, "admit", "b", math.log(6)), (1, 4, "withdraw", "b", 0.0), (1, 5, "correct", "b", math.log(3)), (1, 6, "withdraw", "b", 0.0)]
SCORES = [1 / 3, 0.75, 0.75, 0.75, 0.6, 1 / 3]
CHANGED = [True, True, False, False, True, True]
EVENT_TYPE = "claim long, seq long, action string, `group` string, log_evidence double"


def test_replay(spark):
    rows = replay.replay(spark.createDataFrame(EVENTS, EVENT_TYPE), prior=0.2).orderBy("seq").collect()
    assert [r["probability"] for r in rows] == pytest.approx(SCORES) and [r["changed"] for r in rows] == CHANGED


def test_live_ledger_keeps_state(spark, tmp_path):
    source = tmp_path / "in"
    query = live.live_ledger(spark.readStream.schema(EVENT_TYPE).parquet(str(source)) if source.mkdir() is None else None, prior=0.2)
    sink = query.writeStream.format("memory").queryName("live_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (EVENTS[:3], EVENTS[3:]):
            spark.createDataFrame(part, EVENT_TYPE).coalesce(1).write.mode("append").parquet(str(source))
            sink.processAllAvailable()
    finally:
        sink.stop()
    rows = spark.table("live_rows").orderBy("seq").collect()
    assert [r["probability"] for r in rows] == pytest.approx(SCORES) and [r["changed"] for r in rows] == CHANGED


def test_ledger(spark):
    scores = spark.createDataFrame([(1, "a", math.log(2), 1.0), (1, "b", math.log(3), 1.0), (2, "a", None, 1.0)], "claim long, unit string, log_evidence double, weight double")
    rows = {r["claim"]: r for r in ledger.accumulate(scores, 0.2).collect()}
    assert rows[1]["probability"] == pytest.approx(0.6) and rows[2]["probability"] is None
    votes = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "y"), (1, 3, "x")], "claim long, place long, status string")
    assert ledger.majority(votes).first()["status"] == "x"
    for x in (1000.0, -1000.0):
        assert one(spark, ledger.sigmoid(F.lit(x))) == (1.0 if x > 0 else 0.0)
    gate = spark.createDataFrame([(1, "supported", "supports", True, False), (2, "supported", "supports", True, True), (3, "abstain", "context", True, True)], "claim long, proposed string, relationship string, comparable boolean, active boolean")
    assert {r["claim"]: r["status"] for r in ledger.gate(gate, "proposed").collect()} == {1: "insufficient", 2: "supported", 3: "abstain"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[i] == 0 for i in range(31)) and label[52] == 50 and label[60] == 60
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scoring(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "y int, p int")
    r = scoring.precision_recall(rows).first()
    assert (r["precision"], r["recall"]) == (0.5, 0.5)
    assert scoring.precision_recall(rows.where("p = 0")).first()["precision"] is None
    bins = scoring.reliability(spark.createDataFrame([(0, 0.1), (0, 0.1), (1, 0.9), (1, 1.0)], "y int, score double")).orderBy("band").collect()
    assert [(b["band"], b["rate"], b["n"]) for b in bins] == [(0, 0.0, 2), (4, 1.0, 2)]
    with pytest.raises(ValueError):
        scoring.isotonic(spark.createDataFrame([(1, 0.5)] * 10, "y int, score double"))


@pytest.mark.parametrize("supports, contradicts, hedging, gap", [(0, 1, None, 1.0), (1, 1, None, 0.5), (0, 0, 2.5, 0.5), (0, 0, 9.0, 1.0), (0, 0, None, None), (0, 0, -1.0, None)])
def test_evidence_gap(spark, supports, contradicts, hedging, gap):
    assert one(spark, audit.evidence_gap(F.lit(supports), F.lit(contradicts), F.lit(hedging).cast("double"))) == gap


PAGE = """<html><head><title>x</title></head><body><h1>Report</h1><p>Total<sup>1</sup> fell.</p><p style="display:none">no</p>
<table><caption>Energy</caption><tr><th>Item</th><th>2024</th><th>2025</th></tr><tr><td>Power</td><td>10</td><td>6</td></tr></table>
<div class="footnote">1 As filed.</div><script>var a</script></body></html>"""


def test_html(spark):
    rows = html.spans(spark.createDataFrame([(1, PAGE), (2, None)], "doc long, html string")).orderBy("i").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("heading", "Report"), ("paragraph", "Total^1 fell."), ("table_row", "Energy | Power | 2024: 10 | 2025: 6"), ("footnote", "1 As filed.")]
    assert rows[1]["start"] == len("Report") + 2
