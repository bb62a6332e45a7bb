"""Records of findings with what is missing, and stored states that their own trace makes again."""

import json
import random

from pyspark.sql import functions as F

from claimspark.operators import replay, traces


def tables(spark):
    make = spark.createDataFrame
    findings = make([("f1", "c1", "a1", "d1", "supported", "t9"), ("f2", "c2", "a1", "d2", "insufficient", None), ("f3", None, "a2", None, "mixed", None)], "finding string, claim string, analysis string, document string, status string, created string")
    claims = make([("c1", "We cut emissions."), ("c3", "unused")], "claim string, text string")
    documents = make([("d1", "http://x", "Report", "t1"), ("d2", "http://y", None, "t2")], "document string, url string, heading string, retrieved string")
    evidence = make([("c1", 2, "d2", "second"), ("c1", 1, "d1", "first"), ("c1", 3, "gone", "third"), ("c2", 1, "d1", "other")], "claim string, place long, document string, quote string")
    questions = make([("c1", 1, 3.0, "answered"), ("c1", 2, 1.0, "open"), ("c2", 1, 0.0, "open")], "claim string, question long, materiality double, status string")
    calls = make([("a1", 1, 100, 20, 5, None), ("a1", 2, None, 7, None, "timeout")], "analysis string, place long, tokens_in long, tokens_out long, latency long, error string")
    return findings, claims, documents, evidence, questions, calls


def test_heads(spark):
    got = {r["finding"]: r for r in traces.heads(*tables(spark)).collect()}
    f1, f2, f3 = got["f1"], got["f2"], got["f3"]
    assert (f1["text"], f1["title"], f1["created"], f1["coverage"], f1["evidence"], f1["asked"]) == ("We cut emissions.", "Report", "t9", 0.75, 3, 2)
    assert (f2["text"], f2["title"], f2["created"], f2["coverage"]) == ("", "http://y", "t2", 0.0)
    assert (f3["title"], f3["coverage"], f3["evidence"], f3["calls"], f3["tokens"]) == (traces.UNTITLED, 0.0, 0, 0, 0)
    assert all((f["calls"], f["tokens"], f["latency"], f["errors"]) == (2, 127, 5, 1) for f in (f1, f2))


def test_parts_and_nested_records(spark):
    findings, claims, documents, evidence, questions, calls = t = tables(spark)
    part = traces.parts(findings, documents, evidence, questions, calls)
    assert part.count() == 4 + 3 + 4
    got = {r["finding"]: r for r in traces.nested(traces.heads(*t), part).collect()}
    listed = [json.loads(x) for x in got["f1"]["evidence_list"]]
    assert [(x["quote"], x.get("source_url")) for x in listed] == [("first", "http://x"), ("second", "http://y"), ("third", None)]
    assert len(got["f2"]["calls_list"]) == 2 and got["f3"]["evidence_list"] == [] and len(got["f1"]["questions_list"]) == 2


def test_part_sizes_are_those_of_parts(spark):
    """Also with a document that is held twice, a finding that is, and things of no claim."""
    findings, _, documents, evidence, questions, calls = tables(spark)
    findings, documents = findings.union(findings.where("finding = 'f1'")), documents.union(documents.where("document = 'd1'"))
    evidence = evidence.union(spark.createDataFrame([("c2", 9, None, "of none"), (None, 1, "d1", "lost")], evidence.schema))
    url = F.count_if(F.get_json_object("body", "$.source_url").isNotNull())
    want = traces.parts(findings, documents, evidence, questions, calls).groupBy("finding", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), url.alias("with_url"))
    got = traces.part_sizes(findings, documents, evidence, questions, calls)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_analysis_of_all_findings_is_counted_once(spark):
    """A million findings on one analysis of a million calls: 10 ** 12 rows of parts."""
    findings = spark.range(1_000_000).select(F.col("id").alias("finding"), F.col("id").alias("claim"), F.lit("a").alias("analysis"))
    calls = spark.range(1_000_000).select(F.lit("a").alias("analysis"), F.col("id").alias("place"))
    none = "claim long, place long, document string, question long, url string"
    empty = spark.createDataFrame([], none)
    got = traces.part_sizes(findings, empty.select("document", "url"), empty.select("claim", "place", "document"), empty.select("claim", "question"), calls)
    assert got.where("n = 1000000 and first = 0 and last = 999999").count() == 1_000_000


def test_a_trace_makes_its_state_again(spark):
    """Events to a state, the state to a trace, and the trace's replay ends where the events' did."""
    r = random.Random(4)
    events = [(c, i, r.choice(["admit", "admit", "withdraw", "correct"]), r.choice("abcd"), r.randrange(-20, 20) / 16) for c in range(4) for i in range(40)]
    kind = "claim long, seq long, action string, `group` string, log_evidence double"
    ends = lambda df: {x["claim"]: x for x in df.groupBy("claim").agg(F.max_by(F.struct("active", F.round("probability", 9).alias("p")), "seq").alias("end")).collect()}
    want = ends(replay.replay(spark.createDataFrame(events, kind)))
    held: dict = {}
    for c, i, action, g, score in events:
        items, now = held.get((c, g), ([], 0.0))
        if action == "admit":
            items, now = [*items, i], now if items else score
        elif action == "withdraw":
            items = items[:-1]
        elif items:
            now = score
        held[c, g] = (items, now)
    stored = [(c, i % 5, i, f"e{i}", g, score) for (c, g), (items, score) in held.items() for i in items]
    state = spark.createDataFrame(stored, "claim long, round long, place long, id string, `group` string, log_evidence double")
    sums = spark.createDataFrame([(c, k, 0, f"n{k}") for c in range(4) for k in (0, 4)], "claim long, round long, place long, id string")
    trace = traces.exported(state, sums)
    rows = trace.where("claim = 1").orderBy("seq").collect()
    assert [x["seq"] for x in rows] == list(range(1, len(rows) + 1))
    own = sorted(x for x in stored if x[0] == 1)
    assert [x["id"] for x in rows] == [x[3] for x in own if x[1] == 0] + ["n0"] + [x[3] for x in own if 0 < x[1] <= 4] + ["n4"]
    found = ends(replay.replay(trace.where("action = 'admit'").select("claim", F.col("seq").cast("long").alias("seq"), "action", "group", "log_evidence")))
    assert found == {c: x for c, x in want.items() if c in found} and all(want[c]["end"]["active"] == 0 for c in want if c not in found)
