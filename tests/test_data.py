"""Prepared datasets, selections, rounds and variants on small fixtures."""

import hashlib

from pyspark.sql import functions as F

from claimspark.operators import preparation as P
from claimspark.operators import replay, retrieval, rounds, verification  # noqa: F401


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_articles_and_labels(spark):
    schema = "example string, claim_label string, evidences array<struct<evidence_id: string, article: string, evidence: string, evidence_label: string>>"
    df = spark.createDataFrame([("a", "1", [("e1", "Sea level", "It rises.", "2"), ("e2", "Ice", "It melts.", "SUPPORTS")]), ("b", "DISPUTED", None)], schema)
    documents, labels = P.article_documents(df)
    assert rows(documents) == [("a", "e1", "It rises.", "Sea_level"), ("a", "e2", "It melts.", "Ice")]
    assert rows(labels) == [("a", "REFUTES", "e1", "NOT_ENOUGH_INFO"), ("a", "REFUTES", "e2", "SUPPORTS"), ("b", "DISPUTED", None, None)]


def test_inputs_hold_no_gold(spark):
    df = spark.createDataFrame([(3, "c", "Supported", "because"), (1, "d", "Conflicting Evidence/Cherry-picking", None)], "place int, claim string, label string, why string")
    numbered = P.numbered_claims(df, "place", "dev-")
    inputs, references = P.split_columns(numbered, "example", ["label", "why"])
    assert set(inputs.columns) == {"place", "claim", "example"} and rows(references.select("example", "label")) == [("dev-0000", "Conflicting Evidence/Cherrypicking"), ("dev-0001", "Supported")]
    empty = P.templates(inputs, {"label": "string", "score": "double"}).orderBy("example").first()
    assert empty.asDict() == {"example": "dev-0000", "status": "ok", "label": None, "score": None, "error": None}
    chosen = spark.createDataFrame([("dev-0001", 0), ("dev-0000", 1), ("dev-0001", 2)], "example string, place int")
    assert [r["claim"] for r in P.selected(inputs.drop("place"), chosen).orderBy("place").collect()] == ["c", "d"]


def test_snippets(spark):
    claims = spark.createDataFrame([("q", " Rain fell ")], "example string, claim string")
    said = ["  ", "PolitiFact wrote", "rated it as totally false", "rain is wet", "a half true story", "more rain", "even more"]
    snippets = spark.createDataFrame([("Rain fell", i, t) for i, t in enumerate(said)], "claim string, rank int, text string")
    assert rows(P.searchable_snippets(claims, snippets, 2)) == [("q", 1, "rain is wet"), ("q", 2, "more rain")]


def test_manifest_and_snapshots(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    made = P.file_manifest(spark, str(tmp_path)).first()
    assert (made["bytes"], made["sha256"]) == (3, hashlib.sha256(b"one").hexdigest())
    name = lambda t: "doc-" + hashlib.sha256(t.encode()).hexdigest()[:16]
    stored = spark.createDataFrame([(name("x"), "x", 9)], "document string, content string, retrieved int")
    new = spark.createDataFrame([("x", 1), ("y", 5), ("y", 4)], "content string, retrieved int")
    assert rows(P.admitted_documents(new, stored)) == sorted([(name("x"), "x", 9), (name("y"), "y", 4)])


def test_same_wiring_whatever_the_names(spark):
    schema = "i array<struct<name: string, source: string, value: string>>, s array<struct<op: string, args: array<string>, out: string>>, o string, e string"
    base = ([("a", "s1", "3"), ("b", "s2", "4")], [("divide", ["a", "b"], "x"), ("multiply", ["x", "const_100"], "y")], "y", "75")
    other = ([("q", "s2", "4"), ("p", "s1", "3")], [("divide", ["p", "q"], "m"), ("multiply", ["m", "const_100"], "n")], "n", "75")
    turned = ([("a", "s1", "3"), ("b", "s2", "4")], [("divide", ["b", "a"], "x"), ("multiply", ["x", "const_100"], "y")], "y", "75")
    stated = (*base[:3], "80")
    passage = ([("a", "s9", "3"), ("b", "s2", "4")], *base[1:])
    keys = [r[0] for r in spark.createDataFrame([base, other, turned, stated, passage], schema).select(rounds.wiring(*[F.col(c) for c in "isoe"])).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4


def test_variants_act_on_one_admission(spark):
    events = [(1, 1, "admit", "g", 1.0), (1, 2, "admit", "h", 0.5), (1, 3, "admit", "i", 0.25), (1, 4, "withdraw", "i", 0.0), (2, 1, "withdraw", "g", 1.0)]
    df = spark.createDataFrame(events, "claim long, seq long, action string, group string, log_evidence double")
    out = {(r["claim"], r["run"]): (r["active"], round(r["log_odds"], 6), r["updates"]) for r in replay.outcomes(replay.variants(df, 3, 2)).collect()}
    assert out[1, "base"] == (2, 1.5, 4) and out[1, "permutation_0"] == out[1, "permutation_1"] == out[1, "base"]
    assert out[1, "duplicate_event"][:2] == (2, 1.5) and out[1, "irrelevant_addition"] == (3, 1.5, 5)
    gone = 1.5 - out[1, "withdrawal"][1]
    assert gone in (1.0, 0.5) and out[1, "withdrawal"][0] == 1 and out[1, "correction"] == (2, 1.5 - gone, 5) and out[1, "duplicate_source"] == (3, 1.5 + gone, 5)
    assert (2, "withdrawal") not in out and out[2, "base"] == (0, 0.0, 0)


def test_contexts_of_scores(spark):
    members = spark.createDataFrame([("u", "Rose.", "supports", True, ["b", "a"], 1), ("u", "rose", "supports", True, ["a", "b"], 1), ("v", "fell", "supports", True, [], 1)], "unit string, quote string, relationship string, comparable boolean, differs array<string>, claim_version int")
    first = dict(rows(rounds.context_key(members, ["claim_version"])))
    one = dict(rows(rounds.context_key(members.where("quote <> 'rose'"), ["claim_version"])))
    later = dict(rows(rounds.context_key(members.withColumn("claim_version", F.lit(2)), ["claim_version"])))
    assert first == one and first["u"] != first["v"] and later["u"] != first["u"]


def test_hybrid_sees_only_what_is_kept(spark):
    q = spark.createDataFrame([(1, "red apples")], "id long, text string")
    docs = spark.createDataFrame([(1, "green pears"), (2, "red apples here"), (3, "red cars"), (4, "blue")], "id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.8, 0.2])], "id long, v array<double>")
    found = retrieval.hybrid(q, docs, v.where("id = 1"), v, 2).orderBy("rank").collect()
    assert [r["id"] for r in found] == [3, 2, 4] and abs(found[0]["score"] - (1 / 62 + 1 / 61)) < 1e-9
    kept = retrieval.hybrid(q, docs, v.where("id = 1"), v, 2, docs.where("id <> 3").select("id")).orderBy("rank").collect()
    assert {r["id"] for r in kept} == {2, 4}
    assert rounds.public(spark.createDataFrame([(1, 2.0)], "claim int, belief double")).columns == ["claim"]
    assert spark.range(1).select(rounds.saving(F.lit(10), F.lit(4)), rounds.saving(F.lit(0), F.lit(4))).first()[:] == (0.6, None)
