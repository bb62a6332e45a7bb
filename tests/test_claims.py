"""Guards, sections, reconciliation, answers, batch matching and running totals against plain Python."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.functions import wording as V
from claimspark.operators import answers, matching, reconcile, retrieval, running, sections, verification


def one(spark, columns, row, schema):
    return spark.createDataFrame([row], schema).select(*columns).first()


CLAIM = "claim string, company int, text string, metric string, value string, unit string, assertion string, period string"


def claims(spark, rows):
    base = ("Sales were fine.", "net revenue", "12.5 million", "USD", "historical", "2020-Q2")
    return spark.createDataFrame([(str(i), 1, *[r.get(k, b) for k, b in zip(("text", "metric", "value", "unit", "assertion", "period"), base)]) for i, r in enumerate(rows)], CLAIM)


def test_guards_and_facts(spark):
    rows = [
        {}, {"assertion": "policy_commitment"}, {"text": "Sales before tax of the year"}, {"text": "Two stores sold this"}, {"metric": "happiness"}, {"value": "5 per cent"}, {"value": "several"}, {"period": "soon"},
        {"period": "2020"}, {"value": "12.54 million"}, {"value": "12.4", "unit": "million"}, {"value": "from 11 to 12.5 million"}, {"value": "11 and 12"}, {"metric": "diluted earnings per share", "value": "1.20"}, {"period": "2019-Q2"}, {"value": None}, {"metric": None},
    ]
    facts = [
        (1, "Revenues", "2020-04-01", "2020-06-30", 12_512_000.0), (1, "Revenues", "2020-01-01", "2020-06-30", 99.0), (1, "Revenues", "2020-01-01", "2020-12-31", 12_451_000.0),
        (1, "EarningsPerShareDiluted", None, "2020-05-01", 1.196), (2, "Revenues", "2020-04-01", "2020-06-30", 1.0),
    ]
    filed = spark.createDataFrame(facts, "company int, tag string, start string, end string, value double").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    out = {r["claim"]: r for r in verification.check(claims(spark, rows), filed).collect()}
    notes = ["future", "company-defined measure", "part of the company", "unknown metric", "rate of change", "no number", "no period"]
    assert [out[str(i)]["note"] for i in range(1, 8)] == notes and all(out[str(i)]["stance"] == "not_found" for i in range(1, 8))
    assert (out["0"]["stance"], out["0"]["filed"]) == ("supports", 12_512_000.0)  # within half of the last digit written
    assert (out["8"]["stance"], out["8"]["filed"]) == ("supports", 12_451_000.0)
    assert out["9"]["stance"] == "contradicts" and out["10"]["stance"] == "contradicts"
    assert out["11"]["stated"] == 12_500_000.0 and out["12"]["note"] == "no number"
    assert (out["13"]["stance"], out["13"]["tag"]) == ("supports", "EarningsPerShareDiluted")
    assert out["14"]["note"] == "nothing filed" and out["15"]["note"] == "no number" and out["16"]["note"] == "unknown metric"
    assert verification.check(claims(spark, rows).limit(0), filed).count() == 0


def test_wording(spark):
    df = spark.createDataFrame([("We cut CO2 by a third", None, False), ("An AI for all", "", False), ("It is said to be mail", "users", False), ("Nice", "encrypted", False), ("Nice", None, None), ("Sales", "", True)], "t string, m string, f boolean")
    assert [r[0] for r in df.select(V.family(F.col("t"), F.col("m"), F.col("f"))).collect()] == ["environmental", "ai_capability", "business_growth", "privacy_security", "product_attribute", "future_target"]
    text = "see https://github.com/one/two.git, http://www.gitlab.com/a/b. and https://github.com/one/two"
    assert one(spark, [V.repositories(F.col("t"))], (text,), "t string")[0] == ["https://github.com/one/two", "http://www.gitlab.com/a/b"]
    assert one(spark, [V.neutralized(F.col("t"), "safe")], ("<SAFE>x</safe> <<safe <b>",), "t string")[0] == "&lt;SAFE>x&lt;/safe> <&lt;safe <b>"
    assert one(spark, [V.retention(F.col("p"), F.col("t"))], (["a  b", "c"], "x a b y"), "p array<string>, t string")[0] == 0.5
    assert one(spark, [V.retention(F.col("p"), F.col("t"))], ([], "x"), "p array<string>, t string")[0] == 1.0


def test_sections(spark):
    report = ["Item 1. Business | 3", "Item 1A. Risk Factors | Page 9", "cover", "Item 1. Business", "see item 7 below", "we make things", "ITEM 1A - Risk factors:", "word " * 12, "few words", "Item 1. again", "Item 7: Discussion", "It is incorporated", "by reference to the exhibit.", "Item 7A", "x"]
    spans = spark.createDataFrame([(1, i, t) for i, t in enumerate(report)] + [(2, 0, "no items"), (3, 0, None)], "doc int, pos int, text string")
    assert [(r["pos"], r["item"], r["title"]) for r in sections.headings(spans).orderBy("pos").collect()] == [(3, "1", "Business"), (6, "1A", "Risk factors"), (10, "7", "Discussion"), (13, "7A", "")]
    out = {r["item"]: (r["spans"], r["words"], r["elsewhere"]) for r in sections.sections(spans).collect()}
    assert out == {"1": (2, 7, False), "1A": (3, 17, False), "7": (2, 8, True), "7A": (1, 1, False)}
    assert [(r["pos"], r["item"]) for r in sections.candidates(spans).collect()] == [(7, "1A")]


def groups_by_force(items):
    """Union of items of equal wording, and of an item with the original of the span it repeats."""
    import hashlib
    import re

    held, seen = [], set()
    for i in sorted(items, key=lambda x: x[1]):
        if (i[0], i[2], i[3]) not in seen:
            seen.add((i[0], i[2], i[3]))
            held.append(i)
    key = lambda q: "grp-" + hashlib.sha256(re.sub(r"\W+", " ", q.lower()).strip().encode()).hexdigest()[:12]
    root = {i[:2]: i[:2] for i in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    original = {}
    for i in held:
        o = [j for j in held if j[0] == i[0] and j[2] == i[5]]
        o.sort(key=lambda j: (j[3] != "claim", j[1]))
        original[i[:2]] = o[0] if o else None
        for j in [*o[:1], *[j for j in held if j[0] == i[0] and key(j[4]) == key(i[4])]]:
            root[find(i[:2])] = find(j[:2])
    out = {}
    for i in held:
        same = [j for j in held if find(j[:2]) == find(i[:2])]
        own = [key(j[4]) for j in same if original[j[:2]] is None]
        out[i[:2]] = (min(own or [key(j[4]) for j in same]), "independent" if original[i[:2]] is None else "repetition")
    return out


def test_groups_whatever_the_order(spark):
    r = random.Random(3)
    items = [(r.randrange(4), i, f"s{r.randrange(12)}", r.choice(["claim", "question"]), r.choice("abcdef") + r.choice(["", "!"]), r.choice([None, None, f"s{r.randrange(14)}"])) for i in range(80)]
    schema = "claim long, id long, span string, target string, quote string, repeats string"
    want = groups_by_force(items)
    for _ in range(2):
        r.shuffle(items)
        found = {(x["claim"], x["id"]): (x["group"], x["origin"]) for x in reconcile.groups(spark.createDataFrame(items, schema)).collect()}
        assert found == want


def test_versions_and_upserts(spark):
    e = [(1, "g", 1, "admit"), (1, "g", 2, "admit"), (1, "g", 3, "withdraw"), (1, "g", 4, "withdraw"), (1, "g", 5, "withdraw"), (1, "g", 6, "admit"), (1, "h", 1, "withdraw"), (2, "g", 9, "admit")]
    out = {(r["claim"], r["group"]): (r["members"], r["active"], r["version"]) for r in reconcile.versions(spark.createDataFrame(e, "claim int, group string, seq int, action string")).collect()}
    assert out == {(1, "g"): (1, True, 4), (2, "g"): (1, True, 1)}
    u = [(1, "g", 1, 1, 0.5, 1.0), (1, "g", 2, 1, 0.5, 1.0), (1, "g", 3, 1, 0.6, 1.0), (1, "g", 4, 3, 0.1, 1.0), (1, "g", 5, 2, 0.1, 1.0), (1, "g", 6, 4, float("nan"), 1.0), (1, "g", 7, 4, 1.0, 1.1), (1, "g", 8, 0, 1.0, 1.0), (1, " ", 9, 1, 1.0, 1.0), (1, "g", 10, 3, 0.1, 1.0)]
    got = reconcile.upserts(spark.createDataFrame(u, "claim int, group string, seq int, version int, log_evidence double, weight double")).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == ["applied", "repeat", "conflict", "applied", "stale", "invalid", "invalid", "invalid", "invalid", "repeat"]


def test_what_a_withdrawal_takes_along(spark):
    items = spark.createDataFrame([(1, 1, "s1", "g"), (1, 2, "s2", "g"), (1, 3, "s3", "h"), (1, 4, "s2", "i")], "claim int, id int, span string, group string")
    reads = spark.createDataFrame([(1, "a", "s1", "g"), (1, "b", "s2", "g"), (1, "c", "s3", "h"), (1, "d", "s2", "i"), (1, "d", "s3", "h")], "claim int, calculation string, span string, group string")
    questions = spark.createDataFrame([(1, "q", "answered", 1), (1, "q", "answered", 2), (1, "r", "answered", 3), (1, "t", "unanswerable", None)], "claim int, question string, status string, id int")
    gone = spark.createDataFrame([(1, 1), (1, 3)], "claim int, id int")
    left, kept, asked = reconcile.after_withdrawal(items, gone, reads, questions)
    assert sorted(r["id"] for r in left.collect()) == [2, 4]
    assert sorted(r["calculation"] for r in kept.collect()) == ["b"]
    assert {r["question"]: r["status"] for r in asked.collect()} == {"q": "answered", "r": "open", "t": "unanswerable"}


def test_year_of_a_period(spark):
    from claimspark.functions.numbers import year_of

    df = spark.createDataFrame([("FY2024",), ("2023 to 2024",), ("soon",), (None,), ("FY2019 Q1",), ("the year of 1999.",)], "p string")
    assert [r[0] for r in df.select(year_of(F.col("p"))).collect()] == [2024, None, None, None, None, 1999]


def test_answers(spark):
    cases = [("12.5%", "0.125", 0.125, True, True), ("1,250", "1250", 1250.0, True, True), ("about 3", "3", None, False, True), ("YES", "yes", None, True, False), ("no", "yes", None, False, False), ("-4", "4", -4.0, False, True), ("1e400", "1", None, False, False), (".5", "0.5", 0.5, True, True), ("12.5", "0.125", 12.5, False, True), ("94", "0.94", 94.0, False, True), (None, "1", None, False, False), ("", "1", None, False, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, g string")
    rows = df.select(answers.strict_number(F.col("a")), answers.same_answer(F.col("a"), F.col("g")), answers.right(F.col("a"), F.col("g"))).collect()
    assert [tuple(r) for r in rows] == [c[2:] for c in cases]


def test_programs(spark):
    good = ["add(", "1", "const_100", ")", "divide(", "#0", "5%", ")", "EOF"]
    table = ["table_max(", "Sales", "none", ")", "EOF"]
    bad = [good[:-1], ["EOF"], ["pow(", "1", "2", ")", "EOF"], ["add(", "#0", "1", ")", "EOF"], ["add(", "1", "yes", ")", "EOF"], ["add(", "1", "2", "EOF"], ["table_max(", "Costs", "none", ")", "EOF"], ["add(", "Sales", "1", ")", "EOF"], []]
    df = spark.createDataFrame([(p, ["Sales"]) for p in [good, table, *bad]], "p array<string>, r array<string>")
    assert [x[0] for x in df.select(answers.safe_program(F.col("p"), F.col("r"))).collect()] == [True, True] + [False] * len(bad)


def test_longest_run():
    from claimspark.operators.substring import longest_run

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randint(0, 25))) for _ in range(2))
        assert longest_run(a, b) == SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


@pytest.mark.parametrize("limit", [0, 10**6])
def test_matching_gives_what_the_join_gives(spark, monkeypatch, limit):
    """Scored in batches or joined by tokens: the same rows, ties by id, whatever the size of the batches."""
    whole = matching.asked
    monkeypatch.setattr(matching, "asked", lambda q, t: whole(q, t, limit))
    monkeypatch.setattr(matching, "CELLS", 30)
    r = random.Random(7)
    words = ["alder", "birch", "cedar", "elms", "firs", "them", "hazel"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    queries = [(i, say(r.randint(1, 4))) for i in range(6)] + [(6, ""), (7, None), (8, "zzzz zzzz")]
    docs = [(i, say(r.randint(0, 20))) for i in range(60)] + [(60, None)]
    q, d = (spark.createDataFrame(x, "id long, text string") for x in (queries, docs))
    bag = lambda t: set((t or "").split())
    shared = {(i, j): len(bag(a) & bag(b)) for i, a in queries for j, b in docs}
    best = {i: max((shared[i, j] / min(len(bag(a)), len(bag(b))), -j) for j, b in docs if bag(b)) for i, a in queries if bag(a)}
    found = {x["id"]: (x["closest"], x["closest_id"]) for x in retrieval.best_match(q, d).collect()}
    assert found == {i: (round(best[i][0], 4), -best[i][1]) if best.get(i, (0,))[0] else (0.0, None) for i, _ in queries}
    want = sorted((i, j, shared[i, j]) for i, _ in queries for j in sorted((j for j, _ in docs if shared[i, j]), key=lambda j: (-shared[i, j], j))[:5])
    assert sorted((x["query"], x["id"], int(x["score"])) for x in retrieval.keyword_search(q, d, 5).collect()) == want
    far = {j: round(max([shared[i, j] / min(len(bag(a)), len(bag(b))) for i, a in queries if bag(a) and bag(b)] or [0.0]), 4) for j, b in docs}
    assert {x["id"]: x["similarity"] for x in retrieval.dropped(q, d).collect()} == {j: s for j, s in far.items() if s < 0.6}
    assert retrieval.bm25(q, d, 3).count() == sum(min(3, sum(shared[i, j] > 0 for j, _ in docs)) for i, _ in queries)


def test_running_totals_of_a_hot_key(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.randrange(-5, 6)) for i in range(500)]
    r.shuffle(rows)
    out = running.running_totals(spark.createDataFrame(rows, "k int, at int, v int"), "k", ["at"], {"total": "v"}).collect()
    df = pd.DataFrame(sorted(rows, key=lambda x: x[1]), columns=["k", "at", "v"])
    assert {(x["k"], x["at"]): x["total"] for x in out} == dict(zip(zip(df["k"], df["at"]), df.groupby("k")["v"].cumsum()))
