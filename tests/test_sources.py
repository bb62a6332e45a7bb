import json

import pytest
from pyspark.sql import functions as F

from claimspark.functions.text import densities
from claimspark.sources import calls, edgar, records


def test_filings(spark, tmp_path):
    recent = {"form": ["10-K", "8-K", "10-K"], "accessionNumber": ["0001-24-000001", "0001-24-000002", "0001-23-000009"], "filingDate": ["2024-02-01", "2024-03-01", "2023-02-01"], "reportDate": ["2023-12-31", "", "2022-12-31"], "primaryDocument": ["a.htm", "b.htm", "c.htm"], "items": ["", "4.02, 9.01", ""]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1234567", "filings": {"recent": recent, "files": []}}))
    filed = edgar.filings(edgar.documents(spark, str(tmp_path / "s.json"), edgar.SUBMISSIONS))
    first = edgar.of_form(filed, "10-K", 1).first()
    assert first["url"] == "https://www.sec.gov/Archives/edgar/data/1234567/000124000001/a.htm" and first["cik"] == "0001234567"
    assert filed.where("form = '8-K'").first()["report"] is None
    assert [str(r["filed"]) for r in edgar.events(filed, "4.02").collect()] == ["2024-03-01"] and edgar.events(filed, "4.0").count() == 0


def test_facts_and_tickers(spark, tmp_path):
    fact = {"units": {"USD": [{"start": "2024-01-01", "end": "2024-03-31", "val": 5, "accn": "x"}, {"end": "2024-03-31", "val": 7}]}}
    (tmp_path / "f.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": fact}}}))
    rows = edgar.facts(edgar.documents(spark, str(tmp_path / "f.json"), edgar.FACTS)).orderBy("value").collect()
    assert [(r["company"], r["tag"], r["value"], r["start"] is None) for r in rows] == [("0000000007", "Revenues", 5.0, False), ("0000000007", "Revenues", 7.0, True)]
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "Abc", "title": "A"}, "1": {"cik_str": 8, "ticker": "ABC", "title": "B"}}))
    assert [tuple(r) for r in edgar.companies(spark, str(tmp_path / "t.json")).collect()] == [("ABC", "0000000007")]


def test_older_filings_and_newest_facts(spark, tmp_path):
    block = {"form": ["8-K"], "accessionNumber": ["0009-20-000001"], "filingDate": ["2020-05-01"], "reportDate": ["2020-04-30"], "primaryDocument": ["b.htm"], "items": ["4.02, 9.01"]}
    (tmp_path / "CIK0000000012-submissions-001.json").write_text(json.dumps(block))
    row = edgar.older_filings(edgar.documents(spark, str(tmp_path / "*.json"), edgar.OLDER)).first()
    assert (row["cik"], row["form"], row["items"], row["url"]) == ("0000000012", "8-K", ["4.02", "9.01"], "https://www.sec.gov/Archives/edgar/data/12/000920000001/b.htm")
    rows = [("1", "us-gaap", "Assets", u, None, e, v, "x") for u, e, v in (("USD", "2020-01-01", 1.0), ("USD", "2021-01-01", 2.0), ("EUR", "2022-01-01", 3.0))]
    filed = spark.createDataFrame(rows, "company string, taxonomy string, tag string, unit string, start date, end string, value double, accession string")
    assert [r["value"] for r in edgar.of_tag(filed, "Assets").orderBy("rank").collect()] == [2.0, 1.0]


def make_call(root, name, lines, rows, people=None):
    (root / "calls" / name).mkdir(parents=True)
    (root / "calls" / name / "text.txt").write_text("\n".join(lines))
    (root / "calls" / name / "features.csv").write_text("\n".join(["Mean pitch,Audio Length", *rows]))
    if people:
        (root / "labels" / name).mkdir(parents=True)
        (root / "labels" / name / "text.csv").write_text("\n".join(["Person,Sentence", *[f"{p},s" for p in people]]))


def test_calls(spark, tmp_path):
    make_call(tmp_path, "20150203_A", ["one", "", "two"], ["1.5,2", "--undefined--,4"], ["X", ""])
    make_call(tmp_path, "20150203_B", ["one"], ["1,1"], ["X", "Y"])
    got = calls.read_calls(spark, str(tmp_path / "calls"), str(tmp_path / "labels")).orderBy("call", "idx").collect()
    assert [(r["call"][-1], r["text"], r["speaker"], r["features"]) for r in got] == [("A", "one", "X", {"Mean pitch": 1.5, "Audio Length": 2.0}), ("A", "two", None, {"Audio Length": 4.0}), ("B", "one", None, {"Mean pitch": 1.0, "Audio Length": 1.0})]
    make_call(tmp_path, "20150203_C", ["one", "two"], ["1,1"])
    with pytest.raises(Exception, match="differ in number"):
        calls.read_calls(spark, str(tmp_path / "calls")).collect()


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Word,Negative,Strong_Modal,Weak_Modal\nWILL,0,2009,0\nMAY,0,0,2009\nLOSS,2009,0,\n,1,1,1\n")
    words = records.lexicon(spark, str(tmp_path / "l.csv"))
    assert {tuple(r) for r in words.collect()} == {("will", "Strong_Modal"), ("may", "Weak_Modal"), ("loss", "Negative")}
    docs = spark.createDataFrame([(1, "We will grow fast")], "id long, text string")
    assert densities(docs, words, "id", "text").first()["Strong_Modal"] == 25.0


def test_records(spark, tmp_path):
    refs = spark.createDataFrame([("a", 0), ("b", 1)], "id string, label int")
    got = records.aligned(refs, spark.createDataFrame([("a", 1)], "id string, said int"), "id").orderBy("id").collect()
    assert [r["said"] for r in got] == [1, None]
    with pytest.raises(ValueError, match="unknown"):
        records.aligned(refs, spark.createDataFrame([("z", 1)], "id string, said int"), "id")
    with pytest.raises(ValueError, match="repeated"):
        records.aligned(refs, spark.createDataFrame([("a", 1), ("a", 1)], "id string, said int"), "id")
    records.export(refs.withColumn("claim", F.lit("c")), ["claim"], ["label"], "id", str(tmp_path / "out"))
    assert records.read(spark, str(tmp_path / "out" / "visible")).columns == ["claim", "id"]
    with pytest.raises(Exception, match="no gold label"):
        records.gold(refs.withColumn("g", F.lit("")), ["g"]).collect()
    assert records.select_by_hash(refs, "id", "1", 1).count() == 1
    p = F.create_map(F.lit("x"), F.lit(0.25), F.lit("y"), F.lit(0.75))
    assert spark.range(1).select(records.probabilities_hold(p, ["y", "x"]).alias("a"), records.probabilities_hold(p, ["x"]).alias("b")).first() == (True, False)
