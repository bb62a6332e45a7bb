"""Media types, characters and re-admission."""

import datetime

from pyspark.sql import functions as F

from claimspark.sources import calls, documents


def test_files_to_spans(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<html><meta charset='iso-8859-2'><p>\xb1 rise of 4%.</p><h2>Issue</h2></html>")
    (tmp_path / "b.HTM").write_bytes("<p>Über <b>uns</b>.</p>".encode())
    (tmp_path / "c.txt").write_bytes("﻿One. Two.\n\nThree é.".encode())
    (tmp_path / "d.txt").write_bytes(b"caf\xe9 \x80 5")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f").write_bytes(b"no ending")
    read = documents.files(spark, str(tmp_path)).withColumn("document", F.regexp_extract("path", "([^/]+)$", 1))
    assert {r["document"]: documents_flag for r, documents_flag in ((r, r["flag"]) for r in read.select("document", documents.flags(F.col("media_type")).alias("flag")).collect())} == {"a.html": None, "b.HTM": None, "c.txt": None, "d.txt": None, "e.pdf": documents.UNREAD, "f": documents.UNREAD}
    found = {}
    for r in documents.spans(read).orderBy("document", "i").collect():
        found.setdefault(r["document"], []).append((r["kind"], r["text"], r["start"], r["end"]))
    assert found == {
        "a.html": [("paragraph", "ą rise of 4%.", 0, 13), ("heading", "Issue", 15, 20)], "b.HTM": [("paragraph", "Über uns.", 0, 9)],
        "c.txt": [("paragraph", "One. Two.", 0, 9), ("paragraph", "Three é.", 11, 19)], "d.txt": [("paragraph", "café € 5", 0, 8)],
    }


def test_the_media_type_may_declare_the_characters(spark):
    df = spark.createDataFrame([(b"\xb1", "text/plain; charset=ISO-8859-2"), (b"\xb1", "text/plain; charset=nonsense"), (b"\xb1", None), (None, "text/plain")], "content binary, media_type string")
    assert [r[0] for r in df.select(documents.decoded(F.col("content"), F.col("media_type"))).collect()] == ["ą", "±", "±", None]


def test_admission(spark):
    day = lambda n: datetime.date(2024, 1, n)
    arrive = "content binary, media_type string, url string, published date, admissible date, retrieved date"
    arriving = spark.createDataFrame(
        [(b"a", "text/html", "u2", day(2), None, day(9)), (b"a", "text/plain", "u1", None, day(5), day(8)), (b"b", "text/plain", None, day(3), None, day(7)), (b"c", "text/plain", "u", None, None, day(6)), (None, "text/plain", "x", None, None, day(1))], arrive)
    ids = {x: r[0] for x in "abcd" for r in spark.createDataFrame([(x.encode(),)], "content binary").select(documents.document_id(F.col("content"))).collect()}
    store = "document string, sha256 string, media_type string, url string, published date, admissible date, retrieved date, parser string"
    stored = spark.createDataFrame([(ids["a"], "s", "text/plain", None, day(1), None, day(1), "old"), (ids["c"], "s", "text/html", "mine", None, None, day(1), documents.PARSER), (ids["d"], "s", "text/html", "d", None, None, day(1), "old")], store)
    got = {r["document"]: r for r in documents.admitted(arriving, stored).collect()}
    pick = lambda x, *names: tuple(got[ids[x]][n] for n in names)
    names = ("media_type", "url", "published", "admissible", "retrieved", "parser", "stale")
    assert len(got) == 4
    assert pick("a", *names) == ("text/plain", "u1", day(1), day(5), day(9), documents.PARSER, True)
    assert pick("b", *names) == ("text/plain", None, day(3), day(3), day(7), documents.PARSER, False)
    assert pick("c", *names) == ("text/html", "mine", None, None, day(6), documents.PARSER, False)
    assert pick("d", *names) == ("text/html", "d", None, None, day(1), "old", False)
    span = "document string, i int, text string"
    old = spark.createDataFrame([(ids["a"], 0, "old 0"), (ids["a"], 7, "old 7"), (ids["c"], 0, "kept"), (ids["d"], 0, "as it was")], span)
    fresh = spark.createDataFrame([(ids["a"], 0, "new 0"), (ids["c"], 0, "again")], span)
    merged = documents.merged_spans(old, fresh, documents.admitted(arriving, stored))
    assert sorted(r["text"] for r in merged.collect()) == ["again", "as it was", "new 0"]


def test_listing(spark, tmp_path):
    for name, file in (("b_call", "text.txt"), ("a_call", "text.txt"), ("none", "other.txt")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text("x")
    assert [r["call"] for r in calls.listing(spark, str(tmp_path)).collect()] == ["a_call", "b_call"]
