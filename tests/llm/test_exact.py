"""Exact duplicates: codes, owners and marks by themselves, whole results against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimspark.llm import common, exact


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=50))
def test_codes_round_trip(gaps):
    gaps = np.array(gaps, np.int64)
    k, code = exact.coded(gaps)
    if k < 12 and len(gaps) and gaps.max() >> k > 1 << 20:
        return  # one huge gap among small ones is long in unary; sorted fingerprints have none
    assert exact.decoded(code, k, len(gaps)).tolist() == gaps.tolist()


def test_sorted_fingerprints_take_few_bits():
    keys = np.sort(np.random.default_rng(1).choice(1 << 29, 1 << 17, replace=False))
    k, code = exact.coded(np.diff(keys, prepend=0))
    assert len(code) * 8 / len(keys) < 29 - 17 + 2 and np.cumsum(exact.decoded(code, k, len(keys))).tolist() == keys.tolist()


@pytest.mark.parametrize("rows", [0, 1, 7, 10**6, 10**10])
def test_every_fingerprint_has_an_owner(rows):
    owners = exact.Owners(rows)
    keys = owners.fingerprints(np.array([0, 1, (1 << 60) - 1, 12345 << 40]))
    at = owners.parts(np.unique(keys))
    assert at[0] == 0 and at[-1] == len(np.unique(keys)) and (np.diff(at) >= 0).all()


def brute(rows):
    """(id, keep_id, group_size, sha) and the number of rows kept, by (id, n_chars) order."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate({ord(c): None for c in exact.SPACE})].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return out, len(groups)


def check(spark, rows, parts=5):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sha string, part int").repartition(parts)
    found = exact.exact_duplicates(docs).collect()
    want, kept = brute(rows)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found)
    assert sum(r["kept"] for r in found) == kept and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


ODD = [(None, "no id"), (None, "no  id"), (None, "no id"), (3, "a repeated id"), (3, "a repeated id"), (500, None), (501, ""), (502, " \x0b\x0c\r\n\t"), (503, "\x85　"), (504, "　\x85"), (505, "é漢😀" * 100_000), (506, "é 漢😀" + "é漢😀" * 99_999)]


@pytest.mark.parametrize("chunk,hot", [(17, 10_000), (6, 20)])
def test_against_brute_force(spark, monkeypatch, chunk, hot):
    """Small parts and small hot groups as well as the usual sizes."""
    monkeypatch.setattr(exact, "CHUNK_BITS", chunk)
    monkeypatch.setattr(exact, "OWNED", 100 if chunk == 6 else exact.OWNED)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_SHARE", 1 if hot == 20 else common.HOT_SHARE)
    monkeypatch.setattr(exact, "EXTRA", 1 if chunk == 6 else exact.EXTRA)  # many suspects by chance
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "b", "ab", "c\t", "d"]) for _ in range(r.randint(1, 7)))) for i in range(400)]
    rows += [(1000 + i, "the one text of a third of all rows" + " " * (i % 3)) for i in range(300)]
    check(spark, [*rows, *ODD])


def test_empty_table(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_ids_and_kept_documents(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "xy", 2), ("c", "x\ty", 3), (None, "z", 4)], "name string, body string, kept int")
    found = {r["name"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(docs, id_col="name", text_col="body").collect()}
    assert found == {"a": ("b", 3), "b": ("b", 3), "c": ("b", 3), None: (None, 1)}
    kept = exact.keep_one(docs, id_col="name", text_col="body")
    assert kept.columns == docs.columns and sorted(r["kept"] for r in kept.collect()) == [1, 4]


def test_equal_digests_are_told_apart_by_bytes(spark, monkeypatch):
    """Texts of one digest and other bytes are two groups."""
    real = F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: real(F.lit("same"), n))
    docs = spark.createDataFrame([(1, "x"), (2, "x "), (3, "y"), (4, "z"), (5, "z")], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(docs).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2)}


def test_only_messages_are_shuffled(spark, sf):
    """The stored table isn't shuffled for the exchange."""
    docs = common.narrow(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    owners, all_ = exact.Owners(200), spark.table(exact.stored(docs, 200))
    light = all_.select("part", "place", "key")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sent = exact.messages(light, owners)
    assert "Exchange" not in plan(sent)
    answers = exact.replies(sent)
    assert plan(answers).count("Exchange hash") == 1 and plan(exact.marked(light, answers, owners)).count("Exchange hash") == 2
    marks = spark.createDataFrame([], "part long, words array<long>").hint("shuffle_hash")
    joined = plan(all_.join(marks, "part", "left"))
    assert joined.count("Exchange hash") == 1 and "ShuffledHashJoin" in joined
