"""The registered queries run over whole tables: small tables whose rows no id subset would cover."""

import hashlib
import json
import re
from datetime import date, datetime

from claimspark.plans import catalogue


def put(df, d, name):
    df.write.parquet(f"{d}/{name}.parquet")


def test_scoring_units_joins_every_claims_purchases(spark, tmp_path):
    runs = {1: [2, 3, 4], 2: [13, 17], 3: [17, 25], 4: [30], 5: [41, 41], 16: [50, 52]}
    rows = [(i, c, k) for i, (c, k) in enumerate((c, k) for c, ks in runs.items() for k in ks)]
    events = [(i, c, datetime(2024, 1, 1), "purchase", 1.0, json.dumps({"k": k})) for i, c, k in rows] + [(99, 1, datetime(2024, 1, 1), "view", 1.0, '{"k": 13}')]
    put(spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, value double, props string"), tmp_path, "events")
    groups = []
    for ks in runs.values():
        if len(ks) > 1:
            new = {f"k{k}" for k in ks}
            groups = [g for g in groups if not g & new] + [new.union(*[g for g in groups if g & new])]
    want = sorted((min(g), len(g), hashlib.sha256("+".join(sorted(g)).encode()).hexdigest()) for g in groups)
    assert len(want) == 4
    assert sorted((r["unit"], r["members"], r["key"]) for r in catalogue.QUERIES["scoring_units"](spark, str(tmp_path)).collect()) == want


def test_verify_has_a_claim_for_each_fact(spark, tmp_path):
    orders = [(i, c, date(1996, m, 5), 1000.0 * i + 700) for i, (c, m) in enumerate([(c, m) for c in (1, 2, 3) for m in (1, 2, 7)], 1)]
    put(spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double"), tmp_path, "orders")
    want = {}
    for _, c, day, price in orders:
        key = f"{c}-1996-Q{(day.month + 2) // 3}"
        want[key] = want.get(key, 0.0) + price
    found = {r["claim"]: (r["filed"], r["stance"]) for r in catalogue.QUERIES["facts_verify_range_join"](spark, str(tmp_path)).collect()}
    assert found == {k: (v, "supports" if abs(v - round(v if k[0] == "3" else v * 1.1, -3)) <= 500 else "contradicts") for k, v in want.items()}


def test_predictions_for_every_text(spark, tmp_path):
    texts = ["", None, "a", "ab", "abc", "abcd", "abcde", "abcdef"]
    docs = [(i, ["en", "fr", "de", "es"][i % 4], t) for i, t in enumerate(texts)]
    put(spark.createDataFrame(docs, "doc_id long, lang string, text string"), tmp_path, "documents")
    want = {}
    for _, lang, t in docs:
        key = (lang, ["en", "fr", "de", "es"][len(t) % 4] if t else "__MISSING__")
        want[key] = want.get(key, 0) + 1
    found = {(r["gold"], r["prediction"]): r["n"] for r in catalogue.QUERIES["align_predictions"](spark, str(tmp_path)).collect()}
    assert found == want
    recall = {r["label"]: r["recall"] for r in catalogue.QUERIES["class_metrics"](spark, str(tmp_path)).collect()}
    assert recall == {x: round(want.get((x, x), 0) / 2, 6) for x in ("en", "fr", "de", "es")}


def test_provenance_groups_of_every_language(spark, tmp_path):
    texts = [("en", "Net sales rose."), ("fr", "net SALES rose"), (None, "Net, sales; rose!"), ("fr", "L'ÉTÉ à Évian"), ("fr", "l été À évian."), ("de", "GRÖSSE über alles"), ("de", "Größe über alles"), ("es", "AÑO nuevo"), ("es", "año, nuevo"), ("es", "...")]
    put(spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string"), tmp_path, "documents")
    want = {}
    for i, (_, t) in enumerate(texts):
        key = "grp-" + hashlib.sha256(re.sub(r"\W+", " ", t.lower()).strip().encode()).hexdigest()[:12]
        n, first = want.get(key, (0, i))
        want[key] = n + 1, first
    found = {r["group"]: (r["members"], r["first"]) for r in catalogue.QUERIES["provenance_groups"](spark, str(tmp_path)).collect()}
    assert found == want and sorted(n for n, _ in want.values()) == [1, 1, 1, 2, 2, 3]
