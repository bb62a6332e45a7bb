"""Queries on events, filed facts, labels and pages. Roles: a user of events is a claim, an event's k its observation, orders are filed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions import numbers as N
from claimspark.operators import ledger, program, replay, scoring, verification
from claimspark.session import table
from claimspark.sources import html
from claimspark.streaming import ledger as live


def evidence(spark, d) -> DataFrame:
    return as_evidence(table(spark, d, "events"))


def as_evidence(events: DataFrame) -> DataFrame:
    """claim, seq, at, action, group, status, log_evidence, amount from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "error", "withdraw").when(F.col("event_type") == "signup", "correct").otherwise("admit")
    return events.select(
        F.col("user_id").alias("claim"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"),
        F.concat(F.lit("g"), (k % 7).cast("string")).alias("group"), F.col("event_type").alias("status"), ((F.round(F.col("value") * 100) - 2000) / 4096).alias("log_evidence"), F.col("value").alias("amount"), k.alias("k"),
    )


def judged(spark, d) -> DataFrame:
    """Labels with a score made from the document: y (quality), score, p, toxic, source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("text").alias("t"))
    score = F.least(F.lit(1.0), F.size(F.array_distinct(F.split("t", " "))) / F.size(F.split("t", " ")))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", F.round(score, 6).alias("score"), "source", "lang").withColumn("p", (F.col("score") >= 0.5).cast("int"))


def day(c: str):
    return F.col(c).cast("date")


def facts_verify_range_join(spark, d):
    """Each customer's order totals of a quarter as filed facts, and a claim on each of them, rounded or overstated."""
    o = table(spark, d, "orders")
    q = F.date_trunc("quarter", "o_orderdate").cast("date")
    filed = o.groupBy(F.col("o_custkey").alias("company"), q.alias("start")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    facts = filed.select("company", F.lit("orders").alias("tag"), "start", F.date_sub(F.add_months("start", 3), 1).alias("end"), (F.col("cents") / 100).alias("value"))
    stated = F.when(F.col("company") % 3 == 0, F.round(F.col("value"), -3)).otherwise(F.round(F.col("value") * 1.1, -3))
    period = F.format_string("%d-Q%d", F.year("start"), F.quarter("start"))
    claims = facts.select(F.concat_ws("-", "company", period).alias("claim"), "company", period.alias("period"), stated.alias("stated"), F.lit(500.0).alias("step"), F.array(F.lit("revenue"), F.lit("orders")).alias("tags"))
    return verification.verify(claims, facts)


def outcome_within_24_months(spark, d):
    """Calls: each customer's first order; events: their later orders of status P."""
    o = table(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("day"), "o_orderstatus")
    calls = o.groupBy(F.col("o_custkey").alias("company")).agg(F.min("day").alias("day")).select(F.col("company").alias("claim"), "company", "day")
    events = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("company"), F.date_add("day", 0).alias("filed"))
    return verification.outcomes(calls, events).withColumn("filed", F.col("filed").cast("string"))


def call_period(spark, d):
    return table(spark, d, "orders").groupBy(N.call_period(day("o_orderdate")).alias("period")).agg(F.count(F.lit(1)).alias("calls"))


def calculations(spark, d):
    """Every operation on each supplier nation's revenue of one year and the next."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    revenue = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    yearly = revenue.groupBy("l_suppkey", "year").agg(F.sum("cents").alias("cents")).join(s, "l_suppkey").groupBy("nation", "year").agg((F.sum("cents") / 100).alias("value"))
    after = yearly.select("nation", (F.col("year") - 1).alias("year"), F.col("value").alias("later"))
    both = yearly.join(after, ["nation", "year"]).withColumn("op", F.explode(F.array(*[F.lit(o) for o in ("subtract", "multiply", "divide", "pct_change", "share", "reduction", "compare", "add")])))
    return both.select("nation", "year", "op", F.round(N.calculate(F.col("op"), F.col("value"), F.col("later")) / F.when(F.col("op") == "multiply", 1e9).otherwise(1.0), 4).alias("result"))


def claim_relation_bounds(spark, d):
    """Claims made from parts: a bound or plain wording beside a number, tested against the size, which every fourth part writes as a fall."""
    wording = F.array(*[F.lit(w) for w in ("at least", "less than", "up to", "exactly", "between 1 and", "more than")])
    p = table(spark, d, "part").select("p_partkey", "p_size", F.element_at(wording, (F.col("p_partkey") % 6 + 1).cast("int")).alias("w"), (F.col("p_partkey") % 50 + 1).cast("string").alias("number"))
    claim = F.concat_ws(" ", F.lit("the size is"), "w", "number", F.when(F.col("p_partkey") % 11 == 0, "units or more").otherwise("units"))
    p = p.withColumn("claim", claim).withColumn("bound", N.bound(F.col("claim"), F.col("number")))
    return p.select("p_partkey", "claim", "bound", N.relation(F.when(F.col("p_partkey") % 4 == 0, -F.col("p_size")).otherwise(F.col("p_size")).cast("double"), F.col("number").cast("double"), N.half_step(F.col("number")), F.col("bound")).alias("relation"))


def parsed_numbers(spark, d):
    written = F.element_at(F.array(F.concat(F.lit("$ "), F.format_number("p_retailprice", 2)), F.concat(F.lit("("), F.col("p_size"), F.lit(")")), F.concat(F.col("p_size"), F.lit(".5%")), F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", written.alias("written")).select("p_partkey", "written", N.parse_number("written").cast("double").alias("value"))


PROGRAMS = [
    [("share", ["a", "b"], "s"), ("pct_change", ["a", "b"], "g"), ("divide", ["b", "n"], "each")],
    [("multiply", ["rate", "amount"], "x"), ("divide", ["x", "const_1000000"], "m"), ("add", ["m", "const_1", "const_10"], "k"), ("multiply", ["rate", "n"], "never")],
    [("add", ["a", "b"], "x"), ("reduction", ["b", "a"], "r"), ("subtract", ["r", "const_100"], "x"), ("compare", ["x", "a"], "c")],
    [("multiply", ["a", "const_1"], "x"), ("multiply", ["b", "const_1"], "y"), ("compare", ["x", "y"], "d"), ("divide", ["d", "amount"], "q"), ("multiply", ["x", "y"], "p"), ("sum", ["q", "const_7"], "z")],
]


def program_execute(spark, d):
    """A program for each order, of four kinds by its key: figures are the prices of its cheapest and its dearest line, of the years in which they were shipped and of
    lines returned or not, the lines but one, and a rate for the units."""
    line = lambda f: f(F.struct("l_extendedprice", "l_linenumber", F.year("l_shipdate").cast("string").alias("year"), "l_returnflag"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line(F.min).alias("lo"), line(F.max).alias("hi"), (F.count(F.lit(1)) - 1).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("units"))

    def figure(name, value, unit, period=None, population=None):
        null = F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).alias("unit"), (null if period is None else period).alias("period"), (null if population is None else population).alias("population"))

    price = lambda name, c: figure(name, F.col(f"{c}.l_extendedprice"), "USD", F.col(f"{c}.year"), F.col(f"{c}.l_returnflag"))
    inputs = [price("a", "lo"), price("b", "hi"), figure("n", F.col("n"), "lines"), figure("rate", F.lit("0.25"), "USD/unit"), figure("amount", F.col("units"), "units sold")]
    step = lambda op, args, out: F.struct(F.lit(op).alias("op"), F.array(*[F.lit(a) for a in args]).alias("args"), F.lit(out).alias("out"))
    steps = F.element_at(F.array(*[F.array(*[step(*x) for x in p]) for p in PROGRAMS]), (F.col("l_orderkey") % len(PROGRAMS) + 1).cast("int"))
    return program.execute(o.select(F.col("l_orderkey").alias("id"), F.array(*inputs).alias("inputs"), steps.alias("steps")))


def evidence_hash(spark, d):
    e = evidence(spark, d).groupBy("claim", "group").agg(F.count(F.lit(1)).alias("version"), (F.sum(F.when(F.col("action") == "withdraw", -1).otherwise(1)) > 0).alias("active"))
    return ledger.evidence_hash(e)


def scoring_units(spark, d):
    """Observations that one purchase names together are one unit: edges between a user's purchases' observations."""
    e = evidence(spark, d).where("status = 'purchase'")
    before = F.lag("k").over(W.partitionBy("claim").orderBy("seq"))
    edges = e.withColumn("b", before).where("b is not null").select(F.concat(F.lit("k"), "k").alias("a"), F.concat(F.lit("k"), "b").alias("b")).distinct()
    return ledger.units(edges)


def latest_scores(spark, d) -> DataFrame:
    e = evidence(spark, d).where("action = 'admit'").select("claim", "group", "seq", "log_evidence")
    return ledger.latest(e, ["claim", "group"], "seq")


def accumulate_log_odds(spark, d):
    """One unit's score is missing where it is beyond the limit of 5; such a claim has no probability."""
    s = latest_scores(spark, d).select("claim", F.col("group").alias("unit"), F.when(F.abs("log_evidence") <= 5, F.col("log_evidence")).alias("log_evidence"), F.lit(1.0).alias("weight"))
    return ledger.accumulate(s, 0.2).select("claim", "units", F.round("log_odds", 6).alias("log_odds"), F.round("probability", 6).alias("probability"))


def latest_versions(spark, d):
    return latest_scores(spark, d)


def assessment_history(spark, d):
    s = evidence(spark, d).select("claim", F.col("seq").alias("place"), (F.col("log_evidence") / 8).alias("log_evidence"))
    return ledger.history(s, 0.5).select("claim", "place", *[F.round(c, 6).alias(c) for c in ("value", "before", "change")])


def verdict_gate(spark, d):
    e = evidence(spark, d).select("claim", F.when(F.col("claim") % 2 == 0, "supported").otherwise("contradicted").alias("proposed"), F.when(F.col("status") == "view", "supports").when(F.col("status") == "click", "contradicts").otherwise("context").alias("relationship"), (F.col("k") > 60).alias("comparable"), (F.col("amount") > 30).alias("active"))
    return ledger.gate(e, "proposed")


def majority_vote(spark, d):
    return ledger.majority(evidence(spark, d).select("claim", F.col("seq").alias("place"), "status"))


def representative_per_group(spark, d):
    rank = F.row_number().over(W.partitionBy("claim", "group").orderBy((F.col("status") != "purchase").cast("int"), "k", "seq"))
    return evidence(spark, d).withColumn("r", rank).where("r = 1").select("claim", "group", "seq", "status")


def question_priority_topk(spark, d):
    """Parts as questions, brands as claims: the three of the greatest priority, and the share of materiality that is answered."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 3 + 1).alias("m"), (F.col("p_partkey") % 5 != 0).alias("open"), (F.col("p_partkey") % 3 + 1).alias("a"), (F.col("p_size") % 4 + 1).alias("c"))
    p = p.withColumn("priority", ledger.priority(F.col("m"), F.col("open"), F.col("a"), F.col("c"))).withColumn("coverage", F.sum(F.when(~F.col("open"), F.col("m")).otherwise(0)).over(W.partitionBy("p_brand")) / F.sum("m").over(W.partitionBy("p_brand")))
    p = p.where("priority > 0").withColumn("place", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("priority"), "p_partkey"))).where("place <= 3")
    return p.select("p_brand", "place", "p_partkey", F.round("priority", 6).alias("priority"), F.round("coverage", 6).alias("coverage"))


def withdrawals_final_state(spark, d):
    e = evidence(spark, d)
    left = ledger.after_withdrawals(e.where("action = 'admit'"), e.where("action = 'withdraw'"), ["claim", "group"])
    return left.groupBy("claim").agg(F.count_distinct("group").alias("groups"), F.count(F.lit(1)).alias("items"))


def replay_fold(spark, d):
    return replay.replay(evidence(spark, d)).withColumn("probability", F.round("probability", 9))


def duplicate_event_noop(spark, d):
    e = evidence(spark, d).select("claim", "group", "status")
    twice = e.unionByName(e)
    return twice.distinct().groupBy("claim").agg(F.count(F.lit(1)).alias("observations"))


def precision_recall(spark, d):
    out = scoring.precision_recall(judged(spark, d))
    return out.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def brier_nll(spark, d):
    return scoring.brier_nll(judged(spark, d)).select("n", F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"))


def aligned(spark, d) -> DataFrame:
    """Gold: languages; a prediction for every document with a text, made from its length."""
    docs = table(spark, d, "documents")
    gold = docs.select("doc_id", F.col("lang").alias("gold"))
    made = docs.where("length(text) > 0").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.length("text") % 4 + 1).cast("int")).alias("prediction"))
    return scoring.align(gold, made, "doc_id")


def align_predictions(spark, d):
    return scoring.confusion(aligned(spark, d))


def class_metrics(spark, d):
    return scoring.class_metrics(aligned(spark, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def grouping_sets_metrics(spark, d):
    lang, source = F.col("lang"), F.col("source")
    right = F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6)
    return judged(spark, d).groupingSets([[lang, source], [lang], []], lang, source).agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"))


def selective_error_coverage(spark, d):
    out = scoring.selective(judged(spark, d), F.abs(F.col("score") - 0.5) > 0.2)
    return out.select("attempted", "accepted", F.round("coverage", 6).alias("coverage"), F.round("error", 6).alias("error"))


def reliability_bins(spark, d):
    return scoring.reliability(judged(spark, d)).select("band", F.round("mean_score", 6).alias("mean_score"), F.round("rate", 6).alias("rate"), "n")


def isotonic_calibration(spark, d):
    return scoring.isotonic(judged(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("boundary", "value")])


def experiment_scorecard(spark, d):
    j = judged(spark, d).withColumn("said", F.when(F.abs(F.col("score") - 0.5) > 0.1, F.col("p")))
    committed = F.col("said").isNotNull()
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(committed).alias("committed"), F.round(F.avg((F.coalesce("said", F.lit(-1)) == F.col("y")).cast("double")), 6).alias("agreement"),
        F.round(F.avg(F.when(committed, (F.col("said") == F.col("y")).cast("double"))), 6).alias("right_when_committed"), F.round(F.greatest(F.avg("y"), 1 - F.avg("y")), 6).alias("floor"),
    )


def usage_rollup(spark, d):
    """Events as model calls: the kind is the model, the value its tokens in hundreds; prices are by kind, and one kind has none."""
    prices = spark.createDataFrame([("click", 2.0), ("view", 0.5), ("purchase", 8.0), ("signup", 1.0)], "status string, price double")
    calls = evidence(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("tokens"), F.count_if(F.col("amount") > 50).alias("failed"))
    return calls.join(F.broadcast(prices), "status", "left").select("status", "calls", "tokens", "failed", F.round(F.col("tokens") * F.col("price") / 1e6, 6).alias("cost"))


def dashboard_aggregates(spark, d):
    return evidence(spark, d).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("contradiction_rate"), F.count_distinct("claim").alias("claims"), F.round(F.avg((F.col("k") % 2 == 0).cast("double")), 6).alias("independent_share"),
    )


def temporal_replay(spark, d):
    """What each of four cutoffs admits of every customer's orders; a cutoff is a row of a small table."""
    cutoffs = F.array(*[F.lit(x).cast("date") for x in ("1996-01-01", "1998-01-01", "2000-01-01", "2002-01-01")])
    o = table(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("day"), F.explode(cutoffs).alias("cutoff"))
    return o.groupBy(F.col("cutoff").cast("string").alias("cutoff"), "o_custkey").agg(F.count_if(F.col("day") <= F.col("cutoff")).alias("admitted"), F.count_if(F.col("day") > F.col("cutoff")).alias("later"))


def html_spans(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html")
    return html.spans(p).select("doc", "i", "kind", "start", "end", F.md5("text").alias("digest"))


def html_title_links(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("links"))


def tumbling_windows(spark, d):
    out = live.tumbling(evidence(spark, d).select("at", F.col("status").alias("kind"), F.round(F.col("amount") * 100).cast("long").alias("value")), "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "kind", "n", "total")


def sliding_windows(spark, d):
    out = live.sliding(evidence(spark, d).select("at"), "2 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_tumbling(spark, d):
    """The tumbling windows of the events as a stream that is read to its end."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"))
    out = live.drained(live.tumbling(rows, "1 day"), "stream-tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "kind", "n", "total")


def stream_ledger(spark, d):
    """The replay of the events as a stream, each claim's ledger kept as state."""
    columns = evidence(spark, d).columns
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = as_evidence(events).select(*columns)
    return live.drained(live.live_ledger(rows), "stream-ledger", "append").withColumn("probability", F.round("probability", 9))


def session_windows(spark, d):
    out = live.sessions(evidence(spark, d).select("at", "claim"), "6 hours")
    return out.groupBy("claim").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_verify_range_join, outcome_within_24_months, call_period, calculations, claim_relation_bounds, parsed_numbers, program_execute, evidence_hash,
        scoring_units, accumulate_log_odds, latest_versions, assessment_history, verdict_gate, majority_vote, representative_per_group, question_priority_topk,
        withdrawals_final_state, replay_fold, duplicate_event_noop, precision_recall, brier_nll, align_predictions, class_metrics, grouping_sets_metrics,
        selective_error_coverage, reliability_bins, isotonic_calibration, experiment_scorecard, usage_rollup, dashboard_aggregates, temporal_replay, html_spans,
        html_title_links, tumbling_windows, sliding_windows, session_windows, stream_tumbling, stream_ledger,
    )
}

EV = """e AS (SELECT user_id AS claim, event_id AS seq, ts AS at, CASE event_type WHEN 'error' THEN 'withdraw' WHEN 'signup' THEN 'correct' ELSE 'admit' END AS action,
  'g' || (props->>'$.k')::INT % 7 AS grp, event_type AS status, (round(value * 100) - 2000) / 4096 AS log_evidence, value AS amount, (props->>'$.k')::INT AS k FROM events)"""
JUDGED = """j AS (SELECT *, (score >= 0.5)::INT AS p FROM (SELECT doc_id, quality AS y, toxic, round(least(1.0, len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' '))), 6) AS score, source, lang FROM labels JOIN documents USING (doc_id)))"""
ALIGNED = """a AS (SELECT g.doc_id, g.lang AS gold, coalesce(p.prediction, '__MISSING__') AS prediction FROM documents g LEFT JOIN (SELECT doc_id, ['en', 'fr', 'de', 'es'][length(text) % 4 + 1] AS prediction FROM documents WHERE length(text) > 0) p USING (doc_id))"""
LATEST = EV + ", l AS (SELECT claim, grp, max(seq) AS seq, arg_max(log_evidence, seq) AS log_evidence FROM e WHERE action = 'admit' GROUP BY claim, grp)"

ORACLES = {
    "facts_verify_range_join": """WITH f AS (SELECT o_custkey AS company, date_trunc('quarter', o_orderdate)::DATE AS start, sum(round(o_totalprice * 100)::BIGINT) / 100 AS value FROM orders GROUP BY ALL),
      c AS (SELECT *, year(start) || '-Q' || quarter(start) AS period, CASE WHEN company % 3 = 0 THEN round(value, -3) ELSE round(value * 1.1, -3) END AS stated FROM f)
      SELECT company || '-' || period AS claim, value AS filed, CASE WHEN abs(value - stated) <= 500 THEN 'supports' ELSE 'contradicts' END AS stance FROM c""",
    "outcome_within_24_months": """WITH c AS (SELECT o_custkey AS claim, min(o_orderdate)::DATE AS day FROM orders GROUP BY 1),
      h AS (SELECT claim, any_value(day) AS day, min(o_orderdate::DATE) FILTER (o_orderstatus = 'P' AND o_orderdate::DATE BETWEEN day AND (day + INTERVAL 24 MONTH)::DATE) AS filed FROM c JOIN orders ON o_custkey = claim GROUP BY claim)
      SELECT claim, filed::VARCHAR AS filed, (year(filed) - year(day)) * 12 + month(filed) - month(day) AS months_after, CASE WHEN filed IS NULL THEN 'not_found' ELSE 'context' END AS status FROM h""",
    "call_period": "SELECT year(x) || '-Q' || quarter(x) AS period, count(*) AS calls FROM (SELECT o_orderdate - INTERVAL 3 MONTH AS x FROM orders) GROUP BY 1",
    "calculations": """WITH y AS (SELECT s_nationkey AS nation, year(l_shipdate) AS year, sum(round(l_extendedprice * 100)::BIGINT) / 100 AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
      b AS (SELECT a.nation, a.year, a.v AS a, n.v AS b FROM y a JOIN y n ON n.nation = a.nation AND n.year = a.year + 1)
      SELECT nation, year, op, round(CASE op WHEN 'subtract' THEN a - b WHEN 'compare' THEN a - b WHEN 'add' THEN a + b WHEN 'multiply' THEN a * b / 1e9 WHEN 'divide' THEN a / b WHEN 'share' THEN a / b * 100 WHEN 'pct_change' THEN (b - a) / a * 100 ELSE (1 - b / a) * 100 END, 4) AS result
      FROM b, (SELECT unnest(['subtract', 'multiply', 'divide', 'pct_change', 'share', 'reduction', 'compare', 'add']) AS op)""",
    "claim_relation_bounds": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN -p_size ELSE p_size END AS p_size, ['at least', 'less than', 'up to', 'exactly', 'between 1 and', 'more than'][p_partkey % 6 + 1] AS w, p_partkey % 50 + 1 AS number FROM part),
      c AS (SELECT *, concat_ws(' ', 'the size is', w, number, CASE WHEN p_partkey % 11 = 0 THEN 'units or more' ELSE 'units' END) AS claim,
        CASE WHEN w = 'between 1 and' AND number <> 1 THEN 'range' WHEN w = 'at least' THEN 'ge' WHEN w = 'less than' THEN 'lt' WHEN w = 'up to' THEN 'le' WHEN w = 'more than' THEN 'gt' WHEN p_partkey % 11 = 0 THEN 'ge' ELSE 'plain' END AS bound FROM p)
      SELECT p_partkey, claim, CASE WHEN w = 'between 1 and' AND number = 1 THEN 'range' ELSE bound END AS bound, CASE WHEN bound = 'range' OR w = 'between 1 and' THEN 'none' WHEN p_size < 0 AND (bound <> 'plain' OR abs(-p_size - number) <= 0.5) THEN 'none' WHEN CASE bound WHEN 'ge' THEN p_size >= number - 0.5 WHEN 'gt' THEN p_size > number - 0.5 WHEN 'le' THEN p_size <= number + 0.5 WHEN 'lt' THEN p_size < number + 0.5 ELSE abs(p_size - number) <= 0.5 END THEN 'agrees' ELSE 'disagrees' END AS relation FROM c""",
    "parsed_numbers": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$ ' || format('{:,.2f}', p_retailprice) WHEN 1 THEN '(' || p_size || ')' WHEN 2 THEN p_size || '.5%' ELSE p_name END AS written,
      CASE p_partkey % 4 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN -p_size::DOUBLE WHEN 2 THEN p_size + 0.5 END AS value FROM part""",
    "evidence_hash": f"WITH {EV}, g AS (SELECT claim, grp, count(*) AS version, sum(CASE WHEN action = 'withdraw' THEN -1 ELSE 1 END) > 0 AS active FROM e GROUP BY claim, grp) SELECT claim, sha256(coalesce(string_agg(grp || ':' || version, '|' ORDER BY grp || ':' || version) FILTER (active), ''))[1:16] AS evidence_hash FROM g GROUP BY claim",
    "scoring_units": f"""WITH RECURSIVE {EV}, x AS (SELECT 'k' || k AS a, 'k' || lag(k) OVER (PARTITION BY claim ORDER BY seq) AS b FROM e WHERE status = 'purchase'),
      y AS (SELECT a, b FROM x WHERE b IS NOT NULL UNION SELECT b, a FROM x WHERE b IS NOT NULL), r(n, m) AS (SELECT a, a FROM y UNION SELECT r.n, y.b FROM r JOIN y ON y.a = r.m), l AS (SELECT n, min(m) AS unit FROM r GROUP BY n)
      SELECT unit, count(*) AS members, sha256(string_agg(n, '+' ORDER BY n)) AS key FROM l GROUP BY unit""",
    "accumulate_log_odds": f"WITH {LATEST}, a AS (SELECT claim, count(*) AS units, CASE WHEN count(*) = count(*) FILTER (abs(log_evidence) <= 5) THEN ln(0.2) - ln(0.8) + sum(log_evidence) END AS o FROM l GROUP BY claim) SELECT claim, units, round(o, 6) AS log_odds, round(1 / (1 + exp(-o)), 6) AS probability FROM a",
    "latest_versions": f'WITH {LATEST} SELECT claim, grp AS "group", seq, log_evidence FROM l',
    "assessment_history": f"""WITH {EV}, v AS (SELECT claim, seq AS place, 1 / (1 + exp(-sum(log_evidence / 8) OVER (PARTITION BY claim ORDER BY seq))) AS value FROM e),
      b AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY claim ORDER BY place), 0.5) AS before FROM v) SELECT claim, place, round(value, 6) AS value, round(before, 6) AS before, round(value - before, 6) AS change FROM b""",
    "verdict_gate": f"""WITH {EV}, g AS (SELECT claim, CASE WHEN claim % 2 = 0 THEN 'supported' ELSE 'contradicted' END AS proposed, bool_or(status = 'view' AND k > 60 AND amount > 30) AS s, bool_or(status = 'click' AND k > 60 AND amount > 30) AS c FROM e GROUP BY claim)
      SELECT claim, proposed, CASE WHEN (proposed = 'supported' AND NOT s) OR (proposed = 'contradicted' AND NOT c) THEN 'insufficient' ELSE proposed END AS status FROM g""",
    "majority_vote": f"WITH {EV}, c AS (SELECT claim, status, count(*) AS n, min(seq) AS p FROM e GROUP BY claim, status) SELECT claim, status, n FROM c QUALIFY row_number() OVER (PARTITION BY claim ORDER BY n DESC, p) = 1",
    "representative_per_group": f"""WITH {EV} SELECT claim, grp AS "group", seq, status FROM e QUALIFY row_number() OVER (PARTITION BY claim, grp ORDER BY status <> 'purchase', k, seq) = 1""",
    "question_priority_topk": """WITH p AS (SELECT p_brand, p_partkey, p_size % 3 + 1 AS m, p_partkey % 5 <> 0 AS o, p_partkey % 3 + 1 AS a, p_size % 4 + 1 AS c FROM part),
      q AS (SELECT *, m * o::INT * a / (c + 0.5) AS priority, sum(CASE WHEN NOT o THEN m ELSE 0 END) OVER (PARTITION BY p_brand) / sum(m) OVER (PARTITION BY p_brand) AS coverage FROM p)
      SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) AS place, p_partkey, round(priority, 6) AS priority, round(coverage, 6) AS coverage FROM q WHERE priority > 0 QUALIFY place <= 3""".replace("priority > 0", "q.priority > 0").replace("ORDER BY priority", "ORDER BY q.priority").replace("round(priority", "round(q.priority"),
    "withdrawals_final_state": f"WITH {EV} SELECT claim, count(DISTINCT grp) AS groups, count(*) AS items FROM e WHERE action = 'admit' AND NOT EXISTS (SELECT 1 FROM e w WHERE w.action = 'withdraw' AND w.claim = e.claim AND w.grp = e.grp) GROUP BY claim",
    "replay_fold": f"""WITH {EV}, s AS (SELECT *, CASE action WHEN 'admit' THEN 1 WHEN 'withdraw' THEN -1 ELSE 0 END AS step FROM e), t AS (SELECT *, sum(step) OVER g AS total FROM s WINDOW g AS (PARTITION BY claim, grp ORDER BY seq)),
      i AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY claim, grp ORDER BY seq)) AS items FROM t), h AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY claim, grp ORDER BY seq), 0) AS had FROM i),
      x AS (SELECT *, CASE WHEN items > 0 THEN last_value(CASE WHEN (step = 1 AND had = 0) OR (step = 0 AND had > 0) THEN log_evidence END IGNORE NULLS) OVER (PARTITION BY claim, grp ORDER BY seq) ELSE 0 END AS now FROM h),
      y AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY claim, grp ORDER BY seq), 0) AS was FROM x),
      z AS (SELECT claim, seq, action, ((items > 0) <> (had > 0)) OR (step = 0 AND had > 0 AND now <> was) AS changed, sum((items > 0)::INT - (had > 0)::INT) OVER (PARTITION BY claim ORDER BY seq)::BIGINT AS active, sum(now - was) OVER (PARTITION BY claim ORDER BY seq) AS o FROM y)
      SELECT claim, seq, action, active, changed, round(CASE WHEN o >= 0 THEN 1 / (1 + exp(-o)) ELSE exp(o) / (1 + exp(o)) END, 9) AS probability FROM z""",
    "duplicate_event_noop": f"WITH {EV} SELECT claim, count(DISTINCT (grp, status)) AS observations FROM e GROUP BY claim",
    "precision_recall": f"WITH {JUDGED}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn FROM j) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c",
    "brier_nll": f"WITH {JUDGED}, c AS (SELECT y, score, least(greatest(score, 1e-12), 1 - 1e-12) AS s FROM j) SELECT count(*) AS n, round(avg((score - y) ** 2), 6) AS brier, round(-avg(y * ln(s) + (1 - y) * ln(1 - s)), 6) AS nll FROM c",
    "align_predictions": f"WITH {ALIGNED} SELECT gold, prediction, count(*) AS n FROM a GROUP BY ALL",
    "class_metrics": f"""WITH {ALIGNED}, l AS (SELECT DISTINCT gold AS label FROM a UNION SELECT DISTINCT prediction FROM a WHERE prediction <> '__MISSING__'),
      c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND prediction = label) AS hit, count(*) FILTER (prediction = label) AS made FROM l, a GROUP BY label),
      m AS (SELECT label, coalesce(hit / nullif(made, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support FROM c)
      SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m""",
    "grouping_sets_metrics": f"WITH {JUDGED} SELECT lang, source, count(*) AS n, round(avg((y = p)::DOUBLE), 6) AS accuracy FROM j GROUP BY GROUPING SETS ((lang, source), (lang), ())",
    "selective_error_coverage": f"WITH {JUDGED}, c AS (SELECT count(*) AS attempted, count(*) FILTER (abs(score - 0.5) > 0.2) AS accepted, avg((y <> p)::DOUBLE) FILTER (abs(score - 0.5) > 0.2) AS error FROM j) SELECT attempted, accepted, round(accepted / nullif(attempted, 0), 6) AS coverage, round(error, 6) AS error FROM c",
    "reliability_bins": f"WITH {JUDGED} SELECT CASE WHEN score < 1/5 THEN 0 WHEN score < 2/5 THEN 1 WHEN score < 3/5 THEN 2 WHEN score < 4/5 THEN 3 ELSE 4 END AS band, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate, count(*) AS n FROM j GROUP BY 1",
    "experiment_scorecard": f"""WITH {JUDGED}, s AS (SELECT *, CASE WHEN abs(score - 0.5) > 0.1 THEN p END AS said FROM j) SELECT lang, count(*) AS scored, count(said) AS committed, round(avg((coalesce(said, -1) = y)::DOUBLE), 6) AS agreement,
      round(avg((said = y)::DOUBLE), 6) AS right_when_committed, round(greatest(avg(y), 1 - avg(y)), 6) AS floor FROM s GROUP BY lang""",
    "usage_rollup": f"WITH {EV}, c AS (SELECT status, count(*) AS calls, sum(round(amount * 100)::BIGINT)::BIGINT AS tokens, count(*) FILTER (amount > 50) AS failed FROM e GROUP BY status), p(status, price) AS (VALUES ('click', 2.0::DOUBLE), ('view', 0.5), ('purchase', 8.0), ('signup', 1.0)) SELECT status, calls, tokens, failed, round(tokens * price / 1e6, 6) AS cost FROM c LEFT JOIN p USING (status)",
    "dashboard_aggregates": f"WITH {EV} SELECT at::DATE::VARCHAR AS day, count(*) AS total, round(avg((status = 'error')::DOUBLE), 6) AS contradiction_rate, count(DISTINCT claim) AS claims, round(avg((k % 2 = 0)::DOUBLE), 6) AS independent_share FROM e GROUP BY 1".replace("at::DATE", "e.at::DATE"),
    "temporal_replay": "SELECT cutoff::VARCHAR AS cutoff, o_custkey, count(*) FILTER (o_orderdate::DATE <= c.cutoff) AS admitted, count(*) FILTER (o_orderdate::DATE > c.cutoff) AS later FROM orders, (VALUES (DATE '1996-01-01'), (DATE '1998-01-01'), (DATE '2000-01-01'), (DATE '2002-01-01')) c(cutoff) GROUP BY ALL",
    "html_title_links": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""",
    "tumbling_windows": f"WITH {EV} SELECT strftime(time_bucket(INTERVAL 1 DAY, e.at), '%Y-%m-%d %H:%M:%S') AS start, status AS kind, count(*) AS n, sum(round(amount * 100)::BIGINT)::BIGINT AS total FROM e GROUP BY ALL",
    "sliding_windows": f"WITH {EV} SELECT strftime(date_trunc('day', e.at) - INTERVAL (i) DAY, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM e, range(2) r(i) GROUP BY ALL",
    "session_windows": f"""WITH {EV}, g AS (SELECT claim, e.at AS t, CASE WHEN e.at - lag(e.at) OVER (PARTITION BY claim ORDER BY e.at, seq) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, seq FROM e),
      s AS (SELECT claim, sum(new) OVER (PARTITION BY claim ORDER BY t, seq) AS s FROM g), c AS (SELECT claim, s, count(*) AS n FROM s GROUP BY claim, s) SELECT claim, count(*) AS sessions, max(n) AS longest FROM c GROUP BY claim""",
}
ORACLES["stream_tumbling"] = ORACLES["tumbling_windows"]
ORACLES["stream_ledger"] = ORACLES["replay_fold"]

#: Programs, step by step by recursion. A figure is (name, value, unit, period, population); `got` are a step's arguments.
PROGRAM_SQL = """WITH RECURSIVE o AS (
  SELECT l_orderkey AS id, min({'v': l_extendedprice, 'n': l_linenumber, 'y': year(l_shipdate), 'f': l_returnflag}) AS lo, max({'v': l_extendedprice, 'n': l_linenumber, 'y': year(l_shipdate), 'f': l_returnflag}) AS hi,
         count(*) - 1 AS n, sum(l_quantity::BIGINT) AS units FROM lineitem GROUP BY 1
), prog AS (
  SELECT id::VARCHAR AS id, [(SELECTED)][id % 4 + 1] AS steps,
    list_transform([1, 10, 100, 1000, 1000000, 1000000000], lambda c: {'name': 'const_' || c, 'value': c::DOUBLE, 'unit': '', 'period': '', 'population': ''})
    || [{'name': 'a', 'value': lo.v::DOUBLE, 'unit': 'USD', 'period': lo.y::VARCHAR, 'population': lo.f}, {'name': 'b', 'value': hi.v::DOUBLE, 'unit': 'USD', 'period': hi.y::VARCHAR, 'population': hi.f},
        {'name': 'n', 'value': n::DOUBLE, 'unit': 'lines', 'period': '', 'population': ''}, {'name': 'rate', 'value': 0.25::DOUBLE, 'unit': 'USD/unit', 'period': '', 'population': ''},
        {'name': 'amount', 'value': units::DOUBLE, 'unit': 'units sold', 'period': '', 'population': ''}] AS figs
  FROM o
), run(id, k, steps, figs, out, value, unit, period, error) AS (
  SELECT id, 0, steps, figs, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM prog
  UNION ALL
  SELECT id, k + 1, steps, CASE WHEN e IS NULL THEN list_append(figs, {'name': o, 'value': v, 'unit': u, 'period': p, 'population': s}) ELSE figs END,
         o, CASE WHEN e IS NULL THEN v END, CASE WHEN e IS NULL THEN u END, CASE WHEN e IS NULL THEN nullif(p, '') END, e
  FROM (
    SELECT *, CASE WHEN len(got) < 2 OR len(list_filter(got, lambda g: g IS NULL)) > 0 THEN 'arguments'
      WHEN op IN ('add', 'subtract', 'sum', 'compare', 'pct_change', 'reduction', 'share') AND len(us) > 1 THEN 'units'
      WHEN op IN ('compare', 'pct_change', 'reduction') AND len(ss) > 1 THEN 'scope'
      WHEN op IN ('pct_change', 'reduction') AND x.period <> '' AND y.period <> '' AND x.period > y.period THEN 'order'
      WHEN op = 'multiply' AND x.period <> '' AND y.period <> '' AND x.period <> y.period THEN 'periods'
      WHEN u IS NULL THEN 'units' WHEN raw IS NULL THEN CASE WHEN op = 'reduction' THEN 'base' ELSE 'zero' END END AS e, printf('%.14e', raw)::DOUBLE AS v
    FROM (
      SELECT *, CASE WHEN len(ps) = 1 THEN ps[1] ELSE '' END AS p, CASE WHEN len(ss) = 1 THEN ss[1] ELSE '' END AS s,
        CASE op WHEN 'divide' THEN CASE WHEN y.unit = '' THEN x.unit WHEN x.unit = y.unit THEN 'ratio' ELSE x.unit || '/' || y.unit END WHEN 'multiply' THEN
            CASE WHEN x.unit = 'USD/unit' AND y.unit = 'units sold' THEN 'USD' WHEN x.unit = '' OR y.unit = '' THEN x.unit || y.unit WHEN NOT contains(x.unit || y.unit, '/') THEN x.unit || '*' || y.unit END
          WHEN 'share' THEN '%' WHEN 'pct_change' THEN '%' WHEN 'reduction' THEN '%' ELSE coalesce(us[1], '') END AS u,
        CASE op WHEN 'add' THEN list_sum(list_transform(got, lambda g: g.value)) WHEN 'sum' THEN list_sum(list_transform(got, lambda g: g.value)) WHEN 'subtract' THEN x.value - y.value WHEN 'compare' THEN x.value - y.value
          WHEN 'multiply' THEN x.value * y.value WHEN 'divide' THEN CASE WHEN y.value <> 0 THEN x.value / y.value END WHEN 'share' THEN CASE WHEN y.value <> 0 THEN x.value / y.value * 100 END
          WHEN 'pct_change' THEN CASE WHEN x.value <> 0 THEN (y.value - x.value) / x.value * 100 END ELSE CASE WHEN x.value > 0 THEN (1 - y.value / x.value) * 100 END END AS raw
      FROM (
        SELECT *, got[1] AS x, got[2] AS y, list_distinct(list_filter(list_transform(got, lambda g: g.unit), lambda t: t <> '')) AS us, list_distinct(list_filter(list_transform(got, lambda g: g.population), lambda t: t <> '')) AS ss,
               list_distinct(list_filter(list_transform(got, lambda g: g.period), lambda t: t <> '')) AS ps
        FROM (
          SELECT id, k, steps, figs, steps[k + 1].op AS op, steps[k + 1].out AS o, list_transform(steps[k + 1].args, lambda a: list_filter(figs, lambda f: f.name = a)[-1]) AS got
          FROM run WHERE error IS NULL AND k < len(steps)
        )
      )
    )
  )
)
SELECT id, out, value, unit, period, error FROM run WHERE k > 0""".replace("(SELECTED)", ", ".join("[" + ", ".join(f"{{'op': '{op}', 'args': {args}, 'out': '{out}'}}" for op, args, out in p) + "]" for p in PROGRAMS))
ORACLES["program_execute"] = PROGRAM_SQL
