"""The record of a finding, and a stored state as an ordered trace of events.

A record is kept as rows: one head for each finding, and a row for each thing in it (a piece of evidence, a question, a call), so nothing of a claim
that has a great many has to fit into one row. `nested` makes one row of a record, for records that a reader can take in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators.running import running_totals
from claimspark.operators.scoring import ratio
from claimspark.operators.sizes import broadcast_if_small

#: Fixed value: the title of a document that has neither heading nor address.
UNTITLED = "Pasted text"
#: Parts of a record in their order.
EVIDENCE, QUESTIONS, CALLS = "evidence", "questions", "calls"


def coverage_of(questions: DataFrame) -> DataFrame:
    """claim, coverage, asked: the share of materiality that is answered of (claim, question, materiality, status); 0 without any."""
    answered = F.sum(F.when(F.col("status") == "answered", F.col("materiality")).otherwise(0.0))
    out = questions.groupBy("claim").agg(answered.alias("answered"), F.sum("materiality").alias("all"), F.count(F.lit(1)).alias("asked"))
    return out.select("claim", F.coalesce(ratio(F.col("answered"), F.col("all")), F.lit(0.0)).alias("coverage"), "asked")


def usage_of(calls: DataFrame) -> DataFrame:
    """analysis, calls, tokens, latency, errors of (analysis, place, tokens_in, tokens_out, latency, error)."""
    tokens = F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))
    return calls.groupBy("analysis").agg(F.count(F.lit(1)).alias("calls"), tokens.alias("tokens"), F.coalesce(F.sum("latency"), F.lit(0)).alias("latency"), F.count("error").alias("errors"))


def heads(findings: DataFrame, claims: DataFrame, documents: DataFrame, evidence: DataFrame, questions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each finding (finding, claim, analysis, document, status, created): with the claim's text, its document's url and title, when it was
    made, coverage and the numbers of its parts, and the usage of its analysis.

    A finding whose claim or document isn't held has an empty text and the title of a pasted one; a title is the heading, else the address. One without a time of its own
    has the document's. Findings of one analysis show the same usage. documents: (document, url, heading, retrieved), evidence: (claim, place, document, …).
    """
    pieces = evidence.groupBy("claim").agg(F.count(F.lit(1)).alias("evidence"))
    out = findings.join(claims.select("claim", "text"), "claim", "left")
    for side, key in ((documents, "document"), (pieces, "claim"), (coverage_of(questions), "claim"), (usage_of(calls), "analysis")):
        out = out.join(broadcast_if_small(side), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "finding", "claim", "analysis", "document", "status", F.coalesce("text", F.lit("")).alias("text"), "url", F.coalesce("heading", "url", F.lit(UNTITLED)).alias("title"), F.coalesce("created", "retrieved").alias("created"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), *[zero(c) for c in ("evidence", "asked", "calls", "tokens", "latency", "errors")],
    )


def parts(findings: DataFrame, documents: DataFrame, evidence: DataFrame, questions: DataFrame, calls: DataFrame) -> DataFrame:
    """finding, part, place, body: everything in the records of findings, body being the row as JSON. Evidence carries the url of the document that it is from."""
    sourced = evidence.join(broadcast_if_small(documents.select("document", F.col("url").alias("source_url"))), "document", "left")

    def rows(part: str, held: DataFrame, key: str, place: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in held.columns if c != key]))
        return findings.select("finding", key).join(held.select(key, F.col(place).cast("long").alias("place"), body.alias("body")), key).select("finding", F.lit(part).alias("part"), "place", "body")

    return rows(EVIDENCE, sourced, "claim", "place").unionByName(rows(QUESTIONS, questions, "claim", "question")).unionByName(rows(CALLS, calls, "analysis", "place"))


def part_sizes(findings: DataFrame, documents: DataFrame, evidence: DataFrame, questions: DataFrame, calls: DataFrame) -> DataFrame:
    """finding, part, n, first, last, with_url: what parts() comes to. Things are counted by claim or analysis before findings are met, so an analysis that all findings share is counted once, not listed for each."""
    known = broadcast_if_small(documents.where("url is not null").groupBy("document").agg(F.count(F.lit(1)).alias("urls")))
    held = broadcast_if_small(documents.groupBy("document").agg(F.count(F.lit(1)).alias("times")))
    by_document = evidence.groupBy("claim", "document").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    sourced = by_document.join(held, "document", "left").join(known, "document", "left")
    # A document that is held twice is in a record twice, one that isn't held once and without its url.
    sourced = sourced.groupBy("claim").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(1))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("n") * F.coalesce("urls", F.lit(0))).alias("with_url"))

    def counted(rows: DataFrame, key: str, place: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.lit(0).cast("long").alias("with_url"))

    def rows(part: str, held: DataFrame, key: str) -> DataFrame:
        ends = [F.col(c).cast("long").alias(c) for c in ("first", "last")]
        return findings.select("finding", key).join(broadcast_if_small(held), key).select("finding", F.lit(part).alias("part"), "n", *ends, "with_url")

    every = rows(EVIDENCE, sourced, "claim").unionByName(rows(QUESTIONS, counted(questions, "claim", "question"), "claim")).unionByName(rows(CALLS, counted(calls, "analysis", "place"), "analysis"))
    return every.groupBy("finding", "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("with_url").alias("with_url"))


def nested(head: DataFrame, part: DataFrame) -> DataFrame:
    """The heads with an array of JSON bodies for each part, in order: for records that a reader can take in; a finding's whole record is one row here."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("place", "body")))).alias(f"{p}_list") for p in (EVIDENCE, QUESTIONS, CALLS)]
    by = part.groupBy("finding").agg(*lists)
    bodies = [F.coalesce(F.transform(f"{p}_list", lambda x: x["body"]), F.array().cast("array<string>")).alias(f"{p}_list") for p in (EVIDENCE, QUESTIONS, CALLS)]
    return head.join(by, "finding", "left").select(*head.columns, *bodies)


def exported(evidence: DataFrame, calculations: DataFrame) -> DataFrame:
    """claim, seq, action, id, group, log_evidence: a stored state as the trace that makes it, round by round, in each the items that were admitted, then what was calculated.

    evidence: (claim, round, place, id, group, log_evidence) of the items that are still held, calculations: (claim, round, place, id). Withdrawn items aren't in a stored state and
    so not in its trace. seq counts from 1; a claim of a great many events is numbered range by range. replay() of the admissions gives the state's score.
    """
    admit = evidence.select("claim", "round", F.lit(0).alias("kind"), "place", "id", "group", "log_evidence")
    calculate = calculations.select("claim", "round", F.lit(1).alias("kind"), "place", "id", F.lit(None).cast("string").alias("group"), F.lit(None).cast("double").alias("log_evidence"))
    one = admit.unionByName(calculate).withColumn("one", F.lit(1))
    out = running_totals(one, "claim", ["round", "kind", "place", "id"], {"seq": "one"})
    return out.select("claim", "seq", F.when(F.col("kind") == 0, "admit").otherwise("calculate").alias("action"), "id", "group", "log_evidence")
