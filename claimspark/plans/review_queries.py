"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import review
from claimspark.plans.text_queries import LINES, lines
from claimspark.session import table


def evidence_citation_errors(spark, d):
    """Quotes cut from documents: every third is lower-cased, every seventh blank, and every eleventh cites another span."""
    docs = table(spark, d, "documents")
    quote = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 3 == 0, F.lower(F.substring("text", 1, 20))).otherwise(F.substring("text", 3, 20))
    span = F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return review.citation_errors(docs.select(F.col("doc_id").alias("id"), span.alias("span"), quote.alias("quote")), docs.select(F.col("doc_id").alias("span"), "text"))


def value_in_source(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(review.values("text")).alias("numbers"), review.value_in_source("text", (F.col("doc_id") % 7).cast("double")).alias("held"))


def numbers_supported(spark, d):
    allowed = F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3, 4)])
    return table(spark, d, "documents").select("doc_id", review.numbers_supported("text", allowed).alias("supported"))


def neighbours_of_hits(spark, d):
    all_lines = lines(spark, d)
    return review.neighbours(all_lines.where(F.col("text").rlike("(?i)thing|password")).select("doc", "pos"), all_lines)


def budgeted_calls(spark, d):
    calls = table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("place"), F.length("text").alias("cost"))
    return review.budgeted(calls, 400).select("group", "place", "status")


def multiclass_brier_logloss(spark, d):
    share = lambda x: (F.when(F.element_at(F.array(*[F.lit(y) for y in ("en", "fr", "de", "es")]), (F.length("text") % 4 + 1).cast("int")) == x, 0.7).otherwise(0.1))
    p = F.map_from_arrays(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), F.array(*[share(x) for x in ("en", "fr", "de", "es")]))
    out = review.log_loss(table(spark, d, "documents").select(F.col("lang").alias("gold"), p.alias("p")), ["en", "fr", "de", "es"])
    return out.select("n", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


def basis_differences(spark, d):
    """Parts as evidence that differs in metric, unit and boundary; the claim states a metric for one brand in three."""
    differs = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "metric"), F.when(F.col("p_size") % 3 == 0, "unit"), F.when(F.col("p_size") % 5 == 0, "boundary")))
    stated = {"metric": F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), "unit": F.lit("")}
    return table(spark, d, "part").select("p_partkey", F.array_join(review.differences_that_count(differs, stated), ",").alias("differs"))


QUERIES = {f.__name__: f for f in (evidence_citation_errors, value_in_source, numbers_supported, neighbours_of_hits, budgeted_calls, multiclass_brier_logloss, basis_differences)}

NUMBERS = r"list_transform(regexp_extract_all(text, '\d[\d,]*\.?\d*'), lambda x: try_cast(regexp_replace(replace(x, ',', ''), '\.$', '') AS DOUBLE))"
ORACLES = {
    "evidence_citation_errors": """WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS span, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN lower(substring(text, 1, 20)) ELSE substring(text, 3, 20) END AS quote FROM documents),
      e AS (SELECT id, CASE WHEN text IS NULL THEN 'no such span' WHEN trim(quote) = '' THEN 'blank quote' WHEN NOT contains(text, quote) THEN 'not a quote' END AS error FROM i LEFT JOIN documents ON doc_id = span) SELECT * FROM e WHERE error IS NOT NULL""",
    "value_in_source": f"SELECT doc_id, len({NUMBERS}) AS numbers, list_contains({NUMBERS}, (doc_id % 7)::DOUBLE) AS held FROM documents",
    "numbers_supported": f"SELECT doc_id, len(list_filter({NUMBERS}, lambda v: NOT list_contains([0.0, 1.0, 2.0, 3.0, 4.0], v))) = 0 AS supported FROM documents",
    "neighbours_of_hits": f"WITH {LINES}, h AS (SELECT doc, pos FROM lines WHERE regexp_matches(text, '(?i)thing|password')), n AS (SELECT DISTINCT doc, pos + s AS pos FROM h, (VALUES (-1), (1)) v(s)) SELECT l.doc, l.pos FROM lines l SEMI JOIN n USING (doc, pos) ANTI JOIN h USING (doc, pos)",
    "budgeted_calls": """SELECT conv_id AS "group", turn AS place, CASE WHEN sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 400 THEN 'run' ELSE 'not_run' END AS status FROM conversations""",
    "multiclass_brier_logloss": """WITH d AS (SELECT lang, ['en', 'fr', 'de', 'es'][length(text) % 4 + 1] AS said FROM documents)
      SELECT count(*) AS n, round(avg(CASE WHEN lang = said THEN 0.09 + 3 * 0.01 ELSE 0.49 + 0.81 + 2 * 0.01 END), 6) AS brier, round(avg(-ln(CASE WHEN lang = said THEN 0.7 ELSE 0.1 END)), 6) AS log_loss FROM d""",
    "basis_differences": """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'metric' END, CASE WHEN p_size % 5 = 0 THEN 'boundary' END) AS differs FROM part""",
}
