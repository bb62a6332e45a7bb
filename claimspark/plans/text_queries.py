"""Queries on passages, claims and calls. Roles: benchmark items are claims, documents are filing passages, conversations are calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.operators import audit, ledger, retrieval, transcript
from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import table


def claims(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def passages(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def sentences(spark, d) -> DataFrame:
    """Calls; a third of the turns has no known speaker."""
    speaker = F.when(F.length("text") % 3 != 0, F.concat_ws("-", "role", (F.length("text") % 2).cast("string")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("idx"), speaker.alias("speaker"), "text")


def lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


# A word list for the queries; the words are ones that the tables hold.
LEXICON = [("the", "Strong_Modal"), ("of", "Strong_Modal"), ("und", "Strong_Modal"), ("is", "Weak_Modal"), ("to", "Weak_Modal"), ("der", "Weak_Modal"), ("that", "Uncertainty"), ("and", "Uncertainty")]
MARKER = "(?i)(the|and) [a-z]+ing"
SQL_LEXICON = "lexicon(word, category) AS (VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in LEXICON) + ")"


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, category string")


def novelty_best_match(spark, d):
    return retrieval.best_match(claims(spark, d), passages(spark, d))


def novelty_added(spark, d):
    return novelty_best_match(spark, d).where("status = 'added'").select("id", "closest")


def dropped_passages(spark, d):
    return retrieval.dropped(claims(spark, d), passages(spark, d))


def drift_follow(spark, d):
    return retrieval.follow(claims(spark, d), passages(spark, d), lexicon(spark))


def keyword_search_topk(spark, d):
    return retrieval.keyword_search(claims(spark, d), passages(spark, d), 8)


def risk_match_overlap_topk(spark, d):
    return retrieval.overlap_match(claims(spark, d), passages(spark, d), 5)


def bm25_topk(spark, d):
    return retrieval.bm25(claims(spark, d), passages(spark, d), 5)


def rrf_fusion(spark, d):
    fused = retrieval.fuse([keyword_search_topk(spark, d), risk_match_overlap_topk(spark, d)])
    return fused.withColumn("score", F.round("score", 9))


def retrieval_plan_union(spark, d):
    return retrieval.in_order_of_plan([keyword_search_topk(spark, d), risk_match_overlap_topk(spark, d)])


def cosine_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.cosine_search(v, v.where("id % 20 = 0"), 5).withColumn("score", F.round("score", 6))


def token_sets(spark, d):
    p = passages(spark, d)
    return p.select("id", F.size(X.words("text")).alias("words"), F.size(X.passage_tokens("text")).alias("compared"), F.size(X.match_tokens("text")).alias("matched"), F.size(X.index_tokens("text")).alias("indexed"))


def puffery_density(spark, d):
    return passages(spark, d).select("id", F.round(X.puffery_density("text"), 6).alias("puffery"))


def lexicon_densities(spark, d):
    out = X.densities(passages(spark, d), lexicon(spark), "id", "text")
    return out.select("id", "words", *[F.round(c, 6).alias(c.lower()) for c in ("Strong_Modal", "Weak_Modal", "Uncertainty")])


def hedging_delta(spark, d):
    """A claim's strong words less the weak words of its closest passage."""
    best = retrieval.best_match(claims(spark, d), passages(spark, d)).where("closest_id is not null").select("id", "closest_id")
    own = X.densities(claims(spark, d), lexicon(spark), "id", "text").select("id", "Strong_Modal")
    closest = best.select(F.col("closest_id").alias("id")).distinct()
    other = X.densities(passages(spark, d).join(broadcast_if_small(closest), "id", "left_semi"), lexicon(spark), "id", "text").select(F.col("id").alias("closest_id"), "Weak_Modal")
    return best.join(own, "id").join(other, "closest_id").select("id", "closest_id", F.round(F.col("Strong_Modal") - F.col("Weak_Modal"), 6).alias("hedging"))


def specificity_axes(spark, d):
    both = claims(spark, d).select(F.lit("claim").alias("kind"), "id", "text").unionByName(passages(spark, d).select(F.lit("passage").alias("kind"), "id", "text"))
    axes = X.specificity(F.col("text"))
    return both.select("kind", "id", *[axes[a].cast("int").alias(a) for a in ("number", "date", "baseline", "verifier")], X.specificity_score(axes).alias("score"))


def number_tokens(spark, d):
    n = passages(spark, d).select("id", F.posexplode(X.number_tokens("text")).alias("place", "number"))
    return n.select("id", "place", "number", F.expr("try_cast(number as double)").alias("value"))


def passage_packing(spark, d):
    p = passages(spark, d).select("id", F.posexplode(X.packed(X.sentences(X.squash("text")))).alias("place", "passage"))
    return p.select("id", "place", F.length("passage").alias("chars"), F.md5("passage").alias("digest"))


def passage_offsets(spark, d):
    return transcript.with_offsets(lines(spark, d), "doc", "pos", "text", 1).select("doc", "pos", "start", "end", "prev", "next")


def provenance_groups(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("quote"))
    return ledger.provenance_groups(items)


def hash_select_sample(spark, d):
    """A tenth of the documents by a seeded hash of the id, whatever their labels."""
    key = F.sha2(F.concat_ws("|", F.lit("13"), "id"), 256)
    return passages(spark, d).select("id", key.alias("key")).where(F.col("key") < "1999999999999999")


def leak_filter(spark, d):
    return passages(spark, d).where(~F.coalesce(F.col("text").rlike("(?i)worthless|password|licen[sc]e"), F.lit(False))).select("id", F.length("text").alias("chars"))


def qa_boundary(spark, d):
    return transcript.segments(sentences(spark, d), MARKER).groupBy("call").agg(F.max("qa_start").alias("qa_start"), *[F.count_if(F.col("segment") == s).alias(s) for s in ("prepared", "qa", "unknown")])


def within_speaker_delta(spark, d):
    found = transcript.within_speaker(transcript.segments(sentences(spark, d), MARKER), F.length("text").cast("double"))
    return found.withColumn("delta", F.round("delta", 6))


def speech_rate_delta(spark, d):
    """Words a second, a line's length standing for its seconds."""
    rate = F.try_divide(F.size(X.words("text")).cast("double"), F.length("text"))
    found = transcript.within_speaker(transcript.segments(sentences(spark, d), MARKER), rate)
    return found.withColumn("delta", F.round("delta", 6))


def turns_gaps_islands(spark, d):
    t = transcript.turns(transcript.segments(sentences(spark, d), MARKER))
    return t.select("call", "first", "last", "speaker", "segment", F.md5("text").alias("digest"))


def turn_holding(spark, d):
    s = transcript.segments(sentences(spark, d), MARKER)
    return transcript.turn_holding(s.select("call", "idx"), transcript.turns(s))


def company_speakers(spark, d):
    return transcript.company_speakers(transcript.segments(sentences(spark, d), MARKER))


def stratified_limit(spark, d):
    return transcript.stratified(transcript.segments(sentences(spark, d), MARKER), 4).select("call", "idx", "segment")


def ranked_lines(spark, d) -> DataFrame:
    """Lines that would be headings, their item number made from the line's length."""
    return lines(spark, d).where("length(text) < 60").withColumn("item", F.length("text") % 21)


def headings_strict_climb(spark, d):
    return transcript.climbing(ranked_lines(spark, d), "doc", "pos", "item").select("doc", "pos", "item")


def sections_fill(spark, d):
    found = transcript.sections(lines(spark, d), transcript.climbing(ranked_lines(spark, d), "doc", "pos", "item"), "doc", "pos", "item")
    return found.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def stances(spark, d) -> DataFrame:
    """Each claim's five best passages as agents: one that shares over a third of the words supports, a distant one contradicts if it names a number."""
    match = risk_match_overlap_topk(spark, d).select(F.col("query").alias("cid"), "id", "score")
    named = passages(spark, d).select("id", F.col("text").rlike("[0-9]").alias("numbers"))
    stance = F.when(F.col("score") > 0.33, "supports").when(F.col("numbers"), "contradicts").otherwise("not_found")
    return named.join(broadcast_if_small(match), "id").select(F.col("cid").alias("id"), stance.alias("stance"))


def audit_rows(spark, d):
    hedging = hedging_delta(spark, d).select("id", "hedging")
    return audit.claim_rows(claims(spark, d), stances(spark, d), hedging, F.lower("text").contains("thing"))


def inflation_axes(spark, d):
    score = X.specificity_score(X.specificity(F.col("text")))
    return passages(spark, d).select("id", F.round(audit.inflation(score, X.puffery_density("text"), F.lower("text").contains("thing")), 4).alias("inflation"))


def evidence_gap_verdict(spark, d):
    return audit_rows(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("claims"), F.sum("checked").alias("checked"))


def ledger_rollup(spark, d):
    return audit.roll_up(audit_rows(spark, d), F.col("id") % 4)


QUERIES = {
    f.__name__: f
    for f in (
        audit_rows, inflation_axes, evidence_gap_verdict, ledger_rollup,
        novelty_best_match, novelty_added, dropped_passages, drift_follow, keyword_search_topk, risk_match_overlap_topk, bm25_topk, rrf_fusion,
        retrieval_plan_union, cosine_topk, token_sets, puffery_density, lexicon_densities, hedging_delta, specificity_axes, number_tokens,
        passage_packing, passage_offsets, provenance_groups, hash_select_sample, leak_filter, qa_boundary, within_speaker_delta, speech_rate_delta,
        turns_gaps_islands, turn_holding, company_speakers, stratified_limit, headings_strict_climb, sections_fill,
    )
}

OVERLAP = """
c AS (SELECT item_id AS l, list_distinct(regexp_extract_all(lower(text), '{p}')) AS t FROM benchmark),
p AS (SELECT doc_id AS r, list_distinct(regexp_extract_all(lower(text), '{p}')) AS t FROM documents {where}),
o AS (SELECT l, r, any_value(l_n) AS l_n, any_value(r_n) AS r_n, count(*) AS shared
      FROM (SELECT l, len(t) AS l_n, unnest(t) AS token FROM c) JOIN (SELECT r, len(t) AS r_n, unnest(t) AS token FROM p) USING (token) GROUP BY l, r)"""
O4 = OVERLAP.format(p="[a-z]{4,}", where="")
BEST = f"""{O4},
b AS (SELECT l, max(shared / least(l_n, r_n)) AS closest, arg_max(r, (shared / least(l_n, r_n), -r)) AS closest_id FROM o GROUP BY l),
m AS (SELECT item_id AS id, round(coalesce(closest, 0), 4) AS closest, closest_id, CASE WHEN coalesce(closest, 0) >= 0.6 THEN 'carried_over' ELSE 'added' END AS status
      FROM benchmark LEFT JOIN b ON l = item_id)"""
DENSITY = SQL_LEXICON + """, w AS (
  SELECT id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*')) AS word FROM ({rows})
), {name} AS (
  SELECT r.id, count(w.word) AS words,
    CASE WHEN count(w.word) > 0 THEN 100.0 * count(*) FILTER (category = 'Strong_Modal') / count(w.word) ELSE 0 END AS strong_modal,
    CASE WHEN count(w.word) > 0 THEN 100.0 * count(*) FILTER (category = 'Weak_Modal') / count(w.word) ELSE 0 END AS weak_modal,
    CASE WHEN count(w.word) > 0 THEN 100.0 * count(*) FILTER (category = 'Uncertainty') / count(w.word) ELSE 0 END AS uncertainty
  FROM ({rows}) r LEFT JOIN w ON w.id = r.id LEFT JOIN lexicon l ON l.word = lower(w.word) GROUP BY r.id)"""
ALL_TEXTS = "SELECT 'c' || item_id AS id, text FROM benchmark UNION ALL SELECT 'p' || doc_id, text FROM documents"
KEYWORD = OVERLAP.format(p="[a-z0-9]+", where="") + """,
k AS (SELECT l AS query, r AS id, shared AS score, row_number() OVER (PARTITION BY l ORDER BY shared DESC, r) AS rank FROM o QUALIFY rank <= 8)"""
MATCH = OVERLAP.format(p="[a-z0-9]{3,}", where="WHERE len(regexp_split_to_array(trim(text), '\\s+')) >= 12").replace("c AS", "c2 AS").replace("p AS", "p2 AS").replace("o AS", "o2 AS").replace("FROM c)", "FROM c2)").replace("FROM p)", "FROM p2)") + """,
x AS (SELECT l AS query, r AS id, round(shared / sqrt(l_n::DOUBLE * r_n), 9) AS score, row_number() OVER (PARTITION BY l ORDER BY round(shared / sqrt(l_n::DOUBLE * r_n), 9) DESC, r) AS rank FROM o2 QUALIFY rank <= 5)"""
LINES = "lines AS (SELECT doc_id AS doc, unnest(range(len(a))) AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
CALLS = r"""s0 AS (
  SELECT conv_id AS call, turn AS idx, CASE WHEN length(text) % 3 <> 0 THEN concat_ws('-', role, (length(text) % 2)::VARCHAR) END AS speaker, text FROM conversations
), s1 AS (
  SELECT *, max(CASE WHEN regexp_matches(text, '(?i)(the|and) [a-z]+ing') THEN idx END) OVER (PARTITION BY call) + 1 AS q, count(*) OVER (PARTITION BY call) AS n FROM s0
), s AS (
  SELECT call, idx, speaker, text, CASE WHEN q >= 0.25 * n THEN q END AS qa_start,
    CASE WHEN q IS NULL OR q < 0.25 * n THEN 'unknown' WHEN idx >= q THEN 'qa' ELSE 'prepared' END AS segment FROM s1)"""
DELTA = CALLS + """, v AS (SELECT *, {value} AS v FROM s), base AS (
  SELECT *, avg(v) FILTER (segment = 'prepared') OVER (PARTITION BY call, speaker) AS base FROM v)
SELECT call, idx, round(v - base, 6) AS delta FROM base WHERE segment = 'qa' AND v IS NOT NULL AND base IS NOT NULL"""
TURNS = CALLS + """, f AS (
  SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND segment = lag(segment) OVER w AND lag(idx) OVER w = idx - 1 THEN 0 ELSE 1 END AS new
  FROM s WINDOW w AS (PARTITION BY call ORDER BY idx)
), g AS (SELECT *, sum(new) OVER (PARTITION BY call ORDER BY idx) AS turn FROM f),
turns AS (SELECT call, min(idx) AS first, max(idx) AS last, speaker, segment, string_agg(text, ' ' ORDER BY idx) AS text FROM g GROUP BY call, turn, speaker, segment)"""
CLIMB = LINES + """, ranked AS (SELECT *, length(text) % 21 AS item FROM lines WHERE length(text) < 60),
kept AS (SELECT doc, pos, item FROM (SELECT *, max(item) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ranked) WHERE b IS NULL OR item > b)"""
PUFF = "', '".join(X.PUFFERY)

SPECIFIC = rf"(regexp_matches(text, '\d')::INT + regexp_matches(text, '{X.DATE}')::INT + regexp_matches(text, '{X.BASELINE}')::INT + regexp_matches(text, '{X.VERIFIER}')::INT)"
PUFFERY_OF = f"""(CASE WHEN len(w) > 0 THEN 100.0 * len(list_filter(w, lambda x: lower(x) IN ('{PUFF}') OR regexp_matches(lower(x), '{X.SUPERLATIVE}'))) / len(w) ELSE 0 END)"""
INFLATION = f"((1 - {SPECIFIC} / 6) + least({PUFFERY_OF} / 5, 1.0) + (contains(lower(text), 'thing'))::INT) / 3"
AUDIT = f"""{BEST}, {DENSITY.format(rows=ALL_TEXTS, name='dens')}, hd AS (SELECT m.id, round(a.strong_modal - b.weak_modal, 6) AS hedging FROM m JOIN dens a ON a.id = 'c' || m.id JOIN dens b ON b.id = 'p' || m.closest_id),
{MATCH}, st AS (SELECT x.query AS id, CASE WHEN score > 0.33 THEN 's' WHEN regexp_matches(text, '[0-9]') THEN 'c' ELSE 'n' END AS stance FROM x JOIN documents ON doc_id = x.id),
sd AS (SELECT id, count(*) FILTER (stance = 's') AS s, count(*) FILTER (stance = 'c') AS c FROM st GROUP BY id),
al AS (SELECT item_id AS id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z-]*') AS w, coalesce(s, 0) AS s, coalesce(sd.c, 0) AS c, CASE WHEN hedging > 0 THEN least(hedging / 5, 1.0) END AS h FROM benchmark LEFT JOIN sd ON sd.id = item_id LEFT JOIN hd ON hd.id = item_id),
gp AS (SELECT *, round(CASE WHEN s + c > 0 AND h IS NOT NULL THEN (c / (s + c) + h) / 2 WHEN s + c > 0 THEN c / (s + c) ELSE h END, 4) AS gap FROM al),
au AS (SELECT id, round({INFLATION}, 4) AS inflation, gap, s + c AS checked, CASE WHEN gap IS NULL THEN 'abstain' WHEN c > 0 AND gap >= 0.5 THEN 'contradicted' ELSE 'consistent' END AS verdict FROM gp)"""

ORACLES = {
    "audit_rows": f"WITH {AUDIT} SELECT * FROM au",
    "inflation_axes": f"SELECT id, round({INFLATION}, 4) AS inflation FROM (SELECT doc_id AS id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z-]*') AS w FROM documents)",
    "evidence_gap_verdict": f"WITH {AUDIT} SELECT verdict, count(*) AS claims, sum(checked)::BIGINT AS checked FROM au GROUP BY verdict",
    "ledger_rollup": f"WITH {AUDIT} SELECT id % 4 AS ledger, count(*) AS claims, count(*) FILTER (verdict = 'abstain') AS abstained, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'consistent') AS consistent, sum(checked)::BIGINT AS evidence, round(count(*) FILTER (verdict = 'abstain') / count(*), 3) AS abstain_rate FROM au GROUP BY 1",
    "novelty_best_match": f"WITH {BEST} SELECT * FROM m",
    "novelty_added": f"WITH {BEST} SELECT id, closest FROM m WHERE status = 'added'",
    "dropped_passages": f"WITH {O4}, b AS (SELECT r, max(shared / least(l_n, r_n)) AS best FROM o GROUP BY r) SELECT doc_id AS id, round(coalesce(best, 0), 4) AS similarity FROM documents LEFT JOIN b ON r = doc_id WHERE round(coalesce(best, 0), 4) < 0.6",
    "drift_follow": f"WITH {BEST}, {DENSITY.format(rows=ALL_TEXTS, name='dens')}, j AS (SELECT m.*, round((a.strong_modal - a.weak_modal) - (b.strong_modal - b.weak_modal), 4) AS change FROM m JOIN dens a ON a.id = 'c' || m.id LEFT JOIN dens b ON b.id = 'p' || m.closest_id) "
    "SELECT id, CASE WHEN status = 'carried_over' THEN closest_id END AS closest_id, closest, CASE WHEN status = 'carried_over' THEN change END AS strength_change, "
    "CASE WHEN status <> 'carried_over' THEN 'not_found' WHEN change <= -0.5 THEN 'weakened' WHEN change >= 0.5 THEN 'firmer' ELSE 'unchanged' END AS drift FROM j",
    "keyword_search_topk": f"WITH {KEYWORD} SELECT * FROM k",
    "risk_match_overlap_topk": f"WITH {MATCH} SELECT * FROM x",
    "bm25_topk": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
      stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
      q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
      tf AS (SELECT id, any_value(n) AS length, token, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS token FROM d) SEMI JOIN q USING (token) GROUP BY id, token),
      df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
      sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (token) JOIN q USING (token), stats GROUP BY query, id)
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 5""",
    "rrf_fusion": f"WITH {KEYWORD}, {MATCH}, u AS (SELECT query, id, rank FROM k UNION ALL SELECT query, id, rank FROM x), f AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM u GROUP BY query, id) "
    "SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f",
    "retrieval_plan_union": f"WITH {KEYWORD}, {MATCH}, u AS (SELECT query, id, min(at) AS at FROM (SELECT query, id, (0, rank) AS at FROM k UNION ALL SELECT query, id, (1, rank) FROM x) GROUP BY query, id) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY at) AS place FROM u".replace("at)", "pl)").replace("AS at", "AS pl").replace("min(pl)", "min(pl)"),
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (
      SELECT q.id AS query, v.id, list_cosine_similarity(q.v, v.v) AS score FROM v AS q JOIN v ON q.id % 20 = 0 AND q.id <> v.id)
      SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY s.score DESC, id) AS rank FROM s QUALIFY rank <= 5""",
    "token_sets": """SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS compared,
      len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS matched, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS indexed FROM documents""",
    "puffery_density": f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Za-z][A-Za-z-]*') AS w FROM documents)
      SELECT id, CASE WHEN len(w) > 0 THEN round(100.0 * len(list_filter(w, lambda x: lower(x) IN ('{PUFF}') OR regexp_matches(lower(x), '{X.SUPERLATIVE}'))) / len(w), 6) ELSE 0 END AS puffery FROM w""",
    "lexicon_densities": f"WITH {DENSITY.format(rows='SELECT doc_id AS id, text FROM documents', name='dens')} SELECT id, words, round(strong_modal, 6) AS strong_modal, round(weak_modal, 6) AS weak_modal, round(uncertainty, 6) AS uncertainty FROM dens",
    "hedging_delta": f"WITH {BEST}, {DENSITY.format(rows=ALL_TEXTS, name='dens')} SELECT m.id, closest_id, round(a.strong_modal - b.weak_modal, 6) AS hedging FROM m JOIN dens a ON a.id = 'c' || m.id JOIN dens b ON b.id = 'p' || m.closest_id",
    "specificity_axes": rf"""WITH b AS (SELECT 'claim' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'passage', doc_id, text FROM documents), a AS (
      SELECT kind, id, regexp_matches(text, '\d')::INT AS number, regexp_matches(text, '{X.DATE}')::INT AS date, regexp_matches(text, '{X.BASELINE}')::INT AS baseline, regexp_matches(text, '{X.VERIFIER}')::INT AS verifier FROM b)
      SELECT *, number + date + baseline + verifier AS score FROM a""",
    "number_tokens": r"""WITH n AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '\d[\d,]*\.?\d*'), lambda x: regexp_replace(replace(x, ',', ''), '\.$', '')) AS a FROM documents),
      u AS (SELECT id, unnest(range(len(a))) AS place, unnest(a) AS number FROM n) SELECT id, place, number, try_cast(number AS DOUBLE) AS value FROM u""",
    "passage_packing": r"""WITH s AS (SELECT doc_id AS id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
      p AS (SELECT id, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) > 800 THEN list_concat(a, x) ELSE list_append(a[:-2], a[-1] || ' ' || x[1]) END) AS p FROM s),
      u AS (SELECT id, unnest(range(len(p))) AS place, unnest(p) AS passage FROM p) SELECT id, place, length(passage) AS chars, md5(passage) AS digest FROM u""",
    "passage_offsets": f"""WITH {LINES}, o AS (SELECT doc, pos, text, (sum(length(text) + 1) OVER w - 1)::BIGINT AS "end", lag(pos) OVER v AS prev, lead(pos) OVER v AS next FROM lines
      WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY doc ORDER BY pos)) SELECT doc, pos, "end" - length(text) AS start, "end", prev, next FROM o""",
    "provenance_groups": r"""SELECT 'grp-' || sha256(trim(regexp_replace(lower(text), '[^\pL\pN_]+', ' ', 'g')))[1:12] AS "group", count(*) AS members, min(doc_id) AS first FROM documents GROUP BY 1""",
    "hash_select_sample": "SELECT doc_id AS id, sha256('13|' || doc_id) AS key FROM documents WHERE sha256('13|' || doc_id) < '1999999999999999'",
    "leak_filter": "SELECT doc_id AS id, length(text) AS chars FROM documents WHERE NOT coalesce(regexp_matches(text, '(?i)worthless|password|licen[sc]e'), false)",
    "qa_boundary": f"WITH {CALLS} SELECT call, max(qa_start) AS qa_start, count(*) FILTER (segment = 'prepared') AS prepared, count(*) FILTER (segment = 'qa') AS qa, count(*) FILTER (segment = 'unknown') AS unknown FROM s GROUP BY call",
    "within_speaker_delta": "WITH " + DELTA.format(value="length(text)::DOUBLE"),
    "speech_rate_delta": "WITH " + DELTA.format(value="len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*'))::DOUBLE / nullif(length(text), 0)"),
    "turns_gaps_islands": f"WITH {TURNS} SELECT call, first, last, speaker, segment, md5(text) AS digest FROM turns",
    "turn_holding": f"WITH {TURNS} SELECT s.call, s.idx, t.first, t.last, t.speaker FROM s JOIN turns t ON s.call = t.call AND s.idx BETWEEN t.first AND t.last",
    "company_speakers": f"WITH {CALLS} SELECT DISTINCT call, speaker FROM s WHERE segment = 'prepared' AND speaker IS NOT NULL",
    "stratified_limit": f"""WITH {CALLS}, a AS (SELECT *, row_number() OVER (PARTITION BY call, segment ORDER BY idx) AS n, min(idx) OVER (PARTITION BY call, segment) AS f FROM s)
      SELECT call, idx, segment FROM a QUALIFY row_number() OVER (PARTITION BY call ORDER BY n, f) <= 4""",
    "headings_strict_climb": f"WITH {CLIMB} SELECT doc, pos, item FROM kept",
    "sections_fill": f"""WITH {CLIMB}, j AS (SELECT l.doc, l.pos, l.text, k.item AS own, last_value(k.item IGNORE NULLS) OVER (PARTITION BY l.doc ORDER BY l.pos ROWS UNBOUNDED PRECEDING) AS item FROM lines l LEFT JOIN kept k ON k.doc = l.doc AND k.pos = l.pos)
      SELECT doc, item, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM j WHERE own IS NULL AND item IS NOT NULL GROUP BY doc, item""",
}
