"""Queries on rounds of questions, replayed variants and prepared datasets. Roles: parts are questions and brands claims, events are evidence, documents are
published rows or arriving documents, conversations are passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import preparation, replay, retrieval, rounds
from claimspark.plans import text_queries
from claimspark.plans.claim_queries import middle, pick
from claimspark.plans.record_queries import EV, evidence
from claimspark.plans.text_queries import claims, lines, passages, vectors
from claimspark.session import table

SEED, ORDERS = 11, 2


def next_questions(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.col("p_brand").alias("claim"), F.col("p_partkey").alias("question"), ((F.col("p_size") % 5) / 2).alias("priority"), (F.col("p_partkey") % 3 != 0).alias("open"))
    return rounds.next_questions(q, p.where("p_partkey % 50 = 1").select(F.col("p_brand").alias("claim"), F.col("p_partkey").alias("question")))


def critical_open(spark, d):
    p = table(spark, d, "part")
    return rounds.critical_open(p.select(F.col("p_brand").alias("claim"), F.col("p_partkey").alias("question"), (F.col("p_size") % 4 == 0).alias("critical"), pick(["open", "answered", "unanswerable"], F.col("p_partkey") % 3).alias("status")))


def routed_sentences(spark, d):
    t = table(spark, d, "conversations")
    n = F.length("text")
    s = t.select("conv_id", "turn", pick(["paragraph", "heading", "caption", "table_row", "footnote"], n % 5).alias("kind"), F.col("text").contains("?").alias("is_claim"), (n % 11 / 10).alias("confidence"), F.when(n % 13 == 0, True).alias("selected"))
    return rounds.routed(s).select("conv_id", "turn", "kind")


def source_flags(spark, d):
    e = evidence(spark, d).select("claim", (F.col("k") % 9).alias("source"), F.col("seq").alias("place"), (F.col("status") != "click").alias("independent"))
    return rounds.sources(e)


def finding_groups(spark, d):
    k = F.col("k")
    said = lambda n, c: F.when(k % n == 0, c).otherwise(F.lit(None).cast("string"))
    f = evidence(spark, d).select(
        "claim", F.col("seq").alias("place"), F.when(k % 6 != 0, pick(["supports", "not_found", "contradicts"], k % 3)).alias("stance"), said(2, F.repeat(F.concat(F.lit("quote "), (k % 8).cast("string"), F.lit(" ")), 20)).alias("quote"),
        said(3, F.lit("tag")).alias("tag"), said(5, F.lit("")).alias("prior_quote"), said(7, F.concat(F.lit("acc-"), (k % 4).cast("string"))).alias("accession"), F.col("status").alias("agent"),
    )
    return rounds.finding_groups(f)


def context_build(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("claim"), F.col("turn").alias("place"), (F.col("turn") % 3 == 0).alias("decisive"), "text")
    return rounds.context(t).select("claim", F.md5("context").alias("digest"), "compress")


def span_of_claim(spark, d):
    """The middle half of every line as a claim."""
    spans = lines(spark, d)
    said = spans.select(F.concat_ws("-", "doc", "pos").alias("claim"), "doc", F.concat(F.lit(" "), middle(F.col("text")), F.lit("\t")).alias("text"))
    return rounds.span_of_claim(said, spans)


def wiring_keys(spark, d):
    """Lines as programs over the same few passages, under names of their own: how many different calculations each passage has."""
    n = F.col("l_linenumber")
    name = lambda x: F.concat(F.lit(x), (F.col("l_partkey") % 7).cast("string"))
    figure = lambda x, source, value: F.struct(name(x).alias("name"), source.alias("source"), value.cast("string").alias("value"))
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    step = lambda op, args, out: F.struct(op.alias("op"), F.array(*args).alias("args"), name(out).alias("out"))
    inputs = F.array(figure("a", source, F.col("l_orderkey") % 3), figure("b", F.lit("s9"), n))
    order = F.when(n % 2 == 0, F.array(name("a"), name("b"))).otherwise(F.array(name("b"), name("a")))
    steps = F.array(F.struct(pick(["share", "divide"], n % 2).alias("op"), order.alias("args"), name("x").alias("out")), step(F.lit("multiply"), [name("x"), F.lit("const_100")], "y"))
    keyed = table(spark, d, "lineitem").select(source.alias("source"), rounds.wiring(inputs, steps, name("y"), F.when(n > 3, F.lit("5"))).alias("key"))
    return keyed.groupBy("source").agg(F.count(F.lit(1)).alias("programs"), F.count_distinct("key").alias("calculations"))


def usable_scores(spark, d):
    e = evidence(spark, d).select(F.concat_ws("/", "claim", "group").alias("unit"), (F.col("k") % 3).alias("context"), "seq", F.when(F.col("k") % 10 == 0, float("nan")).otherwise(F.col("k") / 15).alias("log_evidence"), (F.col("status") != "view").alias("cites"))
    return rounds.usable_scores(e, e.groupBy("unit").agg(F.max("context").alias("context"))).withColumn("log_evidence", F.round("log_evidence", 9))


def replay_variants(spark, d):
    out = replay.outcomes(replay.variants(evidence(spark, d).select("claim", "seq", "action", "group", "log_evidence"), SEED, ORDERS))
    return out.select("claim", "run", "active", F.round("log_odds", 9).alias("log_odds"), "updates")


def hybrid_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.hybrid(claims(spark, d), passages(spark, d), v.where("id % 20 = 0"), v, 5).withColumn("score", F.round("score", 9))


def dataset_chunks(spark, d):
    """Orders as examples: texts before and after a table of their lines."""
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("pre_text"), F.array(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("post_text"))
    rows = F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey")))
    cells = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(rows, lambda r: F.array(r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))).alias("table"))
    return preparation.table_chunks(o.join(cells, "o_orderkey", "left").withColumnRenamed("o_orderkey", "example"))


LEAKING = ["Fact-check: ", "it was rated as mostly false. ", "Debunked! ", "", "a Snopes page ", "half true, ", "", "  "]


def searchable_snippets(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("example"), F.concat(F.lit("claim "), (F.col("item_id") % 40).cast("string"), F.lit(" ")).alias("claim"))
    found = table(spark, d, "documents").select(F.concat(F.lit(" claim "), (F.col("doc_id") % 40).cast("string")).alias("claim"), F.col("doc_id").alias("rank"), F.concat(pick(LEAKING, F.col("doc_id") % len(LEAKING)), "text").alias("text"))
    return preparation.searchable_snippets(asked, found, 3).withColumn("text", F.md5("text"))


def document_snapshots(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("text").alias("content"), F.col("doc_id").alias("retrieved"), "lang")
    first = docs.where("lang = 'fr'").groupBy("content").agg(F.max("retrieved").alias("retrieved")).withColumn("document", F.concat(F.lit("doc-"), F.substring(F.sha2("content", 256), 1, 16)))
    return preparation.admitted_documents(docs.drop("lang"), first).select("document", F.length("content").alias("chars"), "retrieved")


def alignment_errors(spark, d):
    inputs, references = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return preparation.alignment_errors(inputs.unionByName(inputs.where("doc_id % 90 = 7")), references.unionByName(references.select(F.col("doc_id") + 1_000_000).withColumnRenamed("(doc_id + 1000000)", "doc_id")), "doc_id")


def scope_errors(spark, d):
    allowed = table(spark, d, "orders").select((F.col("o_orderkey") % 25).alias("example"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 100_000).alias("passage"))
    return preparation.scope_errors(allowed, table(spark, d, "customer").select(F.col("c_custkey").alias("passage"), F.col("c_nationkey").alias("example")))


def native_ids(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("passage"), (F.col("o_custkey") % 25).alias("example"), (F.col("o_orderkey") % 40).alias("document"))
    return preparation.native_ids(rows, table(spark, d, "customer").select(F.col("c_custkey").alias("passage"), F.col("c_nationkey").alias("example"), (F.col("c_custkey") % 40).alias("document")))


QUERIES = {
    f.__name__: f
    for f in (
        next_questions, critical_open, routed_sentences, source_flags, finding_groups, context_build, span_of_claim, wiring_keys, usable_scores, replay_variants,
        hybrid_topk, dataset_chunks, searchable_snippets, document_snapshots, alignment_errors, scope_errors, native_ids,
    )
}

DRAW = "sha256(concat_ws('|', '{seed}', {what}))"
LEAK_SQL = preparation.LEAK.removeprefix("(?i)").replace("'", "''")
ORACLES = {
    "next_questions": """WITH p AS (SELECT p_brand AS claim, p_partkey AS question, p_size % 5 / 2 AS priority, p_partkey % 50 = 1 AS f FROM part WHERE p_partkey % 3 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY f DESC, CASE WHEN f THEN 0 ELSE -priority END, question) AS place, count(*) FILTER (f) OVER (PARTITION BY claim) AS n FROM p WHERE f OR priority > 0) SELECT claim, question, place FROM r WHERE place <= greatest(3, n)""",
    "critical_open": "SELECT p_brand AS claim, p_partkey AS question FROM part WHERE p_size % 4 = 0 AND p_partkey % 3 <> 1",
    "routed_sentences": "SELECT conv_id, turn, ['paragraph', 'heading', 'caption'][length(text) % 5 + 1] AS kind FROM conversations WHERE length(text) % 5 < 3 AND (contains(text, '?') OR length(text) % 11 < 8 OR length(text) % 13 = 0)",
    "source_flags": f"WITH {EV} SELECT claim, k % 9 AS source, arg_min(status <> 'click', seq) AS independent FROM e GROUP BY ALL",
    "finding_groups": f"""WITH {EV}, f AS (SELECT claim, seq AS place, substring(CASE WHEN k % 2 = 0 THEN repeat('quote ' || (k % 8) || ' ', 20) WHEN k % 3 = 0 THEN 'tag' WHEN k % 7 = 0 THEN 'acc-' || (k % 4) ELSE status END, 1, 120) AS r FROM e WHERE k % 6 = 0 OR k % 3 <> 1)
      SELECT claim, place, dense_rank() OVER (PARTITION BY claim ORDER BY r) - 1 AS "group" FROM f""",
    "context_build": r"""WITH c AS (SELECT conv_id AS claim, string_agg(text, chr(10) || chr(10) ORDER BY turn % 3 <> 0, turn) AS x, string_agg(text, chr(10) || chr(10)) FILTER (turn % 3 <> 0) AS b FROM conversations GROUP BY conv_id) SELECT claim, md5(x) AS digest, coalesce(length(b), 0) >= 1200 AS compress FROM c""",
    "span_of_claim": r"""WITH l AS (SELECT doc_id AS doc, unnest(range(len(a))) AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
      n AS (SELECT doc, pos, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS held FROM l), c AS (SELECT doc || '-' || pos AS claim, doc, trim(regexp_replace(lower(substring(text, length(text) // 4 + 1, greatest(1, length(text) // 2))), '\s+', ' ', 'g')) AS said FROM l)
      SELECT claim, min(n.pos) FILTER (said <> '' AND contains(held, said)) AS pos FROM c LEFT JOIN n USING (doc) GROUP BY claim""",
    "wiring_keys": """WITH l AS (SELECT 's' || (l_suppkey % 5) AS source, l_orderkey % 3 AS v, l_linenumber AS n FROM lineitem) SELECT source, count(*) AS programs, count(DISTINCT (v, n)) AS calculations FROM l GROUP BY source""",
    "usable_scores": f"""WITH {EV}, s AS (SELECT claim || '/' || grp AS unit, k % 3 AS context, seq, k FROM e), c AS (SELECT unit, max(context) AS context FROM s GROUP BY unit), t AS (SELECT claim || '/' || grp AS unit, seq FROM e WHERE status <> 'view')
      SELECT s.unit, s.context, round(arg_max(s.k / 15, s.seq), 9) AS log_evidence FROM s JOIN c USING (unit, context) JOIN t USING (unit, seq) WHERE k % 10 <> 0 AND k / 15 <= 5 GROUP BY ALL""",
    "replay_variants": f"""WITH {EV}, b AS (SELECT claim, seq, action, grp, log_evidence AS s FROM e), h AS (SELECT *, coalesce(seq < min(seq) FILTER (action <> 'admit') OVER (PARTITION BY claim), true) AS head, max(seq) OVER (PARTITION BY claim) AS last FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY claim, head ORDER BY seq) AS at, row_number() OVER (PARTITION BY claim, head ORDER BY {DRAW.format(seed=SEED, what="'0', claim, seq")}) AS at0, row_number() OVER (PARTITION BY claim, head ORDER BY {DRAW.format(seed=SEED, what="'1', claim, seq")}) AS at1 FROM h),
      one AS (SELECT * FROM h WHERE action = 'admit' AND NOT EXISTS (SELECT 1 FROM b w WHERE w.action = 'withdraw' AND w.claim = h.claim AND w.grp = h.grp) QUALIFY row_number() OVER (PARTITION BY claim ORDER BY {DRAW.format(seed=SEED, what="claim, seq")}) = 1),
      v AS (SELECT *, 'base' AS run FROM b UNION ALL SELECT x.claim, y.seq, x.action, x.grp, x.s, 'permutation_0' FROM o x JOIN o y ON y.claim = x.claim AND y.head = x.head AND y.at = CASE WHEN x.head THEN x.at0 ELSE x.at END
        UNION ALL SELECT x.claim, y.seq, x.action, x.grp, x.s, 'permutation_1' FROM o x JOIN o y ON y.claim = x.claim AND y.head = x.head AND y.at = CASE WHEN x.head THEN x.at1 ELSE x.at END
        UNION ALL SELECT b.*, n.run FROM b SEMI JOIN one USING (claim), (SELECT unnest(['duplicate_source', 'duplicate_event', 'withdrawal', 'correction', 'irrelevant_addition']) AS run) n
        UNION ALL SELECT claim, last + 1, 'admit', grp || '-copy', s, 'duplicate_source' FROM one UNION ALL SELECT claim, last + 1, 'admit', grp, s, 'duplicate_event' FROM one UNION ALL SELECT claim, last + 1, 'withdraw', grp, s, 'withdrawal' FROM one
        UNION ALL SELECT claim, last + 1, 'correct', grp, 0, 'correction' FROM one UNION ALL SELECT claim, last + 1, 'admit', 'irrelevant', 0, 'irrelevant_addition' FROM one),
      p AS (SELECT *, CASE action WHEN 'admit' THEN 1 WHEN 'withdraw' THEN -1 ELSE 0 END AS step FROM v), t AS (SELECT *, sum(step) OVER (PARTITION BY claim, run, grp ORDER BY seq) AS total FROM p), i AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY claim, run, grp ORDER BY seq)) AS items FROM t),
      d AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY claim, run, grp ORDER BY seq), 0) AS had FROM i),
      x AS (SELECT *, CASE WHEN items > 0 THEN last_value(CASE WHEN (step = 1 AND had = 0) OR (step = 0 AND had > 0) THEN s END IGNORE NULLS) OVER (PARTITION BY claim, run, grp ORDER BY seq) ELSE 0 END AS now FROM d),
      y AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY claim, run, grp ORDER BY seq), 0) AS was FROM x)
      SELECT claim, run, sum((items > 0)::INT - (had > 0)::INT)::BIGINT AS active, round(sum(now - was), 9) AS log_odds, count(*) FILTER (((items > 0) <> (had > 0)) OR (step = 0 AND had > 0 AND now <> was)) AS updates FROM y GROUP BY ALL""",
    "dataset_chunks": """WITH l AS (SELECT l_orderkey AS example, list(DISTINCT (l_linenumber, l_partkey)) AS r FROM lineitem GROUP BY ALL), s AS (SELECT example, list_sort(r) AS r FROM l)
      SELECT o_orderkey AS example, 'text_' || i AS chunk, 'text' AS kind, [o_orderstatus, o_orderpriority, 'customer ' || o_custkey][i + 1] AS text FROM orders, range(3) t(i)
      UNION ALL SELECT o_orderkey, 'table_' || (i - 1), 'table_row', r[i][1] || ' | ' || r[i][2] FROM orders JOIN s ON example = o_orderkey, unnest(range(1, len(r) + 1)) t(i)""",
    "searchable_snippets": f"""WITH s AS (SELECT doc_id % 40 AS c, doc_id AS rank, {'[' + ', '.join("'" + x + "'" for x in LEAKING) + ']'}[doc_id % {len(LEAKING)} + 1] || text AS text FROM documents), k AS (SELECT * FROM s WHERE trim(text) <> '' AND NOT regexp_matches(text, '{LEAK_SQL}', 'i'))
      SELECT item_id AS example, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place, md5(k.text) AS text FROM benchmark JOIN k ON c = item_id % 40 QUALIFY place <= 3""",
    "document_snapshots": """WITH d AS (SELECT text, doc_id, lang, 'doc-' || sha256(text)[1:16] AS document FROM documents WHERE text IS NOT NULL) SELECT document, any_value(length(text)) AS chars, coalesce(max(doc_id) FILTER (lang = 'fr'), min(doc_id)) AS retrieved FROM d GROUP BY document""",
    "alignment_errors": """WITH i AS (SELECT doc_id, 1 + (doc_id % 90 = 7)::INT AS i FROM documents), r AS (SELECT doc_id, count(*) AS r FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000 FROM labels) GROUP BY doc_id)
      SELECT doc_id, CASE WHEN r IS NULL THEN 'no reference' WHEN i IS NULL THEN 'no input' ELSE 'repeated' END AS problem FROM i FULL JOIN r USING (doc_id) WHERE r IS NULL OR i IS NULL OR i > 1 OR r > 1""",
    "scope_errors": """WITH a AS (SELECT DISTINCT o_orderkey % 25 AS example, o_custkey + o_orderkey % 2 * 100000 AS passage FROM orders)
      SELECT DISTINCT passage, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE 'of another example' END AS problem FROM a LEFT JOIN customer ON c_custkey = passage WHERE c_custkey IS NULL OR c_nationkey <> example
      UNION SELECT c_custkey, 'allowed by none' FROM customer WHERE c_custkey NOT IN (SELECT passage FROM a)""",
    "native_ids": """WITH k AS (SELECT c_nationkey AS example, c_custkey % 40 AS document, count(*) AS n, min(c_custkey) AS only_one FROM customer GROUP BY ALL),
      r AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS passage, o_custkey % 25 AS example, o_orderkey % 40 AS document FROM orders)
      SELECT r."row", passage, r.example, r.document, coalesce(c_custkey, only_one) AS native FROM r LEFT JOIN customer ON c_custkey = passage LEFT JOIN k ON k.example = r.example AND k.document = r.document AND n = 1""".replace("AS row,", 'AS "row",'),
}
#: Both legs as they are, then the sum over their ranks.
ORACLES["hybrid_topk"] = f"""WITH b AS ({text_queries.ORACLES["bm25_topk"]}), n AS ({text_queries.ORACLES["cosine_topk"]}), u AS (SELECT query, id, rank FROM b UNION ALL SELECT query, id, rank FROM n),
  f AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM u GROUP BY query, id) SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY f.score DESC, id) AS rank FROM f"""
