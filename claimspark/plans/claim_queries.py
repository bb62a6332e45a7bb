"""Queries on worded claims, report sections, reconciled evidence and scored answers. Roles: a customer is a company, its orders of a quarter are
what it files, a document's lines are a report's spans, events are evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.functions import wording as V
from claimspark.operators import answers, reconcile, scoring, sections, transcript, verification
from claimspark.operators.components import components
from claimspark.operators.substring import first_holder
from claimspark.plans.record_queries import EV, evidence
from claimspark.plans.text_queries import LINES, lines
from claimspark.session import materialize, table

#: text, metric, assertion of the claims; the place decides what else is odd about them.
WORDINGS = [
    ("Sales were strong.", "revenue", "historical"),
    ("A record for the business.", "net revenue", "historical"),
    ("Adjusted sales rose again.", "revenue", "historical"),
    ("Our retail segment grew.", "revenue", "historical"),
    ("We will pass this mark next year.", "revenue", "future_target"),
    ("Sales grew by this much.", "revenue growth in per cent", "historical"),
    ("Customers like what we make.", "satisfaction", "historical"),
    ("The bottom line was good.", "net income", "historical"),
    ("Cash came in as planned.", "operating cash flow", "historical"),
    ("Carbon emissions fell.", "revenue", "historical"),
    ("The figure moved.", "total net revenue", "historical"),
    ("Our model is accurate.", "revenue", "policy_commitment"),
    ("Nobody named a period.", "revenue", "historical"),
]
NUMBERLESS, SEVERAL, PERIODLESS = 9, 10, 12
LONG_TAG = "RevenueFromContractWithCustomerExcludingAssessedTax"


def pick(values: list, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def quarters(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    return o.groupBy(F.col("o_custkey").alias("company"), start.alias("start")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def worded(filed: DataFrame) -> DataFrame:
    """One claim on each company and quarter: its figure in millions to two places, every third one overstated, every third one with the scale in the unit."""
    q = filed.withColumns({"k": (F.col("company") + F.quarter("start") * 5 + F.year("start")) % len(WORDINGS), "v": F.col("company") % 3})
    hundredths = ((F.when(F.col("v") == 1, F.col("cents") * 11 / 10).otherwise(F.col("cents")) + 500_000) / 1_000_000).cast("long")
    figure = F.concat((hundredths / 100).cast("long").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    plain = F.when(F.col("v") == 2, figure).otherwise(F.concat(figure, F.lit(" million")))
    value = F.when(F.col("k") == NUMBERLESS, "a lot").when(F.col("k") == SEVERAL, F.concat(F.lit("up 3 to $"), figure, F.lit(" million"))).otherwise(plain)
    period = F.format_string("%d-Q%d", F.year("start"), F.quarter("start"))
    columns = {name: pick([w[i] for w in WORDINGS], F.col("k")) for i, name in enumerate(("text", "metric", "assertion"))}
    return q.select(F.concat_ws("-", "company", period).alias("claim"), "company", *[c.alias(n) for n, c in columns.items()], value.alias("value"), F.when(F.col("v") == 2, "USD million").otherwise("USD").alias("unit"), F.when(F.col("k") == PERIODLESS, "").otherwise(period).alias("period"))


def verify_guards(spark, d):
    filed = materialize(quarters(spark, d), "quarters")
    q = filed.select("company", "start", F.date_sub(F.add_months("start", 3), 1).alias("end"), (F.col("cents") / 100).alias("value"))
    revenue = q.withColumn("tag", F.when(F.col("company") % 2 == 0, "Revenues").otherwise(LONG_TAG))
    year = F.date_trunc("year", "start").cast("date")
    annual = q.groupBy("company", year.alias("start")).agg(F.sum("value").alias("value")).select("company", "start", F.date_sub(F.add_months("start", 12), 1).alias("end"), "value", F.lit(LONG_TAG).alias("tag"))
    return verification.check(worded(filed), revenue.unionByName(q.withColumn("tag", F.lit("NetIncomeLoss"))).unionByName(annual)).withColumn("filed", F.round("filed", 2))


def checklist_families(spark, d):
    c = worded(quarters(spark, d)).withColumn("family", V.family(F.col("text"), F.col("metric"), F.col("assertion") == "future_target"))
    return c.select("family", F.explode(V.questions(F.col("family"))).alias("question")).groupBy("family", "question").agg(F.count(F.lit(1)).alias("claims"))


def report_spans(spark, d) -> DataFrame:
    """Lines as a report: short ones are headings or lines of the contents, some of the others point elsewhere."""
    n = F.length("text")
    heading = F.concat(F.lit(" Item "), (n % 16).cast("string"), pick(["", "A", " b"], n % 3), F.lit(". "), "text", F.when(n % 5 == 0, F.concat(F.lit(" | Page "), n.cast("string"))).otherwise(""))
    body = F.when(n % 7 == 0, F.concat("text", F.lit(" It is incorporated herein by reference."))).otherwise(F.col("text"))
    return lines(spark, d).select("doc", "pos", F.when(n < 60, heading).otherwise(body).alias("text"))


def report_headings(spark, d):
    return sections.headings(report_spans(spark, d))


def report_sections(spark, d):
    return sections.sections(report_spans(spark, d)).select("doc", "item", "spans", "words", "elsewhere")


def risk_candidates(spark, d):
    return sections.candidates(report_spans(spark, d))


def items(spark, d) -> DataFrame:
    return as_items(evidence(spark, d))


def as_items(e: DataFrame) -> DataFrame:
    """Events as items: the observation is the span, every eleventh wording is another's, clicks repeat the span ten before."""
    quote = F.concat(F.lit("Finding no. "), (F.col("k") % 11 * 10 + F.col("k") % 3).cast("string"), F.when(F.col("k") % 2 == 0, "!").otherwise(""))
    return e.select("claim", F.col("seq").alias("id"), F.concat(F.lit("s"), "k").alias("span"), F.when(F.col("status") == "purchase", "claim").otherwise("question").alias("target"), quote.alias("quote"), F.when((F.col("status") == "click") & (F.col("k") >= 10), F.concat(F.lit("s"), (F.col("k") - 10).cast("string"))).alias("repeats"))


def reconcile_groups(spark, d):
    return reconcile.groups(items(spark, d))


def group_versions(spark, d):
    return reconcile.versions(evidence(spark, d).select("claim", "group", "seq", "action"))


def upsert_outcomes(spark, d):
    e = evidence(spark, d).select("claim", "group", "seq", (F.col("k") % 5).alias("version"), (F.col("k") % 2).cast("double").alias("log_evidence"), F.when(F.col("k") % 17 == 0, 1.5).otherwise(1.0).alias("weight"))
    return reconcile.upserts(e).groupBy("claim", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("latest"))


def unit_versions(spark, d):
    """Units of groups that a claim's adjoining purchases name together, and the sum of their versions; purchases stand for calculations, as in scoring_units."""
    from pyspark.sql import Window as W

    name = F.concat_ws("/", "claim", "group")
    e = evidence(spark, d).where("status = 'purchase'").withColumn("name", name)
    edges = e.withColumn("b", F.lag("name").over(W.partitionBy("claim").orderBy("seq"))).select(F.col("name").alias("a"), F.coalesce("b", "name").alias("b")).distinct()
    members = components(edges).select(F.col("label").alias("unit"), F.col("node").alias("group"))
    return reconcile.unit_versions(members, group_versions(spark, d).select(name.alias("group"), "version"))


def question_answers(spark, d):
    """Observations as questions, later events as answers that cite a span; only purchases' spans are admitted."""
    e = evidence(spark, d)
    questions = e.select("claim", (F.col("k") % 4).alias("question")).distinct().withColumn("status", F.lit("open"))
    said = e.select("claim", (F.col("k") % 4).alias("question"), "seq", F.when(F.col("status") == "view", "answered").when(F.col("status") == "error", "unanswerable").otherwise("answered").alias("status"), F.concat(F.lit("s"), (F.col("k") % 20).cast("string")).alias("span"))
    held = e.where("status = 'purchase'").select("claim", F.concat(F.lit("s"), (F.col("k") % 20).cast("string")).alias("span"))
    return reconcile.answered(questions, said, held)


def bayes_updates(spark, d):
    e = evidence(spark, d).select("seq", ((F.col("k") + 1) / 102).alias("prior"), (F.col("amount") / 50).alias("factor"))
    return e.select("seq", F.round(reconcile.bayes_factor(F.col("prior"), F.col("factor")), 9).alias("posterior"))


def review_decisions(spark, d):
    """Supplier balances as statuses, reviews that reject, narrow or accept."""
    status, decision = pick(["insufficient", "mixed", "supported", "contradicted", "not_yet_resolvable"], F.col("s_suppkey") % 5), pick(["accept", "narrow", "reject", "narrow"], F.col("s_suppkey") % 4)
    narrowed = pick(["mixed", "supported", "insufficient"], F.col("s_nationkey") % 3)
    s = table(spark, d, "supplier").select("s_suppkey", status.alias("before"), decision.alias("decision"), F.when(F.col("s_nationkey") % 7 != 0, narrowed).alias("narrowed"))
    c = [F.col(x) for x in ("decision", "narrowed", "before")]
    return s.select("s_suppkey", "before", "decision", "narrowed", V.reviewed(*c).alias("status"), V.wants_firmer(*c).alias("wants_firmer"))


FORMS = ["{x}", "${x}", "{x}%", "about {x}", "Yes", "-{x}"]


def answer_rows(spark, d) -> DataFrame:
    """Lines as questions: the gold answer is the discount, the given one is it in several forms, wrong, or absent."""
    n = F.col("l_linenumber") + F.col("l_partkey")
    x = F.format_string("%d", F.round(F.col("l_discount") * 100).cast("int"))
    form = pick(FORMS, n % len(FORMS))
    answer = F.when(F.col("l_suppkey") % 10 == 0, None).otherwise(F.replace(form, F.lit("{x}"), F.when(F.col("l_quantity") > 40, F.concat(F.lit("7"), x)).otherwise(x)))
    gold = F.concat(F.lit("0."), F.lpad(x, 2, "0"))
    return table(spark, d, "lineitem").select("l_returnflag", answer.alias("answer"), gold.alias("gold"), F.when(F.col("l_suppkey") % 13 == 0, "not_run").otherwise("ok").alias("status"), F.lit(2).alias("cited"), (F.col("l_quantity") > 10).cast("int").alias("grounded"))


def answer_scores(spark, d):
    out = answers.answer_scores(answer_rows(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if "_over_" in c or c == "grounding" else F.col(c) for c in out.columns])


def strict_answers(spark, d):
    r = answer_rows(spark, d)
    return r.groupBy("answer", "gold").agg(F.count(F.lit(1)).alias("n")).select("answer", "gold", "n", answers.strict_number(F.col("answer")).alias("number"), answers.same_answer(F.col("answer"), F.col("gold")).alias("same"), answers.right(F.col("answer"), F.col("gold")).alias("near"))


def aligned(spark, d) -> DataFrame:
    from claimspark.plans.record_queries import aligned as rows

    return rows(spark, d).where("gold is not null").withColumnRenamed("doc_id", "id")


def prediction_summary(spark, d):
    out = answers.summary(aligned(spark, d))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "coverage", "floor")], "floor_label")


def joint_label_scores(spark, d):
    """Documents of a source as a company's claims: two labels made of the text's length against two made of its words."""
    n, w = F.length(F.coalesce("text", F.lit(""))), F.size(F.split(F.coalesce("text", F.lit("")), " "))
    material, evidence_ = ["absent", "present", "undetermined"], ["supported", "contradicted", "insufficient", "mixed"]
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("company"), pick(material, n % 3).alias("gold"), F.when(n % 11 == 0, scoring.MISSING).otherwise(pick(material, w % 3)).alias("prediction"), pick(evidence_, n % 4).alias("gold_evidence"), pick(evidence_, w % 4).alias("evidence"))
    out = answers.joint_scores(rows)
    return out.select("n", "companies", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def citation_recall(spark, d):
    """Orders as questions: the pages of returned lines are the annotated ones, those of open lines the cited ones."""
    page = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("example"), (F.col("l_partkey") % 5).alias("doc"), (F.col("l_linenumber") % 3).alias("page"), "l_returnflag", "l_linestatus")
    return answers.citation_recall(page.where("l_returnflag = 'R'"), page.where("l_linestatus = 'O'")).withColumn("recall", F.round("recall", 6))


def repeated_runs(spark, d):
    """Users as cases, event kinds as statuses, days as arms; large values are failed runs."""
    e = evidence(spark, d)
    rows = e.select(F.date_format("at", "yyyy-MM").alias("arm"), (F.col("claim") * 3 + F.col("k") % 3).alias("case"), "status", (F.col("k") % 4 != 0).alias("found"), (F.col("k") % 3 == 0).alias("correct"), F.when(F.col("amount") > 100, "failed").alias("error"), F.col("k").alias("tokens"))
    out = answers.run_summary(rows)
    return out.select("arm", "run", "failed", *[F.round(c, 6).alias(c) for c in ("found", "status_correct", "consistent")], "tokens")


def cost_or_unknown(spark, d):
    """Users as arms and event kinds as models; one kind has no price."""
    prices = spark.createDataFrame([("click", 2.0, 1.0, 8.0), ("view", 0.5, 0.1, 2.0), ("purchase", 8.0, 4.0, 30.0), ("signup", 1.0, 0.5, 4.0)], "model string, price_in double, price_cached double, price_out double")
    usage = evidence(spark, d).select(F.col("claim").alias("arm"), F.col("status").alias("model"), (F.col("k") * 10).alias("tokens_in"), F.col("k").alias("tokens_cached"), (F.col("k") % 10).alias("tokens_out"))
    return answers.cost(usage, prices).withColumn("cost", F.round("cost", 9))


def run_comparison(spark, d):
    """A claim's event kinds as runs: views are the base, clicks and purchases other orders."""
    name = F.when(F.col("status") == "view", "base").when(F.col("status") == "click", "permutation_0").when(F.col("status") == "purchase", "permutation_1").when(F.col("status") == "error", "withdrawal").otherwise("duplicate")
    runs = evidence(spark, d).groupBy("claim", name.alias("run")).agg((F.max("k") > 20).alias("complete"), pick(["supported", "mixed"], F.max("k") % 2).alias("status"), F.max(F.when(F.col("k") % 5 != 0, F.col("k") / 100)).alias("score"))
    return answers.run_comparison(runs).withColumn("order_score_range", F.round("order_score_range", 6))


def middle(text):
    """A claim made of a text: its middle half."""
    n = F.length(text)
    return F.substring(text, F.floor(n / 4).cast("int") + 1, F.greatest(F.lit(1), F.floor(n / 2).cast("int")))


def claim_to_turn(spark, d):
    """The middle half of every turn as a claim: the first turn of the call that holds it."""
    t = table(spark, d, "conversations")
    claims = t.select(F.struct("conv_id", "turn").alias("claim"), F.col("conv_id").alias("doc"), middle(F.col("text")).alias("text"))
    found = first_holder(claims, t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text"))
    return found.where("pos is not null").select("claim.conv_id", F.col("claim.turn").alias("claim"), F.col("pos").alias("turn"))


def finding_of_claim(spark, d):
    """Calls as cases: the claim is the first turn's second half and some more, the other turns' texts and the first turn itself are the findings' quotes."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("case"), F.col("turn").alias("finding"), F.col("text").alias("quote"))
    half = F.floor(F.length("quote") / 2).cast("int")
    wanted = t.where("finding = 0").select("case", F.concat(F.substring(F.col("quote"), half + 1, F.length("quote")), F.lit(" and on")).alias("wanted"))
    return answers.finding_of_claim(t, wanted)


def neutralized_tags(spark, d):
    p = table(spark, d, "pages")
    safe = V.neutralized(F.col("html"), "script")
    return p.select("page_id", F.size(F.split(safe, "&lt;/?script", -1)).alias("pieces"), F.md5(safe).alias("digest"), F.lower(safe).contains("<script").alias("left"))


def protected_retention(spark, d):
    """Calls as contexts: how many of the turns a text that leaves out every third one still holds, whole."""
    t = table(spark, d, "conversations")
    by = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform(F.filter("t", lambda x: x["turn"] % 3 < 2), lambda x: x["text"]), "  ")
    return by.select("conv_id", F.round(V.retention(F.transform("t", lambda x: x["text"]), text), 6).alias("kept"))


def official_export(spark, d):
    """Every document has a row, in order of id: a placeholder where no label was given."""
    docs, given = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    label = V.canonical(F.when(F.col("quality") == 1, "Supported").when(F.col("quality") == 0, "Conflicting Evidence/Cherry-picking").otherwise("Not Enough Evidence"))
    return docs.join(given, "doc_id", "left").select("doc_id", label.alias("label"), F.col("quality").isNull().alias("placeholder"))


def round_robin_parts(spark, d):
    """The benchmark's ids dealt in turn to four parts, with the place that brings results back in order."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy("item_id")) - 1  # a stated id list of a benchmark
    return table(spark, d, "benchmark").select("item_id", place.alias("place")).select("item_id", (F.col("place") % 4).alias("part"), (F.col("place") / 4).cast("int").alias("at"))


def plain_text_passages(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(X.passages("text")).alias("place", "passage"))
    return p.select("doc_id", "place", F.md5("passage").alias("digest"))


def call_hand_over(spark, d):
    """Where calls are handed over to questions: a turn in five gets the wording of one."""
    said = ["We will now begin the question", "Operator, are there any questions", "the next question comes from Ann", "I turn it over to you for questions", "Thank you all", "ready to take your questions", "opening up the lines for questions"]
    n = F.length("text")
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("idx"), F.when(n % 5 == 0, pick(said, n % len(said))).otherwise("And so on.").alias("text"))
    return transcript.segments(s).groupBy("call").agg(F.max("qa_start").alias("qa_start"), F.count_if(F.col("segment") == transcript.QA).alias("qa"))


QUERIES = {
    f.__name__: f
    for f in (
        plain_text_passages, call_hand_over, verify_guards, checklist_families, report_headings, report_sections, risk_candidates, reconcile_groups, group_versions, upsert_outcomes, unit_versions,
        question_answers, bayes_updates, review_decisions, answer_scores, strict_answers, prediction_summary, joint_label_scores, citation_recall, repeated_runs,
        cost_or_unknown, run_comparison, claim_to_turn, finding_of_claim, neutralized_tags, protected_retention, official_export, round_robin_parts,
    )
}

K = len(WORDINGS)
QUARTERS = "q AS (SELECT o_custkey AS company, date_trunc('quarter', o_orderdate)::DATE AS start, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL)"
WORDED = f"""{QUARTERS}, n AS (SELECT *, (company + quarter(start) * 5 + year(start)) % {K} AS k, company % 3 AS v, company || '-' || year(start) || '-Q' || quarter(start) AS claim,
  trunc((CASE WHEN company % 3 = 1 THEN cents * 11 / 10 ELSE cents END + 500000) / 1000000) AS h FROM q)"""
SPANS = LINES + """, spans AS (SELECT doc, pos, CASE WHEN length(text) < 60 THEN ' Item ' || (length(text) % 16) || ['', 'A', ' b'][length(text) % 3 + 1] || '. ' || text || CASE WHEN length(text) % 5 = 0 THEN ' | Page ' || length(text) ELSE '' END
  WHEN length(text) % 7 = 0 THEN text || ' It is incorporated herein by reference.' ELSE text END AS text FROM lines)"""
ITEM_PATTERN = r"^\s*item\s+(\d{1,2})\s*([A-C])?\s*[.:\-–—]?\s*([^\n]{0,60})"
HEADS = SPANS + rf""", c AS (SELECT doc, pos, regexp_extract(text, '{ITEM_PATTERN}', 1, 'i')::INT AS n, upper(regexp_extract(text, '{ITEM_PATTERN}', 2, 'i')) AS a, trim(regexp_extract(text, '{ITEM_PATTERN}', 3, 'i'), ' .:-') AS title
    FROM spans WHERE regexp_matches(text, '{ITEM_PATTERN}', 'i') AND NOT regexp_matches(text, '\|\s*(page:?\s*)?\d{{1,4}}\s*$', 'i')),
  r AS (SELECT *, n * 4 + CASE a WHEN '' THEN 0 ELSE ascii(a) - 64 END AS rank FROM c),
  h AS (SELECT doc, pos, n || a AS item, title FROM r QUALIFY coalesce(rank > max(rank) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))"""
HELD = HEADS + """, held AS (SELECT * FROM (SELECT s.doc, s.pos, s.text, h.item IS NOT NULL AS head, last_value(h.item IGNORE NULLS) OVER (PARTITION BY s.doc ORDER BY s.pos) AS item FROM spans s LEFT JOIN h USING (doc, pos)) WHERE NOT head AND item IS NOT NULL),
  w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM held),
  sec AS (SELECT h.doc, h.item, count(w.pos) AS spans, coalesce(sum(w.words), 0)::BIGINT AS words, coalesce(bool_or(regexp_matches(w.text, 'incorporated\\s+(herein\\s+)?by\\s+reference', 'i')), false) AS told FROM h LEFT JOIN w USING (doc, item) GROUP BY ALL)"""
ITEMS = EV + """, i AS (SELECT claim, seq AS id, 's' || k AS span, CASE WHEN status = 'purchase' THEN 'claim' ELSE 'question' END AS target, 'Finding no. ' || (k % 11 * 10 + k % 3) || CASE WHEN k % 2 = 0 THEN '!' ELSE '' END AS quote,
  CASE WHEN status = 'click' AND k >= 10 THEN 's' || (k - 10) END AS repeats FROM e),
  a AS (SELECT *, 'grp-' || sha256(trim(regexp_replace(lower(quote), '\\W+', ' ', 'g')))[1:12] AS wording FROM i QUALIFY row_number() OVER (PARTITION BY claim, span, target ORDER BY id) = 1),
  o AS (SELECT claim, span, arg_min(id, ((target <> 'claim')::INT, id)) AS original FROM a GROUP BY ALL),
  m AS (SELECT a.*, o.original FROM a LEFT JOIN o ON o.claim = a.claim AND o.span = a.repeats)"""
VERSIONS = EV + """, s AS (SELECT claim, grp, seq, CASE action WHEN 'admit' THEN 1 WHEN 'withdraw' THEN -1 ELSE 0 END AS step FROM e),
  u AS (SELECT *, sum(step) OVER (PARTITION BY claim, grp ORDER BY seq) AS total FROM s),
  l AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY claim, grp ORDER BY seq)) AS members FROM u),
  b AS (SELECT *, coalesce(lag(members) OVER (PARTITION BY claim, grp ORDER BY seq), 0) AS prior FROM l),
  g AS (SELECT claim, grp, arg_max(members, seq)::BIGINT AS members, count(*) FILTER (step = -1 AND prior > 0) AS taken, count(*) FILTER (step = 1 AND prior = 0) AS filled FROM b GROUP BY ALL),
  ver AS (SELECT claim, grp, members, members > 0 AS active, taken + filled AS version FROM g WHERE filled > 0)"""
ANSWERS = """x AS (SELECT *, round(l_discount * 100)::INT::VARCHAR AS x, (l_linenumber + l_partkey) % 6 AS f FROM lineitem),
  y AS (SELECT *, CASE WHEN l_quantity > 40 THEN '7' || x ELSE x END AS g FROM x),
  r AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE replace(['{x}', '${x}', '{x}%', 'about {x}', 'Yes', '-{x}'][f + 1], '{x}', g) END AS answer, '0.' || lpad(x, 2, '0') AS gold, l_suppkey % 13 <> 0 AS ran, l_quantity > 10 AS grounded FROM y),
  t AS (SELECT *, CASE WHEN regexp_full_match(answer, '[+-]?\\d+%?') THEN replace(answer, '%', '')::DOUBLE / CASE WHEN answer LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END END AS number, abs(try_cast(regexp_replace(answer, '[^0-9.\\-]', '', 'g') AS DOUBLE)) AS got, gold::DOUBLE AS want FROM r),
  z AS (SELECT *, coalesce(round(number, 5) = round(want, 5), false) AS same, coalesce(abs(got - want) <= 0.02 OR (want < 1 AND abs(got - want * 100) <= 0.02), false) AS near FROM t)"""
ALIGNED = "a AS (SELECT doc_id AS id, lang AS gold, CASE WHEN length(text) > 0 THEN ['en', 'fr', 'de', 'es'][length(text) % 4 + 1] ELSE '__MISSING__' END AS prediction FROM documents WHERE lang IS NOT NULL)"

ORACLES = {
    "call_hand_over": """WITH s AS (SELECT conv_id AS call, turn AS idx, length(text) % 5 = 0 AND length(text) % 7 <> 4 AS m FROM conversations), q AS (SELECT *, max(CASE WHEN m THEN idx END) OVER (PARTITION BY call) + 1 AS q, count(*) OVER (PARTITION BY call) AS n FROM s),
      b AS (SELECT call, idx, CASE WHEN q >= 0.25 * n THEN q END AS b FROM q) SELECT call, max(b) AS qa_start, count(*) FILTER (idx >= b) AS qa FROM b GROUP BY call""",
    "verify_guards": f"""WITH {WORDED}, w AS (SELECT *, {sql_list([w[1] for w in WORDINGS])}[k + 1] AS metric FROM n),
      j AS (SELECT *, CASE WHEN k IN (4, 11) THEN 'future' WHEN k = 2 THEN 'company-defined measure' WHEN k = 3 THEN 'part of the company' WHEN k = 6 THEN 'unknown metric' WHEN k = 5 THEN 'rate of change' WHEN k = {NUMBERLESS} THEN 'no number' WHEN k = {PERIODLESS} THEN 'no period' END AS refused, h * 10000.0::DOUBLE AS stated FROM w),
      f AS (SELECT *, CASE WHEN k = 7 THEN 'NetIncomeLoss' WHEN k = 8 THEN NULL WHEN company % 2 = 0 THEN 'Revenues' ELSE '{LONG_TAG}' END AS tag FROM j),
      g AS (SELECT *, CASE WHEN refused IS NULL AND tag IS NOT NULL THEN cents / 100 END AS filed, CASE WHEN k = {SEVERAL} THEN 0.5 * 10 ** CASE WHEN stated = 0 THEN 0 ELSE floor(log10(stated)) END ELSE CASE WHEN stated = 0 THEN 0.005 ELSE 5000 END END AS step FROM f)
      SELECT claim, CASE WHEN filed IS NULL THEN 'not_found' WHEN abs(filed - stated) <= step THEN 'supports' ELSE 'contradicts' END AS stance, coalesce(refused, CASE WHEN filed IS NULL THEN 'nothing filed' END) AS note,
        CASE WHEN refused IS NULL THEN stated END AS stated, CASE WHEN filed IS NOT NULL THEN tag END AS tag, round(filed, 2) AS filed FROM g""",
    "checklist_families": f"""WITH {WORDED}, f AS (SELECT CASE WHEN k = 4 THEN 'future_target' WHEN k = 9 THEN 'environmental' WHEN k = 11 THEN 'business_growth' WHEN k = 6 THEN 'business_growth' WHEN k IN (7, 8) THEN 'product_attribute' ELSE 'business_growth' END AS family FROM n),
      u(family, question) AS (VALUES {", ".join("('" + f + "', '" + q.replace("'", "''") + "')" for f, qs in V.QUESTIONS.items() for q in qs)}) SELECT family, question, count(*) AS claims FROM f JOIN u USING (family) GROUP BY ALL""",
    "report_headings": f"WITH {HEADS} SELECT * FROM h",
    "report_sections": f"WITH {HELD} SELECT doc, item, spans, words, told AND words < 120 AS elsewhere FROM sec",
    "risk_candidates": f"WITH {HELD} SELECT w.doc, w.pos, w.item FROM w JOIN sec USING (doc, item) WHERE item IN ('1A', '7') AND w.words >= 12 AND NOT (told AND sec.words < 120)",
    "reconcile_groups": f"""WITH RECURSIVE {ITEMS}, d AS (SELECT claim, 'i' || id AS x, 'w' || wording AS y FROM m UNION ALL SELECT claim, 'i' || id, 'i' || original FROM m WHERE original IS NOT NULL),
      b AS (SELECT claim, x, y FROM d UNION SELECT claim, y, x FROM d), t(claim, x, y) AS (SELECT claim, x, x FROM b UNION SELECT t.claim, t.x, b.y FROM t JOIN b ON b.claim = t.claim AND b.x = t.y),
      c AS (SELECT claim, x, min(y) AS label FROM t GROUP BY ALL), v AS (SELECT m.claim, m.id, label, wording, original FROM m JOIN c ON c.claim = m.claim AND c.x = 'i' || m.id),
      g AS (SELECT claim, label, coalesce(min(wording) FILTER (original IS NULL), min(wording)) AS grp FROM v GROUP BY ALL)
      SELECT claim, id, grp AS "group", CASE WHEN original IS NULL THEN 'independent' ELSE 'repetition' END AS origin FROM v JOIN g USING (claim, label)""",
    "group_versions": f'WITH {VERSIONS} SELECT claim, grp AS "group", members, active, version FROM ver',
    "upsert_outcomes": f"""WITH {EV}, d AS (SELECT claim, grp, seq, k % 5 AS version, k % 2 AS le, k % 17 = 0 OR k % 5 = 0 AS bad FROM e),
      p AS (SELECT *, max(version) FILTER (NOT bad) OVER (PARTITION BY claim, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, first_value(CASE WHEN NOT bad THEN le END IGNORE NULLS) OVER (PARTITION BY claim, grp, version ORDER BY seq) AS held FROM d),
      o AS (SELECT claim, seq, CASE WHEN bad THEN 'invalid' WHEN newest IS NULL OR version > newest THEN 'applied' WHEN version < newest THEN 'stale' WHEN held = le THEN 'repeat' ELSE 'conflict' END AS outcome FROM p) SELECT claim, outcome, count(*) AS n, max(seq) AS latest FROM o GROUP BY ALL""",
    "unit_versions": f"""WITH RECURSIVE {VERSIONS}, z AS (SELECT claim, claim || '/' || grp AS x, coalesce(lag(claim || '/' || grp) OVER (PARTITION BY claim ORDER BY seq), claim || '/' || grp) AS y FROM e WHERE status = 'purchase'),
      d AS (SELECT x, y FROM z UNION SELECT y, x FROM z), t(x, y) AS (SELECT x, x FROM d UNION SELECT t.x, d.y FROM t JOIN d ON d.x = t.y), c AS (SELECT x, min(y) AS unit FROM t GROUP BY x)
      SELECT unit, sum(version)::BIGINT AS version FROM c JOIN ver ON ver.claim || '/' || ver.grp = c.x GROUP BY unit""",
    "question_answers": f"""WITH {EV}, p AS (SELECT DISTINCT claim, k % 20 AS s FROM e WHERE status = 'purchase'),
      a AS (SELECT claim, k % 4 AS question, seq, CASE WHEN status = 'error' THEN 'unanswerable' ELSE 'answered' END AS said, EXISTS (SELECT 1 FROM p WHERE p.claim = e.claim AND p.s = e.k % 20) AS held FROM e)
      SELECT claim, question, coalesce(arg_max(said, seq) FILTER (said <> 'answered' OR held), 'open') AS status FROM a GROUP BY ALL""",
    "bayes_updates": f"WITH {EV}, b AS (SELECT seq, (k + 1) / 102 AS p, amount / 50 AS f FROM e) SELECT seq, CASE WHEN f > 0 AND p < 1 THEN round(1 / (1 + (1 - p) / p / f), 9) END AS posterior FROM b",
    "review_decisions": """WITH s AS (SELECT s_suppkey, ['insufficient', 'mixed', 'supported', 'contradicted', 'not_yet_resolvable'][s_suppkey % 5 + 1] AS before, ['accept', 'narrow', 'reject', 'narrow'][s_suppkey % 4 + 1] AS decision, CASE WHEN s_nationkey % 7 <> 0 THEN ['mixed', 'supported', 'insufficient'][s_nationkey % 3 + 1] END AS narrowed FROM supplier),
      f AS (SELECT *, CASE before WHEN 'mixed' THEN 1 WHEN 'supported' THEN 2 WHEN 'contradicted' THEN 2 ELSE 0 END AS b, CASE narrowed WHEN 'mixed' THEN 1 WHEN 'supported' THEN 2 ELSE 0 END AS n FROM s)
      SELECT s_suppkey, before, decision, narrowed, CASE WHEN decision = 'reject' THEN 'insufficient' WHEN decision = 'narrow' AND narrowed IS NOT NULL AND n < b THEN narrowed ELSE before END AS status, decision = 'narrow' AND narrowed IS NOT NULL AND n > b AS wants_firmer FROM f""",
    "answer_scores": f"""WITH {ANSWERS}, c AS (SELECT count(*) AS examples, count(*) FILTER (ran) AS scored, count(*) FILTER (ran AND answer IS NOT NULL) AS answered, count(*) FILTER (ran AND near) AS "right", count(*) FILTER (ran AND same) AS strictly_right,
      (2 * count(*) FILTER (ran))::BIGINT AS cited, count(*) FILTER (ran AND grounded) AS grounded FROM z) SELECT *, round("right" / scored, 6) AS accuracy_over_scored, round("right" / answered, 6) AS accuracy_over_answered, round(grounded / cited, 6) AS grounding FROM c""",
    "strict_answers": f"WITH {ANSWERS} SELECT answer, gold, count(*) AS n, any_value(number) AS number, any_value(same) AS same, any_value(near) AS near FROM z GROUP BY answer, gold",
    "prediction_summary": f"""WITH {ALIGNED}, l AS (SELECT DISTINCT gold AS label FROM a), c AS (SELECT label, count(*) FILTER (gold = label AND prediction = label) AS hit, count(*) FILTER (gold = label) AS support, count(*) FILTER (prediction = label) AS made FROM l, a GROUP BY label),
      f AS (SELECT gold, count(*) AS n FROM a GROUP BY gold ORDER BY n DESC, min(id) LIMIT 1)
      SELECT count(*) AS n, round(avg((gold = prediction)::INT), 6) AS accuracy, (SELECT round(avg(2 * hit / nullif(support + made, 0)), 6) FROM c) AS macro_f1, round(avg((prediction <> '__MISSING__')::INT), 6) AS coverage, (SELECT round(n / (SELECT count(*) FROM a), 6) FROM f) AS floor, (SELECT gold FROM f) AS floor_label FROM a""",
    "joint_label_scores": """WITH d AS (SELECT coalesce(source, '?') AS company, length(coalesce(text, '')) AS n, len(string_split(coalesce(text, ''), ' ')) AS w FROM documents),
      r AS (SELECT company, n % 3 AS g, CASE WHEN n % 11 = 0 THEN 9 ELSE w % 3 END AS p, n % 4 = w % 4 AS e FROM d), m AS (SELECT avg((g = p)::INT) AS a FROM r GROUP BY company)
      SELECT count(*) AS n, (SELECT count(*) FROM m) AS companies, round(avg((g = p)::INT), 6) AS accuracy, round(avg(e::INT), 6) AS evidence_accuracy, round(avg((g = p AND e)::INT), 6) AS joint_accuracy, round(count(*) FILTER (g = 0 AND p = 1) / nullif(count(*) FILTER (g = 0), 0), 6) AS false_adverse_rate,
        round(count(*) FILTER (g = 2 AND p IN (0, 1)) / nullif(count(*) FILTER (g = 2), 0), 6) AS unjustified_rate, round(avg((p IN (0, 1))::INT), 6) AS determinate_rate, round(count(*) FILTER (p IN (0, 1) AND p = g) / nullif(count(*) FILTER (p IN (0, 1)), 0), 6) AS accuracy_when_determinate, (SELECT round(avg(a), 6) FROM m) AS company_macro_accuracy FROM r""",
    "citation_recall": """WITH p AS (SELECT l_orderkey AS example, l_partkey % 5 AS doc, l_linenumber % 3 AS page, l_returnflag AS r, l_linestatus AS s FROM lineitem), g AS (SELECT DISTINCT example, doc, page FROM p WHERE r = 'R'), c AS (SELECT DISTINCT example, doc, page, 1 AS hit FROM p WHERE s = 'O')
      SELECT example, count(*) AS expected, count(hit) AS found, round(count(hit) / count(*), 6) AS recall, count(hit) = count(*) AS whole FROM g LEFT JOIN c USING (example, doc, page) GROUP BY example""",
    "repeated_runs": f"""WITH {EV}, r AS (SELECT strftime(e.at, '%Y-%m') AS arm, claim * 3 + k % 3 AS c, status, k % 4 <> 0 AS f, k % 3 = 0 AS ok, amount > 100 AS failed, k FROM e),
      b AS (SELECT arm, c, count(*) FILTER (NOT failed) AS run, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND f) AS found, count(*) FILTER (NOT failed AND ok) AS ok, sum(k)::BIGINT AS tokens, count(DISTINCT status) FILTER (NOT failed) AS s FROM r GROUP BY ALL)
      SELECT arm, sum(run)::BIGINT AS run, sum(failed)::BIGINT AS failed, round(sum(found) / sum(run), 6) AS found, round(sum(ok) / sum(run), 6) AS status_correct, round(count(*) FILTER (run > 1 AND s = 1) / nullif(count(*) FILTER (run > 1), 0), 6) AS consistent, sum(tokens)::BIGINT AS tokens FROM b GROUP BY arm""",
    "cost_or_unknown": f"""WITH {EV}, p(status, i, c, o) AS (VALUES ('click', 2.0::DOUBLE, 1.0::DOUBLE, 8.0::DOUBLE), ('view', 0.5, 0.1, 2.0), ('purchase', 8.0, 4.0, 30.0), ('signup', 1.0, 0.5, 4.0))
      SELECT claim AS arm, CASE WHEN count(i) = count(*) THEN round(sum(k * 9 * i + k * c + k % 10 * o) / 1e6, 9) END AS cost FROM e LEFT JOIN p USING (status) GROUP BY claim""",
    "run_comparison": f"""WITH {EV}, r AS (SELECT claim, CASE status WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS run, max(k) AS k, max(CASE WHEN k % 5 <> 0 THEN k / 100 END) AS score FROM e GROUP BY ALL HAVING max(k) > 20),
      b AS (SELECT r.*, x.k % 2 <> r.k % 2 AS differs FROM r JOIN r x ON x.claim = r.claim AND x.run = 0)
      SELECT claim, bool_or(differs) FILTER (run IN (1, 2)) AS order_changes_status, CASE WHEN count(*) FILTER (run IN (1, 2)) > 0 AND count(score) FILTER (run < 3) > 1 THEN round(max(score) FILTER (run < 3) - min(score) FILTER (run < 3), 6) END AS order_score_range, count(*) FILTER (run > 2 AND differs) AS changed FROM b GROUP BY claim""",
    "plain_text_passages": r"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS b, unnest(range(len(regexp_split_to_array(text, '\n\s*\n')))) AS n FROM documents),
      s AS (SELECT doc_id, n, string_split(regexp_replace(trim(regexp_replace(b, '\s+', ' ', 'g')), '([.!?])\s+([A-Z‘“"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM b),
      p AS (SELECT doc_id, n, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) > 800 THEN list_concat(a, x) ELSE list_append(a[:-2], a[-1] || ' ' || x[1]) END) AS p FROM s),
      u AS (SELECT doc_id, n, unnest(range(len(p))) AS k, unnest(p) AS passage FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS place, md5(passage) AS digest FROM u WHERE passage <> ''""",
    "claim_to_turn": "WITH a AS (SELECT conv_id, turn AS claim, substring(text, length(text) // 4 + 1, greatest(1, length(text) // 2)) AS piece FROM conversations) SELECT conv_id, claim, min(turn) AS turn FROM a JOIN conversations USING (conv_id) WHERE piece <> '' AND contains(text, piece) GROUP BY ALL",
    "finding_of_claim": r"""WITH t AS (SELECT conv_id AS c, turn AS finding, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q, CASE WHEN turn = 0 THEN trim(regexp_replace(lower(substring(text, length(text) // 2 + 1) || ' and on'), '\s+', ' ', 'g')) END AS w FROM conversations),
      b AS (SELECT c, unnest(range(len(a))) AS i, unnest(a) AS ch, len(a) AS n FROM (SELECT c, string_split(w, '') AS a FROM t WHERE w <> '')), f AS (SELECT c, finding, unnest(range(len(a))) AS j, unnest(a) AS ch FROM (SELECT c, finding, string_split(q, '') AS a FROM t)),
      m AS (SELECT c, finding, i - j AS d, i, n, i - row_number() OVER (PARTITION BY c, finding, i - j ORDER BY i) AS run FROM f JOIN b USING (c, ch)), r AS (SELECT c, finding, n, d, run, count(*) AS k FROM m GROUP BY ALL),
      s AS (SELECT c, finding, max(k) / any_value(n) AS covered FROM r GROUP BY c, finding) SELECT c AS "case", finding, round(covered, 6) AS covered FROM s WHERE covered >= 0.6 QUALIFY row_number() OVER (PARTITION BY c ORDER BY covered DESC, finding) = 1""",
    "neutralized_tags": "WITH s AS (SELECT page_id, regexp_replace(html, '<(/?script)', '&lt;\\1', 'gi') AS safe FROM pages) SELECT page_id, len(regexp_extract_all(safe, '&lt;/?script')) + 1 AS pieces, md5(safe) AS digest, contains(lower(safe), '<script') AS left FROM s".replace("AS left", 'AS "left"'),
    "protected_retention": r"""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS t, trim(regexp_replace(coalesce(string_agg(text, '  ' ORDER BY turn) FILTER (turn % 3 < 2), ''), '\s+', ' ', 'g')) AS h FROM conversations GROUP BY conv_id)
      SELECT conv_id, round(len(list_filter(t, lambda x: contains(h, trim(regexp_replace(x, '\s+', ' ', 'g'))))) / len(t), 6) AS kept FROM t""",
    "official_export": "SELECT doc_id, CASE quality WHEN 1 THEN 'Supported' WHEN 0 THEN 'Conflicting Evidence/Cherrypicking' ELSE 'Not Enough Evidence' END AS label, quality IS NULL AS placeholder FROM documents LEFT JOIN labels USING (doc_id)",
    "round_robin_parts": 'SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 4 AS part, (row_number() OVER (ORDER BY item_id) - 1) // 4 AS "at" FROM benchmark',
}
