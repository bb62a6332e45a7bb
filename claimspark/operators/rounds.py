"""Investigations in rounds: which questions come next, what is routed out, what a finding rests on, when a score still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.functions.wording import plain_text
from claimspark.operators.substring import first_holder

#: Questions of a round, confidence from which a sentence that is no claim is left out, the highest score of one unit, characters of what a finding rests on, characters from which background is compressed, kinds of spans that may hold claims.
ROUND, EXCLUDE, MOST_LOG_EVIDENCE, RESTS_ON, BACKGROUND, CLAIM_KINDS = 3, 0.8, 5.0, 120, 1200, ("paragraph", "heading", "caption")


def next_questions(questions: DataFrame, requested: DataFrame, most: int = ROUND) -> DataFrame:
    """claim, question, place of (claim, question, priority, open): the open requested ones (claim, question), then the others of a priority above 0,
    the greatest first, up to `most` or as many as are requested."""
    asked = requested.select("claim", "question").distinct().withColumn("first", F.lit(True))
    some = questions.where("open").join(asked, ["claim", "question"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    some = some.where("first or priority > 0")
    own = W.partitionBy("claim")
    ranked = some.withColumns({"place": F.row_number().over(own.orderBy(F.desc("first"), F.when(F.col("first"), 0.0).otherwise(-F.col("priority")), "question")), "wanted": F.count_if("first").over(own)})
    return ranked.where(F.col("place") <= F.greatest(F.lit(most), F.col("wanted"))).select("claim", "question", "place")


def critical_open(questions: DataFrame) -> DataFrame:
    """claim, question of the critical ones that are not answered; (claim, question, critical, status)."""
    return questions.where(F.col("critical") & (F.col("status") != "answered")).select("claim", "question")


def routed(sentences: DataFrame) -> DataFrame:
    """The sentences (kind, is_claim, confidence, selected) that claims are looked for in: of a fitting kind, unless they are surely no claim and nobody selected them."""
    surely_none = ~F.col("is_claim") & (F.col("confidence") >= EXCLUDE) & ~F.coalesce("selected", F.lit(False))
    return sentences.where(F.col("kind").isin(*CLAIM_KINDS) & ~F.coalesce(surely_none, F.lit(False)))


def saving(before: Column, after: Column) -> Column:
    """The share that is saved; null of nothing."""
    return F.when(before > 0, 1 - after / before)


def sources(items: DataFrame) -> DataFrame:
    """claim, source, independent: each source once, with the flag it has where it comes first; (claim, source, place, independent)."""
    return items.groupBy("claim", "source").agg(F.min_by("independent", "place").alias("independent"))


def public(beliefs: DataFrame, hidden: tuple[str, ...] = ("belief", "previous_score", "new_score")) -> DataFrame:
    """What may be shown: without the research scores."""
    return beliefs.drop(*hidden)


def resting_on() -> Column:
    """What a finding (quote, tag, prior_quote, accession, agent) rests on: the first of them that says something, shortened. Findings that rest on the same thing count once."""
    return F.substring(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("quote", "tag", "prior_quote", "accession")], F.col("agent")), 1, RESTS_ON)


def finding_groups(findings: DataFrame) -> DataFrame:
    """claim, place, group of the findings (claim, place, stance, and what they rest on) that found something: groups are numbered by what they rest on, in order."""
    kept = findings.where(F.coalesce(F.col("stance") != "not_found", F.lit(True))).withColumn("rests_on", resting_on())
    return kept.select("claim", "place", (F.dense_rank().over(W.partitionBy("claim").orderBy("rests_on")) - 1).alias("group"))


def context(passages: DataFrame) -> DataFrame:
    """claim, context, compress of (claim, place, decisive, text): decisive passages, then the background, by blank lines, and whether the background is long enough to be compressed. A claim's passages are the few that were retrieved for it."""
    decisive = F.col("decisive")
    background = F.when(~decisive, F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct((~decisive).alias("after"), "place", "text")))
    out = passages.groupBy("claim").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("context"), F.sum(F.length(background)).alias("n"), F.count(background).alias("many"))
    return out.select("claim", "context", (F.coalesce("n", F.lit(0)) + 2 * F.greatest(F.lit(0), F.col("many") - 1) >= BACKGROUND).alias("compress"))


def span_of_claim(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """claim, pos of claims (claim, doc, text): the first span (doc, pos, text) of its document that holds it, case and white space aside; null if none does."""
    plain = lambda df, *names: df.select(*names, plain_text(F.col("text")).alias("text"))
    return first_holder(plain(claims, "claim", "doc"), plain(spans, "doc", "pos"))


def wiring(inputs: Column, steps: Column, output: Column, expected: Column) -> Column:
    """A key that two calculations share if they read the same figures from the same passages, combine them in the same order by the same operations and hold the
    same result against the same stated value, whatever the names. inputs: (name, source, value), steps: (op, args, out)."""
    identity = F.map_from_entries(F.transform(inputs, lambda i: F.struct(i["name"], F.concat_ws("=", i["source"], i["value"]))))
    position = F.map_from_entries(F.transform(steps, lambda s, n: F.struct(s["out"], F.concat(F.lit("#"), n.cast("string")))))
    earlier = lambda a, n: F.exists(F.slice(steps, F.lit(1), n), lambda s: s["out"] == a)
    named = lambda a, n: F.coalesce(F.try_element_at(identity, a), F.when(earlier(a, n), F.try_element_at(position, a)), F.concat(F.lit("?"), a))
    wired = F.transform(steps, lambda s, n: F.concat(s["op"], F.lit("("), F.array_join(F.transform(s["args"], lambda a: named(a, n)), ","), F.lit(")")))
    result = F.coalesce(F.try_element_at(position, output), output, F.lit(""))
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.map_values(identity)), ";"), F.array_join(wired, ";"), result, F.coalesce(expected, F.lit(""))), 256)


def context_key(members: DataFrame, conditions: list[str]) -> DataFrame:
    """unit, context: what a unit's score is valid for, of its distinct observations (unit, quote, relationship, comparable, differs) and the conditions (columns that are alike in a unit). Observations are
    hashed before they are gathered."""
    one = F.substring(F.sha2(F.concat_ws("|", X.family_key("quote"), "relationship", F.col("comparable").cast("string"), F.array_join(F.array_sort("differs"), ",")), 256), 1, 16)
    rows = members.select("unit", *conditions, one.alias("one")).distinct()
    return rows.groupBy("unit").agg(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.collect_set("one")), ","), *[F.max(c).cast("string") for c in conditions]), 256).alias("context"))


def usable_scores(scores: DataFrame, contexts: DataFrame) -> DataFrame:
    """The scores (unit, context, seq, log_evidence, cites) that count: the last of a unit for its present context that is finite, within the limit, and cites an admitted item."""
    good = F.coalesce(~F.isnan("log_evidence") & (F.abs("log_evidence") <= MOST_LOG_EVIDENCE) & F.col("cites"), F.lit(False))
    now = scores.join(contexts, ["unit", "context"], "left_semi").where(good)
    return now.groupBy("unit", "context").agg(F.max_by("log_evidence", "seq").alias("log_evidence"))
