"""Evidence grouped by the observation that it comes from, so that repetition counts once, whatever the order of arrival.

Items: (claim, id, span, target, quote, repeats), where repeats names the span whose observation the item repeats, or is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.text import family_key
from claimspark.operators.components import components
from claimspark.session import materialize


def admitted(items: DataFrame) -> DataFrame:
    """The items, each span once for each target: the least id."""
    first = F.row_number().over(W.partitionBy("claim", "span", "target").orderBy("id"))
    return items.withColumn("__n", first).where("__n = 1").drop("__n")


def originals(items: DataFrame) -> DataFrame:
    """claim, span, original: a span's first item about the claim, else its first item."""
    return items.groupBy("claim", "span").agg(F.min(F.struct((F.col("target") != "claim").alias("other"), "id")).alias("o")).select("claim", "span", F.col("o.id").alias("original"))


def groups(items: DataFrame) -> DataFrame:
    """claim, id, group, origin. Items of equal wording are one observation, and so are an item and the original of the span
    that it repeats, over any number of steps. A group is named after its least original wording; origin is repetition where
    the repeated span is held, else independent."""
    none = F.lit("\u0002")
    node = lambda c: F.concat_ws("\u0001", F.coalesce(F.col("claim").cast("string"), none), F.coalesce(F.col(c), none))
    held = admitted(items).withColumn("wording", family_key("quote"))
    held = held.withColumn("own", F.min("wording").over(W.partitionBy("claim", "id")))
    of = originals(held).select("claim", F.col("span").alias("repeats"), F.col("original").alias("id"))
    of = of.join(held.groupBy("claim", "id").agg(F.min("own").alias("from")), ["claim", "id"]).select("claim", "repeats", "from", F.lit(True).alias("repetition"))
    held = held.join(of, ["claim", "repeats"], "left").withColumn("repetition", F.coalesce("repetition", F.lit(False)))
    held = materialize(held.select("claim", "id", "wording", "repetition", node("wording").alias("a"), node("own").alias("b"), F.when(F.col("repetition"), node("from")).alias("c")), "reconcile-held")
    # An item has one wording, so items hang together as wordings do: nodes are wordings, edges those between unequal ones, each once.
    edges = held.select("a", F.explode(F.array("b", "c")).alias("b")).where("a <> b").distinct()
    words = held.groupBy(F.col("a").alias("node"), "wording").agg(F.bool_and("repetition").alias("repeated"))
    words = words.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = F.min(F.when(~F.col("repeated"), F.col("wording")))
    names = words.groupBy("label").agg(F.coalesce(own, F.min("wording")).alias("group"))
    named = words.join(names, "label").select(F.col("node").alias("a"), "group")
    return held.join(named, "a").select("claim", "id", "group", F.when(F.col("repetition"), "repetition").otherwise("independent").alias("origin"))


def versions(events: DataFrame) -> DataFrame:
    """claim, group, members, active, version after (claim, group, seq, action): admit adds a member, withdraw takes one (of none, nothing).

    A version begins at 1 and rises with each withdrawal and each time that an emptied group is filled again.
    """
    order = W.partitionBy("claim", "group").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("action") == "admit", 1).when(F.col("action") == "withdraw", -1).otherwise(0)
    run = events.withColumn("step", step).withColumn("sum", F.sum("step").over(upto)).withColumn("low", F.least(F.lit(0), F.min("sum").over(upto)))
    run = run.withColumn("members", F.col("sum") - F.col("low")).withColumn("before", F.coalesce(F.lag("members").over(order), F.lit(0)))
    taken = (F.col("step") == -1) & (F.col("before") > 0)
    filled = (F.col("step") == 1) & (F.col("before") == 0)
    out = run.groupBy("claim", "group").agg(F.max_by("members", "seq").alias("members"), F.count_if(taken).alias("taken"), F.count_if(filled).alias("filled"))
    return out.where("filled > 0").select("claim", "group", "members", (F.col("members") > 0).alias("active"), (F.col("taken") + F.col("filled")).alias("version"))


def upserts(events: DataFrame) -> DataFrame:
    """Each (claim, group, seq, version, log_evidence, weight) with outcome: applied, repeat (the version that is held, with the same data),
    conflict (the same version with other data), stale (an older version) or invalid (a version below 1, a weight outside 0 to 1, a number that is not finite)."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    valid = finite("log_evidence") & finite("weight") & F.col("weight").between(0, 1) & (F.col("version") >= 1) & (F.trim("group") != "")
    checked = events.withColumn("valid", F.coalesce(valid, F.lit(False)))
    before = W.partitionBy("claim", "group").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("valid"), F.col("version"))).over(before)
    data = F.when(F.col("valid"), F.struct("log_evidence", "weight"))
    first = F.first(data, ignorenulls=True).over(W.partitionBy("claim", "group", "version").orderBy("seq"))
    out = checked.withColumns({"newest": newest, "held": first})
    outcome = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("newest").isNull() | (F.col("version") > F.col("newest")), "applied")
        .when(F.col("version") < F.col("newest"), "stale")
        .when(F.col("held") == F.struct("log_evidence", "weight"), "repeat")
        .otherwise("conflict")
    )
    return out.withColumn("outcome", outcome).drop("valid", "newest", "held")


def unit_versions(members: DataFrame, versions: DataFrame) -> DataFrame:
    """unit, version of (unit, group) and (group, version): the sum of the members' versions."""
    return members.join(versions.select("group", "version"), "group").groupBy("unit").agg(F.sum("version").alias("version"))


def lineage(calculations: DataFrame, items: DataFrame) -> DataFrame:
    """calculation, group: the observations behind the spans that a calculation reads; (claim, calculation, span) and (claim, span, group)."""
    return calculations.join(items.select("claim", "span", "group").distinct(), ["claim", "span"]).select("claim", "calculation", "group").distinct()


def answered(questions: DataFrame, answers: DataFrame, items: DataFrame) -> DataFrame:
    """questions (claim, question, status) after answers (claim, question, seq, status, span): the last one that counts. An answer that cites no admitted
    span doesn't answer; other statuses need none."""
    cites = answers.join(items.select("claim", "span").distinct().withColumn("held", F.lit(True)), ["claim", "span"], "left")
    counts = (F.col("status") != "answered") | F.coalesce("held", F.lit(False))
    last = cites.where(counts).groupBy("claim", "question").agg(F.max_by("status", "seq").alias("now"))
    return questions.join(last, ["claim", "question"], "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def bayes_factor(prior: Column, factor: Column) -> Column:
    """The probability after a factor; null where either is out of its range."""
    odds = F.log(prior) - F.log1p(-prior) + F.log(factor)
    return F.when((prior > 0) & (prior < 1) & (factor > 0), F.when(odds >= 0, 1 / (1 + F.exp(-odds))).otherwise(F.exp(odds) / (1 + F.exp(odds))))


def after_withdrawal(items: DataFrame, withdrawn: DataFrame, reads: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of items (claim, id, span, group), of calculations and of questions when the withdrawn (claim, id) go.

    reads: (claim, calculation, span, group), what each calculation rests on: one goes if any of its groups has no item left, or a span it cites was withdrawn and no
    admitted item cites it any more. questions: (claim, question, status, id), one row for each item that an answer rests on: a
    question whose items are all gone is open again; one without items stays.
    """
    gone = withdrawn.select("claim", "id").distinct()
    left = items.join(gone, ["claim", "id"], "left_anti")
    uncited = items.join(gone, ["claim", "id"], "left_semi").select("claim", "span").distinct().join(left.select("claim", "span").distinct(), ["claim", "span"], "left_anti")
    active = left.select("claim", "group").distinct().withColumn("active", F.lit(True))
    broken = reads.join(active, ["claim", "group"], "left").join(uncited.withColumn("uncited", F.lit(True)), ["claim", "span"], "left")
    broken = broken.where(F.col("active").isNull() | F.col("uncited")).select("claim", "calculation").distinct()
    calculations = reads.select("claim", "calculation").distinct().join(broken, ["claim", "calculation"], "left_anti")
    rest = questions.join(gone.withColumn("gone", F.lit(True)), ["claim", "id"], "left")
    rest = rest.groupBy("claim", "question").agg(F.max("status").alias("status"), F.count("id").alias("had"), F.count_if(F.col("id").isNotNull() & F.col("gone").isNull()).alias("has"))
    return left, calculations, rest.select("claim", "question", F.when((F.col("had") > 0) & (F.col("has") == 0), "open").otherwise(F.col("status")).alias("status"))
