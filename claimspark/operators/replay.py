"""Replaying an ordered trace of evidence events, claim by claim, as windows and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.operators.ledger import logit, sigmoid
from claimspark.operators.running import running_totals

STEPS = T.StructType(
    [
        T.StructField("claim", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()),
        T.StructField("active", T.LongType()), T.StructField("changed", T.BooleanType()), T.StructField("probability", T.DoubleType()),
    ]
)


def effects(events: DataFrame) -> DataFrame:
    """Each event of (claim, seq, action, group, log_evidence) with changed and what it adds to its claim: groups (1, 0 or -1) and odds.

    admit adds an item to its group, withdraw takes one (of none, nothing), correct replaces the log evidence of a group that has items. A
    group that has none counts nothing; the event that fills it again sets its log evidence. Windows spill, so a group of many events is
    slow but fits.
    """
    order = W.partitionBy("claim", "group").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("action") == "admit", 1).when(F.col("action") == "withdraw", -1).otherwise(0)
    run = events.withColumn("step", step).withColumn("total", F.sum("step").over(upto)).withColumn("items", F.col("total") - F.least(F.lit(0), F.min("total").over(upto)))
    run = run.withColumn("had", F.coalesce(F.lag("items").over(order), F.lit(0)))
    sets = ((F.col("step") == 1) & (F.col("had") == 0)) | ((F.col("step") == 0) & (F.col("had") > 0))
    run = run.withColumn("score", F.last(F.when(sets, F.col("log_evidence")), ignorenulls=True).over(upto))
    run = run.withColumn("odds_now", F.when(F.col("items") > 0, F.col("score")).otherwise(0.0)).withColumn("odds_before", F.coalesce(F.lag("odds_now").over(order), F.lit(0.0)))
    emptied_or_filled = (F.col("items") > 0) != (F.col("had") > 0)
    corrected = (F.col("step") == 0) & (F.col("had") > 0) & (F.col("odds_now") != F.col("odds_before"))
    return run.select(
        "claim", "seq", "action", "group", (emptied_or_filled | corrected).alias("changed"),
        ((F.col("items") > 0).cast("long") - (F.col("had") > 0).cast("long")).alias("groups"), (F.col("odds_now") - F.col("odds_before")).alias("odds"),
    )


def replay(events: DataFrame, prior: float = 0.5) -> DataFrame:
    """STEPS from (claim, seq, action, group, log_evidence): what each event did and what its claim has come to. Events of one seq go by group."""
    out = running_totals(effects(events), "claim", ["seq", "group"], {"active": "groups", "log_odds": "odds"})
    return out.select("claim", "seq", "action", F.col("active").cast("long").alias("active"), "changed", sigmoid(logit(F.lit(prior)) + F.col("log_odds")).alias("probability"))


def variants(events: DataFrame, seed: int, permutations: int) -> DataFrame:
    """events with run: each claim's trace as it is (base), with its admissions before the first other event in other orders (permutation_0, …), and changed at the end by one of
    its admissions: repeated under a new group (duplicate_source), repeated as it is (duplicate_event), withdrawn, corrected to no evidence, or joined by an irrelevant one.

    The orders and the admission that is acted on are drawn by a hash of the seed, so a run can be repeated.
    """
    claim = W.partitionBy("claim")
    draw = lambda *c: F.sha2(F.concat_ws("|", F.lit(str(seed)), *[x if isinstance(x, Column) else F.col(x).cast("string") for x in c]), 256)
    first_other = F.min(F.when(F.col("action") != "admit", F.col("seq"))).over(claim)
    held = events.withColumn("__head", F.coalesce(F.col("seq") < first_other, F.lit(True))).withColumn("__last", F.max("seq").over(claim))
    runs = [events.withColumn("run", F.lit("base"))]
    head = W.partitionBy("claim", "__head")
    for k in range(permutations):
        # The head's places stay the same, and its admissions are dealt to them in the order of a hash.
        places = held.withColumn("__at", F.row_number().over(head.orderBy("seq"))).select("claim", "__head", "__at", F.col("seq").alias("__seq"))
        dealt = held.withColumn("__at", F.when(F.col("__head"), F.row_number().over(head.orderBy(draw(F.lit(str(k)), "claim", "seq")))).otherwise(F.row_number().over(head.orderBy("seq"))))
        runs.append(dealt.join(places, ["claim", "__head", "__at"]).withColumn("seq", F.col("__seq")).select(*events.columns, F.lit(f"permutation_{k}").alias("run")))
    withdrawn = held.where("action = 'withdraw'").select("claim", "group").distinct()
    admits = held.where("action = 'admit'").join(withdrawn, ["claim", "group"], "left_anti")
    one = admits.withColumn("__n", F.row_number().over(claim.orderBy(draw("claim", "seq")))).where("__n = 1")
    changed = {
        "duplicate_source": {"group": F.concat("group", F.lit("-copy"))}, "duplicate_event": {}, "withdrawal": {"action": F.lit("withdraw")},
        "correction": {"action": F.lit("correct"), "log_evidence": F.lit(0.0)}, "irrelevant_addition": {"group": F.lit("irrelevant"), "log_evidence": F.lit(0.0)},
    }
    for name, columns in changed.items():
        added = one.withColumn("seq", F.col("__last") + 1).withColumns(columns).select(*events.columns)
        runs.append(events.join(one.select("claim"), "claim", "left_semi").unionByName(added).withColumn("run", F.lit(name)))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def outcomes(traces: DataFrame, prior: float = 0.5) -> DataFrame:
    """claim, run, active, log_odds, updates: what each run of each claim has come to, and the events that changed something."""
    each = effects(traces.withColumn("claim", F.struct("claim", "run")))
    out = each.groupBy("claim").agg(F.sum("groups").alias("active"), F.sum("odds").alias("odds"), F.count_if("changed").alias("updates"))
    return out.select("claim.claim", "claim.run", "active", (logit(F.lit(prior)) + F.col("odds")).alias("log_odds"), "updates")
