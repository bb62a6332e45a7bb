"""What may be scored and shown: reviewed references, annotated evidence, seeded samples, and whether evidence behaves as it must."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.operators import reconcile
from claimspark.operators.running import running_totals
from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import materialize

#: The labels of the two spaces, and what a packet of annotated evidence is called.
MATERIAL, EVIDENCE = ("present", "absent", "undetermined"), ("supported", "contradicted", "mixed", "insufficient", "not_yet_resolvable")
ORACLE = "ORACLE_ANNOTATED_EVIDENCE_NOT_RETRIEVAL"
INDEPENDENT, RETROSPECTIVE = "independent", "retrospective"


def reference_targets(references: DataFrame, mode: str, allow_draft: bool = False) -> DataFrame:
    """example, material, evidence, draft, problem: the labels that a paired reference is scored against, or why it may not be.

    references: (example, mode, review, reviewed_mode, reviewed_material, reviewed_evidence, draft_material, draft_evidence, ready, allowed_evidence, full_original, cutoff). Problems, the
    first that applies: mode (made for another one), draft_forbidden (drafts are never allowed where evidence is independent), incomplete (an independent packet that isn't ready, has no allowed
    evidence, not the whole original, or no cutoff), adjudicated_for_other_mode, unreviewed (only a retrospective draft may stand in, where that is allowed) and labels.
    """
    adjudicated = (F.col("review") == "adjudicated") & (F.col("reviewed_material").isNotNull() | F.col("reviewed_evidence").isNotNull() | F.col("reviewed_mode").isNotNull())
    adjudicated = F.coalesce(adjudicated, F.lit(False))
    stands_in = ~adjudicated & F.lit(mode == RETROSPECTIVE and allow_draft)
    complete = (F.col("ready") == "ready") & (F.col("allowed_evidence") > 0) & F.col("full_original") & F.col("cutoff").isNotNull()
    material, evidence = (F.when(adjudicated, F.col(f"reviewed_{c}")).when(stands_in, F.col(f"draft_{c}")) for c in ("material", "evidence"))
    problem = (
        F.when(~F.col("mode").eqNullSafe(F.lit(mode)), "mode")
        .when(F.lit(mode == INDEPENDENT and allow_draft), "draft_forbidden")
        .when(F.lit(mode == INDEPENDENT) & ~F.coalesce(complete, F.lit(False)), "incomplete")
        .when(adjudicated & ~F.col("reviewed_mode").eqNullSafe(F.lit(mode)), "adjudicated_for_other_mode")
        .when(~adjudicated & ~stands_in, "unreviewed")
        .when(~F.coalesce(material.isin(*MATERIAL) & evidence.isin(*EVIDENCE), F.lit(False)), "labels")
    )
    fine = problem.isNull()
    return references.select("example", F.when(fine, material).alias("material"), F.when(fine, evidence).alias("evidence"), F.when(fine, stands_in).alias("draft"), problem.alias("problem"))


def oracle_inputs(inputs: DataFrame, annotated: DataFrame) -> DataFrame:
    """inputs (example, …) with evidence_setting and oracle_evidence, an array of (text, document, page) in the annotators' order, of (example, place, text, document, page).

    This is the evidence of the answer and says so; an example without any has an empty array. An example's annotations are the few that its annotators made.
    """
    piece = F.struct("place", "text", "document", "page")
    by = annotated.groupBy(F.col("example").alias("__example")).agg(F.array_sort(F.collect_list(piece)).alias("__pieces"))
    listed = F.transform(F.coalesce("__pieces", F.array().cast(by.schema["__pieces"].dataType)), lambda p: F.struct(p["text"].alias("text"), p["document"].alias("document"), p["page"].alias("page")))
    out = inputs.join(by, F.col("example") == F.col("__example"), "left")
    return out.withColumns({"evidence_setting": F.lit(ORACLE), "oracle_evidence": listed}).drop("__example", "__pieces")


def seeded_sample(rows: DataFrame, order: list[str], k: int, seed: int) -> DataFrame:
    """The k rows that Python's random.Random(seed).sample takes of the rows in this order, with `draw`, their place in the sample.

    A sample of more than there are rows is refused. The places are drawn over numbers alone, k of them; the rows are numbered range by range.
    """
    n = rows.count()
    places = rows.sparkSession.createDataFrame([(p + 1, i) for i, p in enumerate(random.Random(seed).sample(range(n), k))], "__at long, draw int")
    one = rows.withColumns({"__all": F.lit(0), "__one": F.lit(1)})
    numbered = running_totals(one, "__all", order, {"__at": "__one"})
    return numbered.join(broadcast_if_small(places), "__at").select(*rows.columns, "draw")


def mean_squared(rows: DataFrame, probability: str = "p", outcome: str = "y") -> DataFrame:
    """brier: the mean squared error of probabilities against outcomes; 0 for none, unlike scoring.brier_nll."""
    return rows.agg(F.coalesce(F.avg(F.pow(F.col(probability) - F.col(outcome), 2)), F.lit(0.0)).alias("brier"))


def group_sizes(items: DataFrame) -> DataFrame:
    """claim, group, members of reconciled items."""
    return reconcile.groups(items).groupBy("claim", "group").agg(F.count(F.lit(1)).alias("members"))


def partition(items: DataFrame, own: Column) -> DataFrame:
    """claim, id, first: each own item with the least own id of its group, whatever the group is named after; a group without own items has one row of nulls."""
    groups = reconcile.groups(items).withColumn("own_id", F.when(own, F.col("id")))
    firsts = groups.groupBy("claim", "group").agg(F.min("own_id").alias("first"))
    return groups.join(firsts, ["claim", "group"]).where("own_id is not null or first is null").select("claim", F.col("own_id").alias("id"), "first")


def changed(before: DataFrame, after: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """claim, changed: whether the rows of each claim differ in `by`; nulls are equal."""
    side = lambda df, n: df.select("claim", *by).distinct().withColumn("side", F.lit(n))
    both = side(before, 1).unionByName(side(after, 2)).groupBy("claim", *by).agg(F.sum("side").alias("sides"))
    differ = both.where("sides <> 3").select("claim").distinct().withColumn("changed", F.lit(True))
    return claims.select("claim").distinct().join(differ, "claim", "left").select("claim", F.coalesce("changed", F.lit(False)).alias("changed"))


COPY = "-copy"


def repeating_adds_nothing(items: DataFrame, copied: Column) -> DataFrame:
    """claim, holds: whether each claim's items are grouped as before when the copied ones come again from another page (other id and span, the same words, of no declared original)."""
    named = items.withColumn("id", F.col("id").cast("string"))
    copy = named.where(copied).withColumns({"id": F.concat("id", F.lit(COPY)), "span": F.concat("span", F.lit(COPY)), "repeats": F.lit(None).cast("string")})
    own = ~F.col("id").endswith(COPY)
    out = changed(partition(named, own), partition(named.unionByName(copy), own), items, ["id", "first"])
    return out.select("claim", (~F.col("changed")).alias("holds"))


def withdrawal_recomputes(items: DataFrame, withdrawn: Column) -> DataFrame:
    """claim, holds of the claims that an item is withdrawn from: whether their groups or the groups' sizes are others than before."""
    hit = items.where(withdrawn).select("claim").distinct()
    own = items.join(hit, "claim", "left_semi")
    # Both sides are grouped at once, as claims of their own.
    side = lambda df, n: df.withColumn("claim", F.struct(F.lit(n).alias("side"), "claim"))
    sizes = materialize(group_sizes(side(own, 1).unionByName(side(own.where(~withdrawn), 2))), "withdrawal-sizes")
    of = lambda n: sizes.where(F.col("claim.side") == n).select("claim.claim", "group", "members")
    out = changed(of(1), of(2), hit, ["group", "members"])
    return out.select("claim", F.col("changed").alias("holds"))
