"""Scores of answers, citations, paired labels and repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions import text as X
from claimspark.functions.wording import plain_text
from claimspark.operators.scoring import MISSING, class_metrics, ratio
from claimspark.operators.sizes import broadcast_if_small
from claimspark.operators.substring import longest_run

#: How near an answer must be, how near a key number, units whose number is a share of 1, the share of a claim that a quote must cover.
NEAR, KEY_NEAR, RATIO_UNITS, COVERED = 0.02, 0.05, ("ratio", "fraction", "share", "proportion"), 0.6
#: Operations of the program notation.
ARITHMETIC, TABLE_OPERATIONS = ("add", "subtract", "multiply", "divide", "exp", "greater"), ("table_max", "table_min", "table_sum", "table_average")


def usable(prediction: Column, status: Column, error: Column) -> Column:
    """Whether there is a prediction that ran without an error; no status counts as one that did."""
    return prediction.isNotNull() & (F.coalesce(status, F.lit("ok")) == "ok") & (F.coalesce(error, F.lit("")) == "")


def strict_number(answer: Column) -> Column:
    """The number that an answer is, a percentage as a share; null for anything else, so no number is taken out of prose."""
    s = F.regexp_replace(F.lower(F.trim(answer)), ",", "")
    written = s.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?%?$")
    value = F.regexp_replace(s, "%$", "").try_cast("double")
    value = F.when(s.endswith("%"), value / 100).otherwise(value)
    return F.when(written & (F.abs(value) < float("inf")), value)


def same_answer(answer: Column, gold: Column) -> Column:
    """Equal to five decimals, or both yes or both no."""
    word = lambda c: F.lower(F.trim(c)).isin("yes", "no")
    number = F.round(strict_number(answer), 5) == F.round(strict_number(gold), 5)
    return F.coalesce(F.when(word(answer) | word(gold), F.lower(F.trim(answer)) == F.lower(F.trim(gold))).otherwise(number), F.lit(False))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def right(answer: Column, gold: Column) -> Column:
    """Whether an answer is near the gold one, signs aside; a gold share below 1 may be given in percent, a larger one may not."""
    got, want = F.abs(digits_only(answer)), F.abs(digits_only(gold))
    return F.coalesce((F.abs(got - want) <= NEAR) | ((want < 1) & (F.abs(got - want * 100) <= NEAR)), F.lit(False))


def answer_scores(rows: DataFrame) -> DataFrame:
    """One row of scores of (answer, gold, status, cited, grounded): rows with the status not_run stay out of the scored ones."""
    ran = F.coalesce(F.col("status"), F.lit("ok")) != "not_run"
    given = ran & F.col("answer").isNotNull()
    ok = given & right(F.col("answer"), F.col("gold"))
    out = rows.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(ran).alias("scored"), F.count_if(given).alias("answered"), F.count_if(ok).alias("right"),
        F.count_if(given & same_answer(F.col("answer"), F.col("gold"))).alias("strictly_right"), F.sum(F.when(ran, F.col("cited"))).alias("cited"), F.sum(F.when(ran, F.col("grounded"))).alias("grounded"),
    )
    of = lambda a, b: ratio(F.col(a), F.col(b))
    return out.select("*", of("right", "scored").alias("accuracy_over_scored"), of("right", "answered").alias("accuracy_over_answered"), of("grounded", "cited").alias("grounding"))


def number_forms(value: Column, unit: Column) -> Column:
    """A key number as it may be written: also in percent where its unit is a share of 1."""
    v = digits_only(value)
    return F.when(v.isNull(), F.array().cast("array<double>")).when(F.lower(F.trim(unit)).isin(*RATIO_UNITS), F.array(v, v * 100)).otherwise(F.array(v))


def safe_program(tokens: Column, rows: Column) -> Column:
    """Whether an array of tokens is a program of the notation and nothing else: four tokens a step (operation, two arguments,
    bracket), then EOF; an argument is a number, a constant, an earlier step or, for a table operation, one of its `rows` and none."""
    steps = F.size(tokens) - 1
    shape = (F.get(tokens, steps) == "EOF") & (steps % 4 == 0) & (steps > 0) & (F.size(tokens) <= 401)
    at = lambda i: F.get(tokens, i)

    def argument(i: Column, step: Column) -> Column:
        a = at(i)
        back = F.coalesce(F.regexp_extract(a, r"^#(\d{1,9})$", 1).try_cast("int") < step, F.lit(False))
        return (F.length(a) <= 1000) & F.when(a.startswith("#"), back).otherwise(a.rlike(r"^const_(?:m1|[+-]?(?:\d+(?:\.\d*)?|\.\d+))$") | strict_number(a).isNotNull())

    def step_fits(k: Column) -> Column:
        i = k * 4
        op = at(i)
        listed = op.isin(*[f"{o}(" for o in TABLE_OPERATIONS])
        known = listed | op.isin(*[f"{o}(" for o in ARITHMETIC])
        first = (listed & F.array_contains(rows, at(i + 1))) | argument(i + 1, k)
        second = (listed & (at(i + 2) == "none")) | argument(i + 2, k)
        return known & (at(i + 3) == ")") & first & second

    fits = F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), (steps / 4).cast("int") - 1)), step_fits)
    return F.coalesce(F.when(shape, fits), F.lit(False))


def citation_recall(gold: DataFrame, cited: DataFrame) -> DataFrame:
    """example, expected, found, recall, whole: the annotated pages that are cited; gold and cited: (example, doc, page), each page once."""
    want = gold.select("example", "doc", "page").distinct()
    hit = want.join(cited.select("example", "doc", "page").distinct().withColumn("hit", F.lit(1)), ["example", "doc", "page"], "left")
    out = hit.groupBy("example").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"))
    return out.withColumns({"recall": F.col("found") / F.col("expected"), "whole": F.col("found") == F.col("expected")})


def exact_answer(answer: Column, gold: Column) -> Column:
    """Equal but for case and white space; a blank answer is none."""
    return F.coalesce((F.trim(answer) != "") & (plain_text(answer) == plain_text(gold)), F.lit(False))


def summary(rows: DataFrame) -> DataFrame:
    """One row over (id, gold, prediction): n, accuracy, macro_f1, coverage, floor, floor_label. The floor is the share of the commonest gold label, of
    equals the one that comes first by id; a missing prediction is wrong and counts in n."""
    per = class_metrics(rows).join(rows.select(F.col("gold").alias("label")).distinct(), "label", "left_semi").agg(F.avg("f1").alias("macro_f1"))
    gold = rows.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    floor = gold.agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "gold")).alias("f")).select((-F.col("f.less")).alias("most"), F.col("f.gold").alias("floor_label"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("prediction")).alias("hits"), F.count_if(F.col("prediction") != MISSING).alias("made"))
    parts = total.unionByName(per, True).unionByName(floor, True)  # one row each
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    of = lambda a: ratio(F.col(a), F.col("n"))
    return one.select("n", of("hits").alias("accuracy"), "macro_f1", of("made").alias("coverage"), of("most").alias("floor"), "floor_label")


def joint_scores(rows: DataFrame, absent: str = "absent", present: str = "present", open_: str = "undetermined") -> DataFrame:
    """One row over (company, gold, prediction, gold_evidence, evidence), two label spaces: accuracies, findings made where there are none,
    conclusions drawn where none can be, and the mean of the companies' accuracies."""
    hit, both = F.col("gold") == F.col("prediction"), F.col("gold_evidence") == F.col("evidence")
    determinate = F.col("prediction").isin(absent, present)
    share = lambda c: F.avg(c.cast("double"))
    by = rows.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.count_if(both).alias("evidence_hits"), F.count_if(hit & both).alias("joint"), share(hit).alias("own"),
        F.count_if(F.col("gold") == absent).alias("absent"), F.count_if((F.col("gold") == absent) & (F.col("prediction") == present)).alias("adverse"),
        F.count_if(F.col("gold") == open_).alias("open"), F.count_if((F.col("gold") == open_) & determinate).alias("unjustified"),
        F.count_if(determinate).alias("determinate"), F.count_if(determinate & hit).alias("determinate_hits"),
    )
    counts = [c for c in by.columns if c not in ("company", "own")]
    total = by.agg(F.count(F.lit(1)).alias("companies"), F.avg("own").alias("company_macro_accuracy"), *[F.sum(c).alias(c) for c in counts])
    of = lambda a, b: ratio(F.col(a), F.col(b))
    return total.select(
        "n", "companies", of("hits", "n").alias("accuracy"), of("evidence_hits", "n").alias("evidence_accuracy"), of("joint", "n").alias("joint_accuracy"), of("adverse", "absent").alias("false_adverse_rate"),
        of("unjustified", "open").alias("unjustified_rate"), of("determinate", "n").alias("determinate_rate"), of("determinate_hits", "determinate").alias("accuracy_when_determinate"), "company_macro_accuracy",
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """arm, run, failed, found, status_correct, consistent, tokens of (arm, case, status, found, correct, error, tokens): rates leave out failed runs, costs
    don't; consistent is the share of the cases run more than once whose runs all have one status."""
    ran = F.col("error").isNull()
    by = rows.groupBy("arm", "case").agg(
        F.count_if(ran).alias("run"), F.count_if(~ran).alias("failed"), F.count_if(ran & F.col("found")).alias("found"), F.count_if(ran & F.col("correct")).alias("correct"), F.sum("tokens").alias("tokens"),
        F.count_distinct(F.when(ran, F.coalesce("status", F.lit("")))).alias("statuses"),
    )
    repeated = F.col("run") > 1
    out = by.groupBy("arm").agg(
        *[F.sum(c).alias(c) for c in ("run", "failed", "found", "correct", "tokens")], F.count_if(repeated & (F.col("statuses") == 1)).alias("same"), F.count_if(repeated).alias("repeated"),
    )
    of = lambda a, b: ratio(F.col(a), F.col(b))
    return out.select("arm", "run", "failed", of("found", "run").alias("found"), of("correct", "run").alias("status_correct"), of("same", "repeated").alias("consistent"), "tokens")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """arm, cost of (arm, model, tokens_in, tokens_cached, tokens_out) at (model, price_in, price_cached, price_out) a million; null, which is unknown, where a model that was used has no price."""
    priced = usage.join(broadcast_if_small(prices), "model", "left")
    paid = (F.col("tokens_in") - F.col("tokens_cached")) * F.col("price_in") + F.col("tokens_cached") * F.col("price_cached") + F.col("tokens_out") * F.col("price_out")
    return priced.groupBy("arm").agg(F.when(F.count("price_in") == F.count(F.lit(1)), F.sum(paid) / 1e6).alias("cost"))


def run_comparison(runs: DataFrame) -> DataFrame:
    """claim, order_changes_status, order_score_range, changed of (claim, run, complete, status, score): what other orders and variants of a trace changed against its base. Incomplete runs are left out, and a
    claim whose base is incomplete has no row; with no other order the first two are null; changed counts the other variants whose status is not the base's."""
    whole = runs.where("complete")
    base = whole.where("run = 'base'").select("claim", F.col("status").alias("base_status"))
    both = whole.join(base, "claim")
    order, differs = F.col("run").startswith("permutation_"), F.col("status") != F.col("base_status")
    held = F.when(order | (F.col("run") == "base"), F.col("score"))
    out = both.groupBy("claim").agg(
        F.count_if(order).alias("orders"), F.bool_or(order & differs).alias("any"), F.count(held).alias("scores"), (F.max(held) - F.min(held)).alias("range"), F.count_if(~order & differs).alias("changed"),
    )
    return out.select("claim", F.when(F.col("orders") > 0, F.col("any")).alias("order_changes_status"), F.when((F.col("orders") > 0) & (F.col("scores") > 1), F.col("range")).alias("order_score_range"), "changed")


@F.pandas_udf(T.DoubleType())
def covered(quote, wanted):
    """The share of the wanted text that the quote has as one run of characters."""
    import pandas as pd

    return pd.Series([longest_run(q or "", w) / len(w) if w else 0.0 for q, w in zip(quote, wanted)])


def finding_of_claim(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """case, finding, covered: the finding of (case, finding, quote) whose quote covers most of the claim text of (case, wanted), if that is enough; of equals the first."""
    both = findings.join(claims, "case").withColumn("covered", covered(plain_text(F.col("quote")), plain_text(F.col("wanted"))))
    best = both.groupBy("case").agg(F.min(F.struct((-F.col("covered")).alias("less"), "finding")).alias("b"))
    return best.where(F.col("b.less") <= -COVERED).select("case", F.col("b.finding").alias("finding"), F.round(-F.col("b.less"), 6).alias("covered"))


def unverified(summary_text: Column, allowed: Column) -> Column:
    """The numbers of a text that are near none of an array of allowed ones, each once, in order."""
    stated = F.transform(X.number_tokens(summary_text), lambda n: n.try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(stated, lambda n: ~F.exists(allowed, lambda a: F.abs(F.abs(n) - F.abs(a)) <= KEY_NEAR))))
