"""Numbered items of annual reports, from spans (doc, pos, text) in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.operators import transcript

# How an item's heading and a line of the contents are written, wording that points elsewhere, the items searched for
# candidates, the words below which a pointer is all there is, and the least words of a candidate.
HEADING = r"(?i)^\s*item\s+(\d{1,2})\s*([A-C])?\s*[.:\-–—]?\s*([^\n]{0,60})"
CONTENTS = r"(?i)\|\s*(?:page:?\s*)?\d{1,4}\s*$"
ELSEWHERE = r"(?i)incorporated\s+(?:herein\s+)?by\s+reference|appears?\s+in\s+a\s+separate\s+section|set\s+forth\s+in\s+(?:the\s+)?exhibit"
CANDIDATE_ITEMS, POINTER_WORDS, LEAST_WORDS = ("1A", "7"), 120, 12


def words(text: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def item_rank(item: Column) -> Column:
    """A number that orders items as 1, 1A, 1B, 2; an unknown one comes last."""
    letter = F.regexp_extract(item, r"^\d{1,2}([A-C]?)$", 1)
    return F.when(item.rlike(r"^\d{1,2}[A-C]?$"), F.regexp_extract(item, r"^(\d{1,2})", 1).try_cast("int") * 4 + F.when(letter == "", 0).otherwise(F.ascii(letter) - 64)).otherwise(99 * 4)


def headings(spans: DataFrame) -> DataFrame:
    """doc, pos, item, title of the spans that begin an item: written as a heading, no line of the contents, and of a higher item than every one before."""
    part = lambda i: F.regexp_extract("text", HEADING, i)
    named = spans.where(F.col("text").rlike(HEADING) & ~F.col("text").rlike(CONTENTS)).select(
        "doc", "pos", F.concat(part(1).try_cast("int").cast("string"), F.upper(part(2))).alias("item"), F.btrim(part(3), F.lit(" .:-")).alias("title")
    )
    return transcript.climbing(named.withColumn("rank", item_rank(F.col("item"))), "doc", "pos", "rank").drop("rank")


def sections(spans: DataFrame) -> DataFrame:
    """doc, item, title, spans, words, elsewhere: every item found; elsewhere is whether it only points to another document."""
    marks = headings(spans)
    held = transcript.sections(spans, marks, "doc", "pos", "item")
    # A pointer has few words, so the wording is looked for in spans and across the ends of two that adjoin; the text of an item is never gathered.
    after = F.lead("text").over(W.partitionBy("doc", "item").orderBy("pos"))
    told = F.concat_ws("\n", "text", after).rlike(ELSEWHERE)
    out = held.withColumn("told", told).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("spans"), F.sum(words("text")).alias("words"), F.bool_or("told").alias("told"))
    out = marks.join(out, ["doc", "item"], "left").na.fill(0, ["spans", "words"])
    return out.select("doc", "item", "title", "spans", "words", (F.coalesce("told", F.lit(False)) & (F.col("words") < POINTER_WORDS)).alias("elsewhere"))


def candidates(spans: DataFrame) -> DataFrame:
    """doc, pos, item of the spans that a risk is looked for in: of the items that hold risks, unless the item points elsewhere, with enough words."""
    usable = sections(spans).where(F.col("item").isin(*CANDIDATE_ITEMS) & ~F.col("elsewhere")).select("doc", "item")
    held = transcript.sections(spans, headings(spans), "doc", "pos", "item").where(F.col("item").isin(*CANDIDATE_ITEMS) & (words("text") >= LEAST_WORDS))
    return held.join(usable, ["doc", "item"], "left_semi").select("doc", "pos", "item")
