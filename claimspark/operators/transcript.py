"""Earnings calls as sentences in order: segments, turns, changes within a speaker. Columns: call, idx, speaker, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREPARED, QA, UNKNOWN = "prepared", "qa", "unknown"
#: Fixed value: a question boundary that leaves less than this share prepared is not believed.
MIN_PREPARED_SHARE = 0.25
# Fixed value: wording that hands the call over to questions.
QA_MARKER = (
    r"(?i)question[- ]and[- ]answer"
    r"|begin the question"
    r"|open(?:ing)?\s+(?:up\s+)?the\s+lines?\s+(?:up\s+)?(?:for|to)\s+questions?"
    r"|ready\s+(?:for|to\s+take)\s+(?:your\s+)?questions?"
    r"|operator[,.]?\s+(?:do\s+we\s+have|are\s+there|any)\b[^.]{0,25}questions?"
    r"|(?:first|next)\s+question\s+(?:comes|is|will\s+come)\s+from"
    r"|question\s+comes\s+from\s+"
    r"|turn\s+(?:it|the\s+call)\s+(?:back\s+)?(?:over\s+)?to\s+[^.]{0,30}questions?"
)


def segments(sentences: DataFrame, marker: str = QA_MARKER) -> DataFrame:
    """Adds qa_start (the index after the last line that matches `marker`; null if none, or too early) and segment."""
    call = W.partitionBy("call")
    start = F.max(F.when(F.col("text").rlike(marker), F.col("idx"))).over(call) + 1
    n = F.count(F.lit(1)).over(call)
    out = sentences.withColumn("qa_start", start).withColumn("qa_start", F.when(F.col("qa_start") >= MIN_PREPARED_SHARE * n, F.col("qa_start")))
    return out.withColumn("segment", F.when(F.col("qa_start").isNull(), UNKNOWN).when(F.col("idx") >= F.col("qa_start"), QA).otherwise(PREPARED))


def within_speaker(sentences: DataFrame, value: Column) -> DataFrame:
    """call, idx, delta: an answer's value less its speaker's mean over prepared remarks (an unnamed speaker is one of its own)."""
    own = W.partitionBy("call", "speaker")
    base = F.avg(F.when(F.col("segment") == PREPARED, value)).over(own)
    out = sentences.withColumns({"value": value, "base": base})
    return out.where((F.col("segment") == QA) & F.col("value").isNotNull() & F.col("base").isNotNull()).select("call", "idx", (F.col("value") - F.col("base")).alias("delta"))


def turns(sentences: DataFrame) -> DataFrame:
    """call, first, last, speaker, segment, text: runs of adjoining sentences of one speaker in one segment."""
    order = W.partitionBy("call").orderBy("idx")
    before = lambda c: F.lag(c).over(order)
    same = F.col("speaker").eqNullSafe(before("speaker")) & F.col("segment").eqNullSafe(before("segment")) & (before("idx") == F.col("idx") - 1)
    numbered = sentences.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("turn", F.sum("new").over(order))
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    out = numbered.groupBy("call", "turn", "speaker", "segment").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), lines.alias("lines"))
    return out.select("call", "first", "last", "speaker", "segment", F.array_join(F.col("lines.text"), " ").alias("text"))


def turn_holding(points: DataFrame, turns: DataFrame) -> DataFrame:
    """points (call, idx) with the turn that holds them."""
    return points.join(turns, (points["call"] == turns["call"]) & points["idx"].between(turns["first"], turns["last"])).select(points["call"], points["idx"], "first", "last", "speaker")


def company_speakers(sentences: DataFrame) -> DataFrame:
    """call, speaker: named speakers who speak in prepared remarks."""
    return sentences.where((F.col("segment") == PREPARED) & F.col("speaker").isNotNull()).select("call", "speaker").distinct()


def stratified(sentences: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` sentences of each call, taken from its segments in turn."""
    at = F.row_number().over(W.partitionBy("call", "segment").orderBy("idx"))
    first = F.min("idx").over(W.partitionBy("call", "segment"))
    out = sentences.withColumns({"at": at, "first": first})
    out = out.withColumn("pick", F.row_number().over(W.partitionBy("call").orderBy("at", "first")))
    return out.where(F.col("pick") <= limit).drop("at", "first", "pick")


def with_offsets(spans: DataFrame, document: str, order: str, text: str, gap: int) -> DataFrame:
    """Adds start, end (offsets in the texts joined by `gap` characters), prev and next (the neighbours' order values)."""
    w = W.partitionBy(document).orderBy(order)
    upto = F.sum(F.length(text) + gap).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = spans.withColumn("end", upto - gap).withColumn("start", F.col("end") - F.length(text))
    return out.withColumns({"prev": F.lag(order).over(w), "next": F.lead(order).over(w)})


def climbing(lines: DataFrame, document: str, order: str, rank: str) -> DataFrame:
    """The lines whose rank is above that of every line before: what is kept when a heading must climb over the last kept one."""
    before = F.max(rank).over(W.partitionBy(document).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(rank) > F.col("__before"))).drop("__before")


def sections(lines: DataFrame, headings: DataFrame, document: str, order: str, item: str) -> DataFrame:
    """Each line with the item of the last heading before it; headings and lines before the first one are left out."""
    marks = headings.select(document, order, F.col(item).alias("__item"))
    filled = F.last("__item", ignorenulls=True).over(W.partitionBy(document).orderBy(order))
    return lines.join(marks, [document, order], "left").withColumn("item", filled).where(F.col("__item").isNull() & F.col("item").isNotNull()).drop("__item")
