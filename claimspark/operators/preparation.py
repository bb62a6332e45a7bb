"""Published datasets as inputs a system may see, references it may not, and documents it may search; selections, exports and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.wording import canonical, plain_text

# Class orders of a published dataset, wording of a snippet that gives the verdict away, and the snippets kept for a claim.
CLAIM_LABELS, EVIDENCE_LABELS = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO", "DISPUTED"), ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")
LEAK = (
    r"(?i)fact[\s-]?check|politifact|snopes|full\s?fact|africa\s?check|pants on fire|pinocchio|\brat(?:ed|ing)\b.{0,15}\b(?:true|false|misleading)"
    r"|\b(?:mostly|half|partly)[\s-](?:true|false)\b|\bdebunk"
)
SNIPPETS = 30


def class_name(value: Column, names: tuple[str, ...]) -> Column:
    """A label that may be given as its place in the class order."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), value.try_cast("int")), value.cast("string"))


def split_columns(rows: DataFrame, key: str, gold: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs, references): the gold columns are in the references only."""
    return rows.drop(*gold), rows.select(key, *gold)


def table_chunks(rows: DataFrame) -> DataFrame:
    """example, chunk, kind, text of (example, pre_text, post_text, table): every text and every row of the table."""
    text = F.concat(F.coalesce("pre_text", F.array().cast("array<string>")), F.coalesce("post_text", F.array().cast("array<string>")))
    texts = rows.select("example", F.posexplode(text).alias("i", "text")).select("example", F.concat(F.lit("text_"), "i").alias("chunk"), F.lit("text").alias("kind"), "text")
    cells = rows.select("example", F.posexplode("table").alias("i", "cells"))
    return texts.unionByName(cells.select("example", F.concat(F.lit("table_"), "i").alias("chunk"), F.lit("table_row").alias("kind"), F.array_join("cells", " | ", "None").alias("text")))


def searchable_snippets(claims: DataFrame, snippets: DataFrame, most: int = SNIPPETS) -> DataFrame:
    """example, place, text: of the snippets (claim, rank, text) retrieved for the wording of a claim (example, claim), the first ones that say something and don't give the verdict away."""
    kept = snippets.where((F.trim("text") != "") & ~F.col("text").rlike(LEAK)).withColumn("claim", F.trim("claim"))
    found = claims.select("example", F.trim("claim").alias("claim")).join(kept, "claim")
    place = F.row_number().over(W.partitionBy("example").orderBy("rank"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("example", "place", "text")


def article_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, labels) of (example, claim_label, evidences: array of (evidence_id, article, evidence, evidence_label)): each sentence is a document named by its article; labels stay apart."""
    each = rows.select("example", "claim_label", F.explode_outer("evidences").alias("e"))
    documents = each.where("e is not null").select("example", "e.evidence_id", F.col("e.evidence").alias("text"), F.replace(F.col("e.article"), F.lit(" "), F.lit("_")).alias("article"))
    labels = each.select("example", class_name(F.col("claim_label"), CLAIM_LABELS).alias("claim_label"), "e.evidence_id", class_name(F.col("e.evidence_label"), EVIDENCE_LABELS).alias("evidence_label"))
    return documents, labels


def numbered_claims(rows: DataFrame, order: str, prefix: str, width: int = 4) -> DataFrame:
    """rows with example (the prefix and the zero-based place in the published order) and the label in its one spelling."""
    place = F.row_number().over(W.orderBy(order)) - 1  # a published split of some thousand claims
    return rows.withColumn("example", F.concat(F.lit(prefix), F.lpad(place.cast("string"), width, "0"))).withColumn("label", canonical(F.col("label")))


def admitted_documents(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """document, content, retrieved: stored documents and the new ones of (content, retrieved). An id is a digest of the content, and what is admitted again stays as it was stored."""
    digest = F.concat(F.lit("doc-"), F.substring(F.sha2("content", 256), 1, 16))
    new = arriving.withColumn("document", digest).groupBy("document").agg(F.min_by("content", "retrieved").alias("content"), F.min("retrieved").alias("retrieved"))
    return stored.select("document", "content", "retrieved").unionByName(new.join(stored, "document", "left_anti").select("document", "content", "retrieved"))


def alignment_errors(inputs: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, problem: ids that only one side has, or that a side has more than once."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(inputs, "i").join(count(references, "r"), key, "full").na.fill(0, ["i", "r"])
    problem = F.when(F.col("r") == 0, "no reference").when(F.col("i") == 0, "no input").when((F.col("i") > 1) | (F.col("r") > 1), "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def scope_errors(allowed: DataFrame, passages: DataFrame) -> DataFrame:
    """passage, problem: evidence (example, passage) that an example allows but that is not among the passages (example, passage) or another example's, and passages that no example allows."""
    known = passages.select("passage", F.col("example").alias("owner"))
    wrong = allowed.join(known, "passage", "left").select("passage", F.when(F.col("owner").isNull(), "unknown").when(F.col("owner") != F.col("example"), "of another example").alias("problem")).where("problem is not null")
    orphans = passages.select("passage").join(allowed.select("passage").distinct(), "passage", "left_anti").withColumn("problem", F.lit("allowed by none"))
    return wrong.unionByName(orphans).distinct()


def native_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (row, passage, example, document) with native: the passage itself where it is known (passage, example, document), else the one passage of its example and document, else null."""
    direct = known.select("passage", F.col("passage").alias("direct"))
    single = known.groupBy("example", "document").agg(F.count(F.lit(1)).alias("n"), F.min("passage").alias("only")).where("n = 1").select("example", "document", "only")
    out = rows.join(direct, "passage", "left").join(single, ["example", "document"], "left")
    return out.select("row", "passage", "example", "document", F.coalesce("direct", "only").alias("native"))


def templates(inputs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One empty prediction for each input (example), to be filled: fields by name and type."""
    return inputs.select("example", F.lit("ok").alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in fields.items()], F.lit(None).cast("string").alias("error"))


def selected(inputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The inputs of a declared selection (example, place), in its order; an id that is chosen twice counts once."""
    order = chosen.groupBy("example").agg(F.min("place").alias("place"))
    return inputs.join(order, "example").select("place", *inputs.columns)


def exact_fields(answer: Column, gold: Column) -> Column:
    return plain_text(answer) == plain_text(gold)


def file_manifest(spark, pattern: str) -> DataFrame:
    """path, bytes, sha256 of the files that a pattern names; a file is digested in one task, so it must fit there."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
