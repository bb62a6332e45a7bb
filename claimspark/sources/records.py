"""Datasets and predictions from files, with the checks that keep an evaluation honest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.text import CATEGORIES


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, category) of a word list in CSV: a word is of a category if its entry is not 0 or empty."""
    rows = spark.read.option("header", True).csv(path)
    word = F.lower(F.trim("Word"))
    marks = F.array(*[F.when(~F.coalesce(F.trim(c), F.lit("0")).isin("0", ""), F.lit(c)) for c in CATEGORIES if c in rows.columns])
    return rows.where(F.coalesce(word, F.lit("")) != "").select(word.alias("word"), F.explode(F.array_compact(marks)).alias("category")).distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, JSON lines, or a JSON list, by the name's end."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)


def gold(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows, where every gold field must be there; 0 is a label, null, '', [] and {} are not."""
    for f in fields:
        kind = rows.schema[f].dataType.typeName()
        empty = F.col(f).isNull() | (F.size(f) == 0 if kind in ("array", "map") else F.col(f) == "" if kind == "string" else F.lit(False))
        rows = rows.withColumn(f, F.when(~empty, F.col(f)).otherwise(F.raise_error(f"no gold label in {f}").cast(rows.schema[f].dataType)))
    return rows


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def aligned(references: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every reference with its prediction, null where there is none. Raises on repeated or unknown keys."""
    for bad, what in ((repeated(references, key), "repeated reference"), (repeated(predictions, key), "repeated prediction"), (unknown(predictions, references, key), "unknown prediction")):
        found = bad.select(key).take(3)
        if found:
            raise ValueError(f"{what}: {', '.join(str(r[0]) for r in found)}")
    return references.join(predictions, key, "left")


def select_by_hash(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows that come first by a hash of seed and key, whatever their labels."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("__order", order).orderBy("__order", key).limit(n).drop("__order")


def export(rows: DataFrame, visible: list[str], gold_fields: list[str], key: str, path: str) -> None:
    """Write what a system may see and what it is scored on to different folders."""
    rows.select(key, *visible).write.mode("errorifexists").json(f"{path}/visible")
    gold(rows.select(key, *gold_fields), gold_fields).write.mode("errorifexists").json(f"{path}/gold")


def probabilities_hold(p, labels: list[str], tolerance: float = 1e-6):
    """Whether a map has exactly these labels and finite shares that sum to 1."""
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce((F.array_sort(F.map_keys(p)) == F.array_sort(F.array(*[F.lit(x) for x in labels]))) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0)) & (F.abs(total - 1) <= tolerance), F.lit(False))
