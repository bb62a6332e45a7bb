"""Earnings calls from folders: text.txt (a sentence a line), features.csv (a row a sentence), and speaker labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, pattern: str, keep_blank: bool = False) -> DataFrame:
    """call, idx, line of files under a folder that is named after the call."""
    files = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("call"), F.split("value", "\r?\n").alias("lines"))
    kept = files.withColumn("lines", F.transform("lines", lambda x: F.trim(x)) if keep_blank else F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != ""))
    return kept.select(F.url_decode("call").alias("call"), F.posexplode("lines").alias("idx", "line"))


def read_calls(spark: SparkSession, root: str, labels: str | None = None) -> DataFrame:
    """call, idx, text, speaker, features (map of the measures that are numbers).

    A call whose sentences and feature rows differ in number raises an error when it is read. Speaker labels are used only
    where there are as many as sentences, else the speakers are unknown.
    """
    text = lines_of(spark, f"{root}/*/text.txt").withColumnRenamed("line", "text")
    rows = lines_of(spark, f"{root}/*/features.csv")
    head = rows.where("idx = 0").select("call", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("names"))
    values = F.transform(F.split("line", ","), lambda v: F.trim(v).try_cast("double"))
    features = rows.where("idx > 0").join(head, "call").select("call", (F.col("idx") - 1).alias("idx"), F.map_filter(F.map_from_arrays("names", values), lambda k, v: v.isNotNull()).alias("features"))
    both = text.join(features, ["call", "idx"], "full")
    bad = both.groupBy("call").agg(F.count_if(F.col("text").isNull() | F.col("features").isNull()).alias("bad"))
    out = both.join(bad, "call").withColumn("text", F.when(F.col("bad") == 0, F.col("text")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("sentences and feature rows differ in number:"), "call")).cast("string"))).drop("bad")
    if labels is None:
        return out.select("call", "idx", "text", F.lit(None).cast("string").alias("speaker"), "features")
    named = lines_of(spark, f"{labels}/*/text.csv").where("idx > 0").select("call", (F.col("idx") - 1).alias("idx"), F.nullif(F.trim(F.element_at(F.split("line", ","), 1)), F.lit("")).alias("speaker"))
    fits = text.groupBy("call").count().join(named.groupBy("call").agg(F.count(F.lit(1)).alias("labels")), "call").where("count = labels").select("call")
    return out.join(named.join(fits, "call", "left_semi"), ["call", "idx"], "left").select("call", "idx", "text", "speaker", "features")


def listing(spark, root: str):
    """call: the folders under root that hold a transcript (text.txt), in order of their names. Only names are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "text.txt").load(root)
    return found.select(F.regexp_extract("path", r"([^/]+)/text\.txt$", 1).alias("call")).distinct().orderBy("call")
