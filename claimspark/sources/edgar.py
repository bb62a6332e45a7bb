"""Filing metadata from files: submissions, company facts and the ticker list, as published in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT = ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "items")
SUBMISSIONS = "cik string, filings struct<recent: struct<" + ", ".join(f"{c}: array<string>" for c in RECENT) + ">>"
OLDER = ", ".join(f"{c} array<string>" for c in RECENT)
FACTS = "cik string, facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, accn: string>>>>>>"
TICKERS = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one document each; columns that a file lacks are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def padded(cik: Column | str) -> Column:
    """The ten-digit form of a company's number."""
    return F.lpad(F.regexp_replace(F.col(cik).cast("string") if isinstance(cik, str) else cik.cast("string"), r"\D", ""), 10, "0")


def filings(submissions: DataFrame) -> DataFrame:
    """One row for each filing: cik, form, accession, filed, report (null where empty), document, items (array), url."""
    return block_rows(submissions.select("cik", "filings.recent.*"))


def older_filings(blocks: DataFrame) -> DataFrame:
    """The rows of `filings` from the further files that a company with many filings has; the company's number is in the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"CIK(\d{10})-submissions", 1)
    return block_rows(blocks.select(name.alias("cik"), *RECENT))


def block_rows(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("cik", F.explode(F.arrays_zip(*RECENT)).alias("f"))
    number = F.regexp_replace("cik", r"^0+", "")
    folder = F.regexp_replace("f.accessionNumber", "-", "")
    return rows.select(
        padded("cik").alias("cik"), F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").cast("date").alias("filed"),
        F.expr("try_cast(nullif(f.reportDate, '') as date)").alias("report"), F.col("f.primaryDocument").alias("document"),
        F.filter(F.transform(F.split(F.coalesce("f.items", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("items"),
        F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), number, folder, F.col("f.primaryDocument")).alias("url"),
    )


def of_form(filed: DataFrame, form: str, limit: int) -> DataFrame:
    """The newest `limit` filings of a form for each company."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession")))
    return filed.where(F.col("form") == form).withColumn("rank", rank).where(F.col("rank") <= limit)


def events(filed: DataFrame, item: str) -> DataFrame:
    """company, filed, accession of the current reports that name an item."""
    return filed.where(F.col("form").startswith("8-K") & F.array_contains("items", item)).select(F.col("cik").alias("company"), "filed", "accession")


def facts(company_facts: DataFrame) -> DataFrame:
    """company, taxonomy, tag, unit, start (null for a point in time), end, value, accession."""
    tags = company_facts.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "fact"))
    rows = tags.select("cik", "taxonomy", "tag", F.explode("fact.units").alias("unit", "rows")).select("cik", "taxonomy", "tag", "unit", F.explode("rows").alias("r"))
    day = lambda c: F.expr(f"try_cast(r.{c} as date)")
    return rows.select(padded("cik").alias("company"), "taxonomy", "tag", "unit", day("start").alias("start"), day("end").alias("end"), F.col("r.val").alias("value"), F.col("r.accn").alias("accession"))


def of_tag(filed: DataFrame, tag: str, taxonomy: str = "us-gaap", unit: str = "USD") -> DataFrame:
    """The facts of one tag, taxonomy and unit with rank, the period that ends last first."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("company").orderBy(F.desc("end"), F.desc("accession")))
    return filed.where((F.col("tag") == tag) & (F.col("taxonomy") == taxonomy) & (F.col("unit") == unit)).withColumn("rank", rank)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """ticker (upper case), cik; of rows that repeat a ticker the first by position."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", TICKERS)).alias("at", "c")).select(F.upper("c.ticker").alias("ticker"), F.col("at").cast("int").alias("at"), F.col("c.cik_str").alias("n"))
    return rows.groupBy("ticker").agg(padded(F.min_by("n", "at")).alias("cik"))
