"""Shared session helpers: reading the tables and writing scratch tables that every executor can reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir` (a local path or any URI Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset a local
    master gets a fresh temporary folder, and a cluster gets one beside its warehouse,
    never a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="claimspark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back: the lineage ends here,
    and what an executor loses later is reread, not recomputed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
