"""What a task of passages holds at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.operators import matching, retrieval


def test_token_lists_are_few_at_a_time():
    column = pa.array([[str(i)] for i in range(1000)])
    assert [t[0] for t in matching.listed(column)] == [str(i) for i in range(1000)]
    assert max(len(column.slice(at, matching.LISTED)) for at in range(0, 1000, matching.LISTED)) <= 64


def test_batches_are_small_whatever_the_session_says(spark, monkeypatch):
    """A task had 10 000 passages at once, with their tokens as Python strings."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 10_000)
    try:
        passages = spark.range(4000).coalesce(1).select("id", F.concat(F.lit("some words of passage number"), F.col("id").cast("string")).alias("text"))
        index = matching.asked(passages.limit(3), X.passage_tokens)
        schema = "rows long"
        sizes = matching.in_batches(passages, index, spark.createDataFrame([], schema).schema, lambda part, index: ([part.num_rows],)).collect()
        assert sum(r["rows"] for r in sizes) == 4000 and max(r["rows"] for r in sizes) <= matching.BATCH
    finally:
        spark.conf.unset(conf)


@pytest.mark.parametrize("batch", [7, 1000])
def test_rows_are_those_of_the_joined_pairs(spark, monkeypatch, batch):
    """Ids of strings, empty texts and ties, in batches of any size."""
    monkeypatch.setattr(matching, "BATCH", batch)
    passages = spark.range(90).select(F.concat(F.lit("p"), "id").alias("id"), F.when(F.col("id") % 9 != 0, F.concat_ws(" ", F.lit("alpha beta"), *[F.concat(F.lit("word"), (F.col("id") % n).cast("string")) for n in (2, 3, 5)])).alias("text"))
    queries = spark.createDataFrame([("a", "alpha word1 word2"), ("b", "beta word4"), ("c", ""), ("d", "nothing here")], "id string, text string")
    found = lambda: [sorted(map(tuple, df.collect())) for df in (retrieval.best_match(queries, passages), retrieval.keyword_search(queries, passages, 4), retrieval.dropped(queries, passages))]
    own = found()
    monkeypatch.setattr(matching, "asked", lambda *a, **k: None)
    assert own == found()
