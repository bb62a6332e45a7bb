"""Passages scored against a small set of queries inside their own task, so that no list of all pairs is ever shuffled.

The queries' tokens are an inverted index that every task gets, only while they have at most BROADCAST_ROWS tokens. Each batch of passages
hands on no more than the best of it for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from claimspark.operators.sizes import BROADCAST_ROWS

#: Scores of a passage and a query that are worked on at once in a task.
CELLS = 2_000_000
#: Passages of an Arrow batch at most, and passages whose tokens are Python strings at once.
BATCH, LISTED = 1000, 64


class Asked:
    """The queries: ids, numbers of tokens, and for each token the queries that hold it."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([i for i, _ in rows])
        self.sizes = np.array([len(t) for _, t in rows], np.int64)
        found: dict[str, list[int]] = {}
        for at, (_, tokens) in enumerate(rows):
            for token in tokens:
                found.setdefault(token, []).append(at)
        self.postings = {token: np.array(at, np.int32) for token, at in found.items()}

    def shared(self, tokens) -> np.ndarray:
        """How many of a passage's distinct tokens each query has."""
        hits = [p for p in map(self.postings.get, tokens) if p is not None]
        return np.bincount(np.concatenate(hits), minlength=len(self.ids)) if hits else np.zeros(len(self.ids), np.int64)


def asked(queries: DataFrame, tokens, limit: int = BROADCAST_ROWS) -> Asked | None:
    """The index of (id, text), or None where it would be too large to hand to every task."""
    rows = queries.select("id", tokens("text").alias("t"))
    n = rows.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    return Asked([(r["id"], r["t"]) for r in rows.orderBy("id").collect()]) if n <= limit else None


def leading(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (passage, query) of the k best passages of each query with a score above 0; of equals the least ids. Rows are in order of id."""
    most = min(k, len(own))
    least = -np.partition(-score, most - 1, axis=0)[most - 1 : most]
    more, equal = score > least, score == least
    equal &= np.cumsum(equal, 0, dtype=np.int32) <= most - more.sum(0, keepdims=True)
    return np.nonzero((more | equal) & (score > 0))


def listed(column: pa.Array) -> Iterator[list]:
    """The token lists of a column, LISTED at a time."""
    for at in range(0, len(column), LISTED):
        yield from column.slice(at, LISTED).to_pylist()


def in_batches(df: DataFrame, index: Asked, schema: T.StructType, use: Callable) -> DataFrame:
    """The rows that use(part, index) makes of each part of the batches, an Arrow batch in order of id. A task's memory is that of BATCH passages, however many there are."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(index)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH:
        spark.conf.set(most, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, min(BATCH, CELLS // max(1, len(shared.value.ids))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = use(part.take(pc.sort_indices(part["id"])), shared.value)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    types = to_arrow_schema(schema).types
    return df.mapInArrow(run, schema)


def pairs(passages: DataFrame, tokens, index: Asked, score: Callable, k: int, l_type: T.DataType) -> DataFrame:
    """(l, r, l_n, r_n, shared): each batch's k best passages r of each query l by score(shared, l_n, r_n)."""
    schema = T.StructType([T.StructField("l", l_type), T.StructField("r", passages.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("l_n", "r_n", "shared")]])

    def use(part, index):
        n = np.array(pc.list_value_length(part["t"]), np.int64)
        shared = np.stack([index.shared(t) for t in listed(part["t"])])
        at, of = leading(np.where(shared > 0, score(shared, index.sizes[None, :], n[:, None]), 0.0), n, k)
        return index.ids[of], part["id"].take(pa.array(at)), index.sizes[of], n[at], shared[at, of]

    return in_batches(passages.select("id", tokens("text").alias("t")), index, schema, use)


def nearest(passages: DataFrame, tokens, index: Asked, score: Callable) -> DataFrame:
    """(id, best): every passage's best score over the queries, 0 without a shared token."""
    schema = T.StructType([passages.schema["id"], T.StructField("best", T.DoubleType())])

    def use(part, index):
        def best(t):
            shared = index.shared(t)
            hit = np.flatnonzero(shared)
            return float(score(shared[hit], index.sizes[hit], len(t)).max()) if len(hit) else 0.0

        return part["id"], [best(t) for t in listed(part["t"])]

    return in_batches(passages.select("id", tokens("text").alias("t")), index, schema, use)


def weighted(passages: DataFrame, index: Asked, weight: dict[str, float], k1: float, b: float, mean: float, k: int, l_type: T.DataType) -> DataFrame:
    """(query, id, score): each batch's k best passages (id, tokens) of each query by the saturated counts of its tokens."""
    schema = T.StructType([T.StructField("query", l_type), passages.schema["id"], T.StructField("score", T.DoubleType())])

    def use(part, index):
        scores = np.zeros((part.num_rows, len(index.ids)))
        for row, tokens in enumerate(listed(part["tokens"])):
            found, counts = np.unique([t for t in tokens if t in index.postings], return_counts=True)
            if len(found):
                hits = [index.postings[t] for t in found]
                tf = counts / (counts + k1 * (1 - b + b * len(tokens) / mean)) * (k1 + 1) * np.array([weight[t] for t in found])
                scores[row] = np.bincount(np.concatenate(hits), np.repeat(tf, [len(h) for h in hits]), minlength=len(index.ids))
        scores = np.round(scores, 6)
        at, of = leading(scores, part["id"], k)
        return index.ids[of], part["id"].take(pa.array(at)), scores[at, of]

    return in_batches(passages, index, schema, use)
