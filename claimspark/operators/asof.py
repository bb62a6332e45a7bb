"""Search as of several cutoffs in one pass: at each, only documents that were there by then count, in the statistics too.

Documents fall into segments of time, one before each cutoff. Numbers of documents, lengths and the documents of each token are counted by segment and summed up
to each cutoff; a document is then scored once for each cutoff from its segment on, with that cutoff's statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions import text as X
from claimspark.operators import matching
from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import materialize


def segment(day: Column, cutoffs: list[str]) -> Column:
    """The number of the first cutoff by which a document is there; as many as there are cutoffs for one that is later than all, or whose day isn't known."""
    out = F.lit(len(cutoffs))
    for i in range(len(cutoffs) - 1, -1, -1):
        out = F.when(day <= F.lit(cutoffs[i]).cast("date"), i).otherwise(out)
    return out


def later(documents: DataFrame, cutoffs: list[str]) -> DataFrame:
    """cutoff, id: the documents (id, day) that each cutoff leaves out because they are later, or of no known day."""
    cutoffs = sorted(cutoffs)
    at = documents.select("id", segment(F.col("day"), cutoffs).alias("s"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("cutoff")) for i, c in enumerate(cutoffs)])
    return at.select("id", F.explode(F.filter(each, lambda c: c["i"] < F.col("s"))).alias("c")).select("c.cutoff", "id")


def bm25_at(queries: DataFrame, passages: DataFrame, cutoffs: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, cutoff, id, score, rank: for each cutoff (a date as text; a stated, short list) what BM25 gives over the passages (id, text, day) that it admits.

    Tokens are [a-z0-9]+ of the lower-cased text. Of equal scores the least id comes first; a passage that shares no token has no row. Null texts count as
    empty passages, and a passage of an unknown day is never admitted.
    """
    cutoffs = sorted(cutoffs)
    n_at, tokens = len(cutoffs), X.found(F.lower(F.coalesce("text", F.lit(""))), "[a-z0-9]+")
    sized = passages.select("id", tokens.alias("tokens"), segment(F.col("day"), cutoffs).alias("s")).where(F.col("s") < n_at)
    sized = materialize(sized.withColumn("length", F.size("tokens")), "asof-tokens")
    by_segment = {r["s"]: (r["n"], r["length"]) for r in sized.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).collect()}
    n = np.cumsum([by_segment.get(i, (0, 0))[0] for i in range(n_at)])
    mean = np.maximum(np.cumsum([by_segment.get(i, (0, 0))[1] for i in range(n_at)]) / np.maximum(n, 1), 1e-9)
    index = matching.asked(queries, X.index_tokens)
    wanted = broadcast_if_small(queries.select(F.explode(X.index_tokens("text")).alias("token")).distinct())
    held = sized.select("s", F.explode(F.array_distinct("tokens")).alias("token")).join(wanted, "token", "left_semi")
    df = held.groupBy("token").agg(F.array(*[F.count_if(F.col("s") <= i) for i in range(n_at)]).alias("df"))
    idf = F.transform("df", lambda d, i: F.log(1 + (F.get(F.array(*[F.lit(int(x)) for x in n]), i) - d + 0.5) / (d + 0.5)))
    weights = df.select("token", idf.alias("idf"))
    ids = passages.schema["id"].dataType
    if index is not None:
        found = in_tasks(sized, index, {r["token"]: np.array(r["idf"]) for r in weights.collect()}, mean, k1, b, k, queries.schema["id"].dataType, ids)
    else:
        asked = queries.select(F.col("id").alias("query"), F.explode(X.index_tokens("text")).alias("token"))
        postings = sized.select("id", "s", "length", F.explode("tokens").alias("token")).groupBy("id", "s", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
        means = F.array(*[F.lit(float(x)) for x in mean])
        each = postings.join(weights, "token").join(asked, "token").withColumn("at", F.explode(F.sequence(F.col("s"), F.lit(n_at - 1))))
        weight = F.get("idf", F.col("at")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.get(means, F.col("at"))))
        found = each.groupBy("query", "at", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query", "at").orderBy(F.desc("score"), "id"))
    named = F.get(F.array(*[F.lit(c) for c in cutoffs]), F.col("at"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", named.alias("cutoff"), "id", "score", "rank")


def in_tasks(sized: DataFrame, index: matching.Asked, idf: dict[str, np.ndarray], mean: np.ndarray, k1: float, b: float, k: int, query_type: T.DataType, id_type: T.DataType) -> DataFrame:
    """(query, at, id, score): each batch's k best passages of each query at each cutoff."""
    schema = T.StructType([T.StructField("query", query_type), T.StructField("at", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def use(part, index):
        scores, since = np.zeros((len(mean), part.num_rows, len(index.ids))), part["s"].to_pylist()
        for row, tokens in enumerate(matching.listed(part["tokens"])):
            found, tf = np.unique([t for t in tokens if t in index.postings], return_counts=True)
            if not len(found):
                continue
            hits = [index.postings[t] for t in found]
            to, many = np.concatenate(hits), [len(h) for h in hits]
            weight = np.stack([idf[t] for t in found])
            for at in range(since[row], len(mean)):
                own = tf / (tf + k1 * (1 - b + b * len(tokens) / mean[at])) * (k1 + 1) * weight[:, at]
                scores[at, row] = np.bincount(to, np.repeat(own, many), minlength=len(index.ids))
        scores = np.round(scores, 6)
        best = [matching.leading(scores[at], part["id"], k) for at in range(len(mean))]
        rows, of = (np.concatenate([b[i] for b in best]) for i in (0, 1))
        at = np.repeat(np.arange(len(mean), dtype=np.int32), [len(b[0]) for b in best])
        return index.ids[of], at, part["id"].take(pa.array(rows)), scores[at, rows, of]

    return matching.in_batches(sized.select("id", "s", "tokens"), index, schema, use)
