"""Passages for claims: similarity joins, keyword and vector search, rank fusion.

Claims are the stated query set. While their tokens are few every task scores its passages against all of them and hands on its best
(`matching`); beyond that, pairs come from an equi-join on tokens. Both give the same rows. Ties go to the passage that comes first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions import text as X
from claimspark.operators import matching
from claimspark.operators.sizes import broadcast_if_small

#: Passages that share this much vocabulary are the same reworded; a strength change below NOTICEABLE is none; rank fusion's k.
SAME, NOTICEABLE, RRF_K = 0.6, 0.5, 60


def overlaps(left: DataFrame, right: DataFrame, tokens) -> DataFrame:
    """(l, r, l_n, r_n, shared) for pairs that share a token; left and right: (id, text)."""
    l = left.select(F.col("id").alias("l"), tokens("text").alias("t")).select("l", F.size("t").alias("l_n"), F.explode("t").alias("token"))  # noqa: E741
    r = right.select(F.col("id").alias("r"), tokens("text").alias("t")).select("r", F.size("t").alias("r_n"), F.explode("t").alias("token"))
    return r.join(broadcast_if_small(l), "token").groupBy("l", "r", "l_n", "r_n").agg(F.count(F.lit(1)).alias("shared"))


def containment(shared, l_n, r_n):
    return shared / np.maximum(1, np.minimum(l_n, r_n))


def candidates(left: DataFrame, right: DataFrame, tokens, score, k: int) -> DataFrame:
    """(l, r, l_n, r_n, shared) of pairs that share a token, among them the k best of each l by score(shared, l_n, r_n)."""
    index = matching.asked(left, tokens)
    return overlaps(left, right, tokens) if index is None else matching.pairs(right, tokens, index, score, k, left.schema["id"].dataType)


def best_match(current: DataFrame, prior: DataFrame, same: float = SAME) -> DataFrame:
    """For each current (id, text) the closest prior one: id, closest, closest_id, status added or carried_over.

    Closeness is the share of the smaller vocabulary that the other has too, of equals the least id; without a shared word it is 0 and the id null.
    """
    score = F.col("shared") / F.least("l_n", "r_n")
    found = candidates(current, prior, X.passage_tokens, containment, 1).groupBy("l").agg(F.min(F.struct((-score).alias("less"), "r")).alias("b"))
    best = found.select(F.col("l").alias("id"), (-F.col("b.less")).alias("closest"), F.col("b.r").alias("closest_id"))
    out = current.select("id").join(best, "id", "left")
    closest = F.coalesce("closest", F.lit(0.0))
    return out.select("id", F.round(closest, 4).alias("closest"), "closest_id", F.when(closest >= same, "carried_over").otherwise("added").alias("status"))


def follow(current: DataFrame, prior: DataFrame, lexicon: DataFrame, same: float = SAME) -> DataFrame:
    """How the wording of each current passage moved from its closest prior one: id, closest_id, closest, strength_change, drift."""
    best = best_match(current, prior, same)
    strength = lambda df: X.densities(df, lexicon, "id", "text").select("id", (F.col("Strong_Modal") - F.col("Weak_Modal")).alias("strength"))
    now = strength(current)
    before = strength(prior.join(broadcast_if_small(best.select(F.col("closest_id").alias("id")).distinct()), "id", "left_semi")).select(F.col("id").alias("closest_id"), F.col("strength").alias("before"))
    found = best.join(now, "id", "left").join(before, "closest_id", "left")
    known = F.col("status") == "carried_over"
    change = F.when(known, F.round(F.col("strength") - F.col("before"), 4))
    drift = F.when(~known, "not_found").when(change <= -NOTICEABLE, "weakened").when(change >= NOTICEABLE, "firmer").otherwise("unchanged")
    return found.select("id", F.when(known, F.col("closest_id")).alias("closest_id"), "closest", change.alias("strength_change"), drift.alias("drift"))


def dropped(current: DataFrame, prior: DataFrame, same: float = SAME) -> DataFrame:
    """Prior passages without a counterpart among the current ones: id, similarity."""
    index = matching.asked(current, X.passage_tokens)
    if index is not None:
        best = matching.nearest(prior, X.passage_tokens, index, containment)
        return best.select("id", F.round("best", 4).alias("similarity")).where(F.col("similarity") < same)
    score = F.col("shared") / F.least("l_n", "r_n")
    best = overlaps(current, prior, X.passage_tokens).groupBy(F.col("r").alias("id")).agg(F.max(score).alias("best"))
    return prior.select("id").join(best, "id", "left").select("id", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("similarity")).where(F.coalesce(F.col("similarity"), F.lit(0.0)) < same)


def top(scored: DataFrame, k: int, by: str = "query", item: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_search(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """query, id, score (distinct query tokens present), rank."""
    found = candidates(queries, passages, X.index_tokens, lambda shared, l_n, r_n: shared.astype(float), k)
    return top(found.select(F.col("l").alias("query"), F.col("r").alias("id"), F.col("shared").alias("score")), k)


def overlap_match(queries: DataFrame, passages: DataFrame, k: int, least_words: int = 12) -> DataFrame:
    """query, id, score (shared tokens over the root of the product of both counts), rank; passages of few words are left out."""
    long = passages.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words)
    score = F.col("shared") / F.sqrt(F.col("l_n").cast("double") * F.col("r_n"))
    found = candidates(queries, long, X.match_tokens, lambda shared, l_n, r_n: np.round(shared / np.sqrt(l_n.astype(float) * r_n), 9), k)
    return top(found.select(F.col("l").alias("query"), F.col("r").alias("id"), F.round(score, 9).alias("score")), k)


def bm25(queries: DataFrame, passages: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score, rank by BM25 over [a-z0-9]+ tokens."""
    tokens = X.found(F.lower("text"), "[a-z0-9]+")
    sized = passages.select("id", tokens.alias("tokens")).withColumn("length", F.size("tokens"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    mean = stats["mean"] or 1.0
    index = matching.asked(queries, X.index_tokens)
    wanted = broadcast_if_small(queries.select(F.explode(X.index_tokens("text")).alias("token")).distinct())
    df = sized.select(F.explode(F.array_distinct("tokens")).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))  # one row for each token of the queries
    if index is not None:
        weight = {r["token"]: r["w"] for r in df.select("token", idf.alias("w")).collect()}
        return top(matching.weighted(sized.select("id", "tokens"), index, weight, k1, b, mean, k, queries.schema["id"].dataType), k)
    asked = queries.select(F.col("id").alias("query"), F.explode(X.index_tokens("text")).alias("token"))
    postings = sized.select("id", "length", F.explode("tokens").alias("token")).groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    scored = postings.join(df, "token").withColumn("weight", weight).join(asked, "token").groupBy("query", "id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top(scored, k)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query, id, score (cosine), rank among all other vectors. vectors, queries: (id, v); queries go in blocks of bounded size,
    each broadcast once, and every batch of vectors returns its own k best for each query, of equals the least ids. A task holds at most
    matching.CELLS scores at a time."""
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    schema = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    parts = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        q = np.array([r["v"] for r in rows], float)
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), unit(q)))

        def run(batches, shared=shared):
            import pandas as pd

            ids, q = shared.value
            rows = max(1, matching.CELLS // max(1, len(ids)))
            for batch in (whole.iloc[at : at + rows] for whole in batches for at in range(0, len(whole) if len(ids) else 0, rows)):
                batch = batch.sort_values("id")
                own = batch["id"].to_numpy()
                s = q @ unit(np.stack(batch["v"].to_numpy()).astype(float)).T
                s[ids[:, None] == own[None, :]] = -2.0
                s = np.round(s, 12)  # a product's last bits depend on the place in the batch
                most = min(k, len(own))
                least = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
                more, equal = s > least, s == least
                equal &= np.cumsum(equal, 1, dtype=np.int32) <= most - more.sum(1, keepdims=True)
                at, of = np.nonzero((more | equal) & (s > -1.5))
                yield pd.DataFrame({"query": ids[at], "id": own[of], "score": s[at, of]})

        parts.append(vectors.select("id", F.col("v")).mapInPandas(run, schema))
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.unionByName(p)
    return top(found, k)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query, id, score, rank: the sum of 1 / (k + rank) over rankings of (query, id, rank)."""
    together = rankings[0].select("query", "id", "rank")
    for r in rankings[1:]:
        together = together.unionByName(r.select("query", "id", "rank"))
    scored = together.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))


def hybrid(queries: DataFrame, passages: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """query, id, score, rank: the k best passages by words and the k nearest by vectors, fused by their ranks; with `keep` (id), both legs see only the
    passages in it, such as those that a cutoff admits. A query without a vector has the words alone."""
    if keep is not None:
        passages, vectors = passages.join(keep, "id", "left_semi"), vectors.join(keep, "id", "left_semi")
    return fuse([bm25(queries, passages, k), cosine_search(vectors, query_vectors, k)])


def in_order_of_plan(rankings: list[DataFrame]) -> DataFrame:
    """query, id, place: the rankings one after another, each id where it comes first."""
    together = None
    for i, r in enumerate(rankings):
        part = r.select("query", "id", F.struct(F.lit(i).alias("list"), "rank").alias("at"))
        together = part if together is None else together.unionByName(part)
    first = together.groupBy("query", "id").agg(F.min("at").alias("at"))
    return first.select("query", "id", F.row_number().over(W.partitionBy("query").orderBy("at")).alias("place"))


def admissible(mode: Column, cutoff: Column, from_when: Column) -> Column:
    """Whether a document counts: always when live or without a cutoff, else if it is known to have been there by then."""
    return (mode == "live") | cutoff.isNull() | F.coalesce(from_when <= cutoff, F.lit(False))
