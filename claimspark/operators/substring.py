"""Texts that hold other texts: a join by rare pieces, and the longest run of characters that two texts share.

Documents of usual sizes are each searched in one task. In larger ones a claim can only be in a span that has all of its pieces of Q characters, so it's looked for where its rarest piece is: spans hand on only pieces that some claim has,
and a claim meets the few spans of its document that have the piece which is in fewest of them. Nothing is paired by document alone. Lengths of texts cost
no more than in proportion.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import materialize

#: Characters of a piece; a shorter text is one piece.
Q = 8
#: Up to so many of the claims' pieces (8 bytes each) are handed to every task; more are joined by a shuffle.
HANDED = 2_000_000
#: A document of up to so many characters in its spans and claims is read by one task, if claims times characters of spans is no more than SEARCHED.
TOGETHER, SEARCHED = 4_000_000, 1e10
#: Stands between spans: no text that is valid UTF-8 has it.
BETWEEN = "\ud800"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def pieces(text: str, q: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of q characters, ascending."""
    c = code_points(text)
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, np.uint64(q))
    for k in range(q):
        h = (h ^ (c[k : k + n] * MIX[k])) * MIX[(k + 3) % Q]
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def with_pieces(rows: DataFrame, keep: list[str], sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """(keep…, piece): the distinct pieces of each row's text, of the given sizes, or of the row's own (`q`) where there are none; only known ones, if they are given."""
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("piece", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [[q] for q in part["q"].to_pylist()] if not sizes else [sizes] * part.num_rows
                found = [np.concatenate([pieces(t or "", q) for q in qs]) for t, qs in zip(part["text"].to_pylist(), own)]
                if shared is not None:
                    there = shared.value
                    found = [f[there[np.minimum(np.searchsorted(there, f), len(there) - 1)] == f] if len(there) else f[:0] for f in found]
                rows_ = np.repeat(np.arange(len(found)), [len(f) for f in found])
                kept = [part[k].take(pa.array(rows_)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(found) if found else [], pa.int64())], names=schema.names)

    return rows.select(*keep, "text", *([] if sizes else ["q"])).mapInArrow(run, schema)


def by_rare_pieces(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """claim, pos as in first_holder, by the pieces: for documents of any size."""
    asked = claims.where("text <> '' and doc is not null").select("doc", F.md5("text").alias("said"), "text", F.least(F.char_length("text"), F.lit(Q)).alias("q"))
    asked = materialize(asked.distinct(), "substring-asked")
    own = materialize(with_pieces(asked, ["doc", "said"], [], None), "substring-pieces")
    sizes = sorted(r["q"] for r in asked.select("q").distinct().collect())  # Q at most
    every = own.select("piece").distinct()
    known = None
    if every.count() <= HANDED:
        known = np.sort(np.array([r[0] for r in every.collect()], np.int64))
    hits = with_pieces(spans.where("text <> ''").select("doc", "pos", "text"), ["doc", "pos"], sizes or [Q], known)
    hits = materialize(hits if known is not None else hits.join(every, "piece", "left_semi"), "substring-hits")
    counted = hits.groupBy("doc", "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counted, ["doc", "piece"], "left").groupBy("doc", "said").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("n", "piece"))).alias("r"), F.bool_or(F.col("n").isNull()).alias("lacks"))
    anchors = rarest.where("not lacks").select("doc", "said", F.col("r.piece").alias("piece"))
    pairs = anchors.join(hits, ["doc", "piece"]).select("doc", "said", "pos")
    texts = asked.select("doc", "said", F.col("text").alias("wanted"))
    held = pairs.join(spans.select("doc", "pos", "text"), ["doc", "pos"]).join(texts, ["doc", "said"]).where(F.col("text").contains(F.col("wanted")))
    found = held.groupBy("doc", "wanted").agg(F.min("pos").alias("pos")).select(F.col("doc").alias("__doc"), F.col("wanted").alias("__wanted"), "pos")
    return claims.select("claim", "doc", "text").join(found, (F.col("doc") == F.col("__doc")) & (F.col("text") == F.col("__wanted")), "left").select("claim", "pos")


def by_document(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """claim, pos as in first_holder: each document's spans and claims are read by one task, spans first, so a text is shuffled once and no piece of it is.

    A task looks for a claim in the document's spans as one text, in which a lone surrogate, which no text has, stands between spans.
    """
    side = lambda df, claim, pos, kind: df.select("doc", F.lit(kind).alias("kind"), pos.alias("pos"), claim.alias("claim"), "text")
    held = side(spans.where("text <> '' and pos is not null"), F.lit(None).cast(claims.schema["claim"].dataType), F.col("pos"), 0)
    rows = held.unionByName(side(claims, F.col("claim"), F.lit(None).cast(spans.schema["pos"].dataType), 1))
    schema = T.StructType([T.StructField("claim", claims.schema["claim"].dataType), T.StructField("pos", spans.schema["pos"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, texts, places, found = None, [], [], {}
        whole, starts = None, []
        for batch in batches:
            asked, where = [], []
            for i, (d, kind, pos, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc", "kind", "pos", "text")))):
                if d != doc:
                    doc, texts, places, found, whole = d, [], [], {}, None
                if kind == 0:
                    texts.append(text)
                    places.append(pos)
                    continue
                if whole is None:
                    whole = BETWEEN.join(texts)
                    starts = list(accumulate((len(t) + 1 for t in texts), initial=0))
                if text and text not in found:
                    at = whole.find(text)
                    found[text] = places[bisect_right(starts, at) - 1] if at >= 0 else None
                asked.append(i)
                where.append(found[text] if text else None)
            if asked:
                yield pa.RecordBatch.from_arrays([batch["claim"].take(pa.array(asked)), pa.array(where, batch["pos"].type)], names=schema.names)

    return rows.repartition("doc").sortWithinPartitions("doc", "kind", "pos").mapInArrow(run, schema)


def first_holder(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """claim, pos of claims (claim, doc, text): the first span (doc, pos, text) of its document that holds the claim's text as it is; null if none does.

    An empty or null text is held by none, and so is a claim of a null document. Claims of equal text in a document are looked for once. Documents of up to
    TOGETHER characters and SEARCHED characters to search are each read by one task, all others are joined by rare pieces.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    some = claims.where("doc is not null").select("doc", n.alias("n"), F.lit(1).alias("asked")).unionByName(spans.where("doc is not null").select("doc", n.alias("n"), F.lit(0).alias("asked")))
    chars, asked, searched = F.sum("n"), F.sum("asked"), F.sum(F.when(F.col("asked") == 0, F.col("n")).otherwise(0)).cast("double")
    large = materialize(some.groupBy("doc").agg(chars.alias("chars"), (searched * asked).alias("searched")).where((F.col("chars") > TOGETHER) | (F.col("searched") > SEARCHED)).select("doc"), "substring-large")
    none = claims.where("doc is null").select("claim", F.lit(None).cast(spans.schema["pos"].dataType).alias("pos"))
    claims, spans = claims.where("doc is not null"), spans.where("doc is not null")
    if large.isEmpty():
        return by_document(claims, spans).unionByName(none)
    large = broadcast_if_small(large)
    part = lambda df, how: df.join(large, "doc", how)
    return by_document(part(claims, "left_anti"), part(spans, "left_anti")).unionByName(by_rare_pieces(part(claims, "left_semi"), part(spans, "left_semi"))).unionByName(none)


#: Two primes below 2 ** 31 and a base for each: a run's hash is the pair.
PRIMES, BASES = (2_147_483_629, 2_147_483_587), (1_103_515_245, 1_597_334_677)


class Runs:
    """Hashes of all runs of a text of one length after another, from sums of its characters times powers of a base."""

    def __init__(self, text: np.ndarray, longest: int):
        self.n, self.sums, self.rest = len(text), [], []
        for p, base in zip(PRIMES, BASES):
            power = np.ones(longest + 1, np.uint64)
            done = 1
            while done <= longest:  # powers by doubling
                more = min(done, longest + 1 - done)
                power[done : done + more] = power[:more] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += more
            total = np.cumsum((text + np.uint64(1)) % np.uint64(p) * power[: self.n] % np.uint64(p), dtype=np.uint64) % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), total]))
            self.rest.append(power[longest - np.arange(self.n + 1)])  # brings runs of all places to one power

    def of(self, k: int) -> np.ndarray:
        out = np.zeros(self.n - k + 1, np.uint64)
        for p, sums, rest in zip(PRIMES, self.sums, self.rest):
            h = (sums[k:] + np.uint64(p) - sums[: len(sums) - k]) % np.uint64(p) * rest[: len(out)] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out


def longest_run(a: str, b: str) -> int:
    """The length of the longest run of characters in both: the greatest length of which both have a run of one hash, by bisection."""
    x, y = code_points(a), code_points(b)
    low, high = 0, min(len(x), len(y))
    if not high:
        return 0
    longest = max(len(x), len(y))
    one, two = Runs(x, longest), Runs(y, longest)
    while low < high:
        k = (low + high + 1) // 2
        if len(np.intersect1d(one.of(k), two.of(k))):
            low = k
        else:
            high = k - 1
    return low
