"""Document fingerprints: the bottom k of a text's word-shingle hashes.

A sketch is the K least distinct 32-bit hashes of the text's shingles of five lower-cased words (fewer
words: the whole sequence is the one shingle), written as base64 of little-endian numbers in order.
Sketches of parts merge into the sketch of the whole; two of them estimate resemblance, containment and, each for
itself, the number of distinct shingles. A sketch of fewer than K values is the whole set, and then all
estimates are exact up to hash collisions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, narrow, slices
from claimspark.session import table

K, SHINGLE = 256, 5
#: Fixed values of this sketch format: odd multipliers of a shingle's words and of the finishing mix.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Most words that a worker remembers the hash of.
MEMORY = 500_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode())
        return found


WORDS = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(33))


def sketch(text: str | None) -> np.ndarray:
    """The K least distinct shingle hashes, ascending."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        shingles = (h * FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
    else:
        shingles = h[: n - SHINGLE + 1] * FACTORS[0]
        for k in range(1, SHINGLE):
            shingles = shingles + h[k : n - SHINGLE + 1 + k] * FACTORS[k]
    return np.unique((mixed(shingles) >> np.uint64(32)).astype(np.uint32))[:K]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:K]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated |A and B| / |A or B|; 1 for two empty sets."""
    both = merge(a, b)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def distinct_count(a: np.ndarray) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < K else (K - 1) * 2.0**32 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated |A and B| / |A|; 1 for an empty A."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b) * distinct_count(merge(a, b)) / distinct_count(a))


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def by_pairs(measure, returns: T.DataType):
    """A column function of two fingerprint columns."""

    def run(a: Column, b: Column) -> Column:
        @F.pandas_udf(returns)
        def udf(x, y):
            import pandas as pd

            return pd.Series([measure(read(p), read(q)) for p, q in zip(x, y)])

        return udf(a, b)

    return run


resemblance_of = by_pairs(resemblance, T.DoubleType())
containment_of = by_pairs(containment, T.DoubleType())
merged_of = by_pairs(lambda a, b: written(merge(a, b)), T.StringType())

OUT = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def position(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most `value`, by bisection."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds)
    steps = F.sequence(F.lit(len(bounds).bit_length()), F.lit(0), F.lit(-1))

    def halve(found: Column, bit: Column) -> Column:
        further = found + F.pow(F.lit(2), bit).cast("int")
        return F.when((further <= len(bounds)) & (F.get(array, further - 1) <= value), further).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint every whole text and an edited text, whose last half is the beginning of the next document.

    The next document is the one that follows in ascending id_col (a whole number); rows that repeat an id follow each other by a hash
    of their text, null ids come first, and after the last document comes the first. Returns id_col and OUT, one row for
    each input row; null counts as the empty text, whose sketch is empty. Other columns are ignored.

    The texts are shuffled once: rows go to ranges of ids (quantiles of all ids), the first row of each range
    goes to the range before as well, and each task walks through its ranges in order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    df = narrow(docs, id_col, text_col)
    id_type = df.schema[ID].dataType
    place = F.coalesce(F.col(ID).cast("long"), F.lit(-(1 << 63)))
    quantiles = df.agg(F.percentile_approx(F.col(ID).cast("long"), [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    df = df.select(ID, TEXT, place.alias("place"), F.xxhash64(F.coalesce(TEXT, F.lit(""))).alias("tie")).withColumn("range", position(F.col("place"), sorted({*(quantiles or [])})))
    # One row for each range: its first row's key, and the range that comes before it.
    first = df.groupBy("range").agg(F.min(F.struct("place", "tie")).alias("key"))
    order = W.orderBy("range")
    last = F.max("range").over(W.partitionBy(F.lit(0)))
    first = first.select(F.col("key.place").alias("place"), F.col("key.tie").alias("tie"), F.coalesce(F.lag("range").over(order), last).alias("to"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("tail"))
    sent = df.join(F.broadcast(first), ["place", "tie"], "left")
    sent = sent.select(ID, TEXT, "place", "tie", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(1).alias("tail"))))).alias("w"))
    sent = sent.select("w.range", "w.tail", "place", "tie", ID, TEXT).repartition(tasks, "range").sortWithinPartitions("range", "tail", "place", "tie").select("range", "tail", ID, TEXT)
    schema = T.StructType([T.StructField(ID, id_type), *OUT.fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row before: range, id, text, sketch
        for batch in batches:
            for part in slices(batch, TEXT):
                rows = []
                for rng, tail, i, text in zip(*(c.to_pylist() for c in part.columns)):
                    text = text or ""
                    mine = sketch(text)
                    if waiting and waiting[0] == rng:
                        rows.append(finished(waiting, text, mine))
                    waiting = None if tail else (rng, i, text, mine)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(out), out)], schema=out)

    return sent.mapInArrow(run, schema).withColumnRenamed(ID, id_col)


def finished(row: tuple, after: str, after_sketch: np.ndarray) -> tuple:
    _, i, text, mine = row
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    theirs = sketch(edited)
    return i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(mine), written(theirs), resemblance(mine, theirs), resemblance(mine, after_sketch)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
