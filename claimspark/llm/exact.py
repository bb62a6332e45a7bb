"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when they are identical without ASCII white space. No text is shuffled before it is a suspect:

1. A table of the documents, bucketed by part (up to CHUNK rows that one task has read), holds each text without white space and its SHA-256.
2. Each part sorts the distinct fingerprints of its texts (the digest's first bits, few more than count the rows) and sends each
   owner of a range of fingerprints those in its range, as Golomb-coded gaps with a power of two as divisor.
3. An owner answers a part with a bitmap: which of its fingerprints another part has sent too.
4. A part marks the rows of those fingerprints and of those that it has itself more than once. The table is bucketed by part, so only
   messages and bitmaps are shuffled.
5. Marked rows, the suspects, are grouped by digest and bytes, with partial aggregation, so that a large group of copies is one row of each task.
   All other rows are alone.

A message holds a fingerprint once, however many rows of the part have it.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, narrow, struct_of, with_totals
from claimspark.session import materialize, scratch_root, table

#: ASCII white space, which does not count.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a part, as a power of two, and fingerprints that an owner is to have.
CHUNK_BITS, OWNED = 17, 1 << 21
#: Bits of a fingerprint beyond those that count the rows; one in 2 ** EXTRA unequal texts is a suspect by chance.
EXTRA, KEY_BITS = 12, 60


def coded(gaps: np.ndarray) -> tuple[int, bytes]:
    """The divisor's power of two and the code of whole numbers: all quotients in unary, then all remainders."""
    k = int(max(0, np.floor(np.log2(max(1.0, float(gaps.mean()) * np.log(2)))))) if len(gaps) else 0
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(gaps) else 0, np.uint8)
    unary[ends] = 1
    remainders = (gaps[:, None] >> np.arange(k)[None, :]) & 1
    return k, np.packbits(np.concatenate([unary, remainders.astype(np.uint8).ravel()])).tobytes()


def decoded(code: bytes, k: int, n: int) -> np.ndarray:
    """The n whole numbers of a code."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n] if n else np.zeros(0, np.int64)
    at = int(ends[-1]) + 1 if n else 0
    remainders = bits[at : at + n * k].reshape(n, k).astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return ((np.diff(ends, prepend=-1) - 1).astype(np.int64) << k) + remainders


class Owners:
    """Which fingerprints of `width` bits belong to which of `n` owners."""

    def __init__(self, rows: int):
        self.width = min(KEY_BITS, max(1, rows).bit_length() + EXTRA)
        self.n = -(-rows // OWNED) or 1

    def fingerprints(self, keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.int64) >> (KEY_BITS - self.width)

    def parts(self, sorted_: np.ndarray) -> np.ndarray:
        """Where each owner's fingerprints begin in a sorted list, and the end."""
        return np.searchsorted(sorted_, [self.first(i) for i in range(self.n + 1)])

    def first(self, owner: int) -> int:
        return -(-(owner << self.width) // self.n)


def messages(rows: DataFrame, owners: Owners) -> DataFrame:
    """(part, owner, n, k, code) of (part, key)."""

    def send(part):
        import pandas as pd

        found = np.unique(owners.fingerprints(part["key"].to_numpy()))
        at, out = owners.parts(found), []
        for i in range(owners.n):
            if (own := found[at[i] : at[i + 1]]).size:
                out.append((part["part"].iloc[0], i, len(own), *coded(np.diff(own, prepend=owners.first(i)))))
        return pd.DataFrame(out, columns=["part", "owner", "n", "k", "code"])

    schema = struct_of(part=T.LongType(), owner=T.IntegerType(), n=T.IntegerType(), k=T.IntegerType(), code=T.BinaryType())
    return rows.groupBy("part").applyInPandas(send, schema)


def replies(sent: DataFrame) -> DataFrame:
    """(part, owner, bits): which of the part's fingerprints at the owner are another part's too; no row where none is."""

    def answer(got):
        import pandas as pd

        lists = [np.cumsum(decoded(c, k, n)) for c, k, n in zip(got["code"], got["k"], got["n"])]  # from the range's start
        everything = np.sort(np.concatenate(lists))
        twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
        marks = [np.isin(x, twice, assume_unique=True) for x in lists]
        out = [(p, o, np.packbits(m).tobytes()) for p, o, m in zip(got["part"], got["owner"], marks) if m.any()]
        return pd.DataFrame(out, columns=["part", "owner", "bits"])

    return sent.groupBy("owner").applyInPandas(answer, struct_of(part=T.LongType(), owner=T.IntegerType(), bits=T.BinaryType()))


def marked(rows: DataFrame, answers: DataFrame, owners: Owners) -> DataFrame:
    """(part, words): the suspects among a part's rows (part, place, key), as bits by place; no row for a part without."""

    def mark(part, got):
        import pandas as pd

        if not len(part):
            return pd.DataFrame([], columns=["part", "words"])
        found, which, n = np.unique(owners.fingerprints(part["key"].to_numpy()), return_inverse=True, return_counts=True)
        suspect, at = n > 1, owners.parts(found)
        for owner, bits in zip(got["owner"], got["bits"]):
            lo, hi = at[owner], at[owner + 1]
            suspect[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        places = np.zeros(1 << CHUNK_BITS, np.uint8)
        places[part["place"].to_numpy()[suspect[which]]] = 1
        words = np.packbits(places, bitorder="little").view("<i8")
        return pd.DataFrame([(part["part"].iloc[0], words)] if words.any() else [], columns=["part", "words"])

    schema = struct_of(part=T.LongType(), words=T.ArrayType(T.LongType()))
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(mark, schema)


def stored(docs: DataFrame, rows: int) -> str:
    """The name of a table, bucketed by part, of (ID, n_chars, norm, sha, key, part, place) of (ID, TEXT)."""
    spark = docs.sparkSession
    at, low = F.col("at"), (1 << 33) - 1  # Spark numbers the rows of a task in the low 33 bits
    text = F.coalesce(F.col(TEXT), F.lit(""))
    read = docs.select(ID, F.length(text).cast("long").alias("n_chars"), F.translate(text, SPACE, "").alias("norm"), F.monotonically_increasing_id().alias("at"))
    read = read.withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256)).select(
        ID, "n_chars", "norm", "sha",
        F.conv(F.substring("sha", 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        F.shiftleft(F.shiftright(at, 33), 33 - CHUNK_BITS).bitwiseOR(F.shiftright(at.bitwiseAND(F.lit(low)), CHUNK_BITS)).alias("part"),
        at.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("place"),
    )
    name = f"exact_{uuid.uuid4().hex}"
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows >> (CHUNK_BITS + 2)))
    read.write.bucketBy(buckets, "part").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    return name


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal without ASCII white space.

    Returns id_col, keep_id, group_size, kept and text_sha256 (of the text without white space), one row for each input row. In a group the
    row of the most code points stays, of these the one of the smallest id (null ids last). Null and empty texts and those of white space
    alone are equal. Of rows that repeat both, one stays. An empty table gives no row; other columns are ignored.
    """
    spark, rows = docs.sparkSession, docs.count()
    name, owners = stored(narrow(docs, id_col, text_col), rows), Owners(rows)
    all_ = spark.table(name)
    light = all_.select("part", "place", "key")
    marks = materialize(marked(light, replies(messages(light, owners)), owners), "exact-marks").hint("shuffle_hash")
    bit = F.expr("getbit(element_at(words, cast(place div 64 as int) + 1), place % 64) = 1")
    both = all_.join(marks, "part", "left").withColumn("suspect", F.coalesce(bit, F.lit(False)))
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col(ID).isNull().alias("none"), ID, "part", "place"))
    groups = materialize(both.where("suspect").groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")), "exact-groups")
    unlike = not groups.groupBy("sha").count().where("count > 1").isEmpty()  # two texts of one digest
    key = ["sha", "norm"] if unlike else ["sha"]
    flagged = materialize(both.select(ID, *key, "part", "place", "suspect"), "exact-rows")
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder like other tables'

    alone = flagged.where("not suspect").select(F.col(ID).alias(id_col), F.col(ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = with_totals(flagged.where("suspect"), groups.select(*key, "group_size", "first"), key, "group_size", rows)
    stays = (F.col("part") == F.col("first.part")) & (F.col("place") == F.col("first.place"))
    return alone.unionByName(grouped.select(F.col(ID).alias(id_col), F.col(f"first.{ID}").alias("keep_id"), "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id stays, with their own columns; rows that repeat an id stay or go together."""
    gone = exact_duplicates(docs, id_col=id_col, text_col=text_col).groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), grouped AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM grouped
"""
