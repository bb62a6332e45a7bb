"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a key of (60 bits of the text's md5, id), so equal texts lie together and a
shard's border falls inside a group of copies only where the sizes call for it. The order is
never made by one global sort:

1. a sample of keys is drawn with a chance in proportion to a record's size (plus the mean
   size, so that many small records weigh too), decided by a hash of the key, so that a task that
   runs again draws the same sample;
2. quantiles of the sample split the key space into fine ranges of about equal weight;
3. ranges that hold over twice their share are subdivided at quantiles of a denser sample of their own keys;
4. within each range a window gives running sizes and row numbers; the ranges' totals, one row for each range, give
   the offsets. A record whose predecessors hold the share p of all bytes goes to shard floor(p * shards).

Shard sizes differ from the mean by at most the size of one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.llm.common import ID, TEXT, narrow
from claimspark.session import materialize, table

#: Rows aimed at in a range, and the least and most ranges that are made at first.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 1024, 16_384
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 24
#: Rounds of subdividing overfull ranges.
ROUNDS = 2
#: Key bits that find a splitter list; ranges are then found in it by bisection.
SLICE_BITS, KEY_BITS = 8, 60


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32, and the key (k, tie) of every record."""
    df = narrow(docs, id_col, text_col)
    whole = df.schema[ID].dataType.typeName() in ("byte", "short", "integer", "long")
    tie = F.coalesce(F.col(ID).cast("long"), F.lit(-(1 << 63))) if whole else F.xxhash64(ID)
    return df.select(
        ID,
        (F.coalesce(F.octet_length(TEXT), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(TEXT, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(F.coalesce(TEXT, F.lit("")), "UTF-8")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("k"),
        tie.alias("tie"),
    )


def drawn(rate: Column) -> Column:
    """True with the chance `rate`, by a hash of the key."""
    return (F.pmod(F.xxhash64("k", "tie", F.lit("sample")), F.lit(1 << 52)) / F.lit(float(1 << 52))) < rate


def splitters(sample: DataFrame, group: list[str], pieces: Column) -> DataFrame:
    """Keys at the quantiles of each group's sample: pieces - 1 of them."""
    w = W.partitionBy(*group).orderBy("k", "tie")
    at = F.floor((F.row_number().over(w) - 1) * pieces / F.count(F.lit(1)).over(W.partitionBy(*group)))
    return sample.withColumn("piece", at).where("piece > 0").groupBy(*group, "piece").agg(F.min(F.struct("k", "tie")).alias("s")).select("s")


def with_range(records: DataFrame, splits: DataFrame) -> DataFrame:
    """Each record with `range`, the number of splitters up to its key.

    The splitters lie in one list for each slice of the key space (its first bits), joined by
    the slice; the list is searched by bisection, so that a slice full of splitters costs no more comparisons.
    """
    shift = KEY_BITS - SLICE_BITS
    lists = splits.groupBy(F.shiftright(F.col("s.k"), shift).alias("slice")).agg(F.sort_array(F.collect_list("s")).alias("list"))
    slices = splits.sparkSession.range(1 << SLICE_BITS).select(F.col("id").alias("slice"))
    lists = slices.join(lists, "slice", "left")
    before = F.coalesce(F.sum(F.coalesce(F.size("list"), F.lit(0))).over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # At most MOST_RANGES keys twice over, a few hundred kB whatever the input.
    lists = lists.select("slice", F.coalesce("list", F.expr("array()").cast(lists.schema["list"].dataType)).alias("list"), before.alias("before"))
    key = F.struct("k", "tie")
    steps = F.sequence(F.lit(16), F.lit(0), F.lit(-1))

    def halve(found: Column, bit: Column) -> Column:
        further = found + F.pow(F.lit(2), bit).cast("int")
        return F.when((further <= F.size("list")) & (F.get("list", further - 1) <= key), further).otherwise(found)

    joined = records.withColumn("slice", F.shiftright("k", shift)).join(F.broadcast(lists), "slice")
    return joined.withColumn("range", (F.col("before") + F.when(F.size("list") == 0, 0).otherwise(F.aggregate(steps, F.lit(0), halve))).cast("int")).drop("slice", "list", "before")


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every record into one of `shards` shards of near equal sizes.

    Returns id_col, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32 (null
    for a null text), law ("bytes"), shard, slot (gapless from 0 in each shard, in key order)
    and grown_shard (null: the law is not `key`). One row for each input row: rows that repeat
    an id and text get slots of their own, null ids come first among equal texts, an empty table gives no
    row. Other columns are ignored.
    """
    spark = docs.sparkSession
    records = materialize(keyed(docs, id_col, text_col), "sharding-keys")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, size = total["n"], max(1, total["bytes"])
    mean = size / max(1, n)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n // ROWS_PER_RANGE)))
    weight = (F.col("size") / F.lit(mean) + 1) / 2  # 1 on average

    rate = ranges * SAMPLES_PER_RANGE / max(1, n)
    sample = records.where(drawn(weight * F.lit(rate)))
    splits = materialize(splitters(sample.withColumn("one", F.lit(0)), ["one"], F.lit(ranges)), "sharding-splitters")
    for _ in range(ROUNDS):
        placed = with_range(records, splits)
        full = placed.groupBy("range").agg(F.sum(weight).alias("w")).where(F.col("w") > 2.0 * max(1.0, n / ranges))
        if full.isEmpty():
            break
        full = full.withColumn("pieces", F.ceil(F.col("w") * ranges / F.lit(float(n))) + 1)
        denser = placed.join(F.broadcast(full), "range").where(drawn(weight * F.lit(4 * rate)))
        more = splitters(denser, ["range", "pieces"], F.col("pieces"))
        splits = materialize(splits.unionByName(more).distinct(), "sharding-splitters")

    placed = with_range(records, splits)
    totals = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("rows", "bytes")])
    inside = W.partitionBy("range").orderBy("k", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = placed.withColumns({"row": F.row_number().over(W.partitionBy("range").orderBy("k", "tie")), "upto": F.sum("size").over(inside)})
    running = running.join(F.broadcast(totals), "range").select(
        ID, "size", "text_crc32",
        (F.col("rows_before") + F.col("row") - 1).alias("place"),
        F.expr(f"cast(((bytes_before + upto - size) * {shards}L) div {size}L as int)").alias("shard"),
    )
    first = running.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return running.join(F.broadcast(first), "shard").select(
        F.col(ID).alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: The same law by one global order. DuckDB has no crc32, so it is computed byte by byte.
OP1_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
), texts AS (
  SELECT DISTINCT text, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL
), crcs AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM texts, crc_table
), keyed AS (
  SELECT doc_id, text, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size,
         ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS k
  FROM documents
), running AS (
  SELECT doc_id, text, size, row_number() OVER w AS place,
         (((sum(size) OVER w - size) * 16) // sum(size) OVER ())::INT AS shard
  FROM keyed WINDOW w AS (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM running LEFT JOIN crcs USING (text)
"""
