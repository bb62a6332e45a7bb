"""Vector codes: product quantisation with codebooks that are searched by Orchard's method.

A vector's components become whole numbers, and the vector is cut into PARTS parts. Each part has a codebook of up to ENTRIES
entries, which begins as the parts of the vectors of the smallest ids. A round assigns every part to its nearest entry and moves every
entry to the mean of its parts. All of it is exact in whole numbers, so a run on any number of tasks gives the same codes.

The search for the nearest entry keeps a list of the other entries by their distance for each entry. A part begins at entry 0 and goes
through the list of the best entry so far, past entries it has visited; at a better one it goes on with that entry's list, and it ends where the
list's distance is over twice the part's own: what comes then is farther away, by the triangle inequality. All parts of a slice of rows take
their steps together.

Rounds pass over a table of whole numbers. A task sums its parts for each entry, so what is shuffled and read by the driver is one row for each component of the
codebooks and task, whatever the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import with_totals
from claimspark.session import materialize, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Whole numbers to a unit.
SCALE = 4096
#: Bits of a sum of squares, and components of a slice that is searched at once.
SQUARE_BITS, SLICE = 60, 1 << 20
VECTOR, VEC_ID, LABEL = "__vector", "__vec_id", "__label"


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(VEC_ID, LABEL, VECTOR) of the vectors that are all finite numbers, as whole numbers in a table, and their length, a multiple
    of PARTS."""
    read = vectors.select(F.col(id_col).alias(VEC_ID), F.col(label_col).alias(LABEL), F.col(vector_col).cast("array<double>").alias("v"))
    kept = read.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dim = -(-length // PARTS) * PARTS
    most = 1 << most_bits(dim)
    number = lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(most))), F.lit(float(most)))).cast("int")
    filled = F.concat(F.transform("v", number), F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    return materialize(kept.select(VEC_ID, LABEL, filled.alias(VECTOR)), "vectors"), dim


def most_bits(dim: int) -> int:
    """Bits of the largest whole number of which four squared distances fit in a long."""
    return (SQUARE_BITS - max(1, dim // PARTS).bit_length()) // 2 - 1


def first_books(numbers: DataFrame, dim: int) -> np.ndarray:
    """(PARTS, entries, dim / PARTS): the parts of the vectors of the smallest ids; fewer vectors make fewer entries."""
    rows = numbers.orderBy(F.col(VEC_ID).asc_nulls_last(), VECTOR).limit(ENTRIES).select(VECTOR).collect()
    return np.array([r[0] for r in rows], np.int64).reshape(len(rows), PARTS, dim // PARTS).swapaxes(0, 1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Search:
    """Orchard's search in the codebooks of all parts."""

    def __init__(self, books: np.ndarray):
        self.books, self.n = books, books.shape[1]
        apart = squared(books[:, :, None, :], books[:, None, :, :])
        apart[:, np.arange(self.n), np.arange(self.n)] = -1  # an entry comes first in its own list
        self.lists = np.argsort(apart, axis=2, kind="stable")[:, :, 1:].astype(np.int32)  # ties by index
        self.gaps = np.take_along_axis(apart, self.lists.astype(np.int64), 2)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, PARTS): the nearest entry of each part of (rows, dim), ties to the lower index, and the squared distance."""
        parts = vectors.reshape(len(vectors) * PARTS, self.books.shape[2])
        at = np.tile(np.arange(PARTS), len(vectors))
        best, near = np.zeros(len(parts), np.int32), squared(parts, self.books[at, 0])
        seen, place = np.ones(len(parts), np.int64), np.zeros(len(parts), np.int32)  # entry 0 is visited
        left = np.arange(len(parts)) if self.n > 1 else np.zeros(0, np.int64)
        while len(left):
            p, b, i = at[left], best[left], place[left]
            going = self.gaps[p, b, i] <= 4 * near[left]  # squares of twice the distance
            left, p, b, i = left[going], p[going], b[going], i[going]
            entry = self.lists[p, b, i]
            place[left] = i + 1
            fresh = (seen[left] >> entry) & 1 == 0
            new, to = left[fresh], entry[fresh]
            seen[new] |= np.int64(1) << to.astype(np.int64)
            d = squared(parts[new], self.books[at[new], to])
            better = (d < near[new]) | ((d == near[new]) & (to < best[new]))
            new, to = new[better], to[better]
            best[new], near[new], place[new] = to, d[better], 0
            left = left[place[left] < self.n - 1]
        return best.reshape(-1, PARTS), near.reshape(-1, PARTS)


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, with their vectors (rows, dim)."""
    rows = max(1, SLICE // max(1, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            column = part.column(part.schema.get_field_index(VECTOR))
            yield part, column.flatten().to_numpy().astype(np.int64).reshape(part.num_rows, dim)


def sums(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total): of the parts that each entry is nearest to, their number and the sum of their components."""
    entries, dim = books.shape[1], books.shape[0] * books.shape[2]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "entry", "place", "n", "total")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        n, total = np.zeros((PARTS, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, vectors in slices(batches, dim):
            codes, _ = search.nearest(vectors)
            for p, parts in enumerate(np.split(vectors, PARTS, 1)):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], parts)
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        some = n[part, entry] > 0
        columns = [part, entry, place, n[part, entry], total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[some], pa.int64()) for c in columns], names=schema.names)

    made = numbers.select(VECTOR).mapInArrow(run, schema)
    return made.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def trained(numbers: DataFrame, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after the rounds; an entry that is nearest to no part stays."""
    books = first_books(numbers, dim)
    for _ in range(rounds if books.size else 0):
        moved = books.copy()
        for r in sums(numbers, books).collect():  # a row for each component of the codebooks at most
            moved[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        books = moved
    return books


def encoded(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(VEC_ID, LABEL, code, error): two hex digits of the nearest entry for each part, and the squared distances summed."""
    dim = books.shape[0] * books.shape[2]
    kept = [f for f in numbers.schema if f.name != VECTOR]
    schema = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        for part, vectors in slices(batches, dim):
            codes, near = search.nearest(vectors)
            columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            hexes = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hexes, pa.string()), pa.array(near.sum(1), pa.int64())], names=schema.names)

    return numbers.mapInArrow(run, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for: its entries one after another, in units."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(PARTS)]) / SCALE


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id_col, label, code, error, label_error) of the vectors, and the codebooks.

    Vectors that are null or hold null or no finite number are left out. The longest vector gives the length, made up to a multiple of PARTS; shorter ones
    are filled with zeros, an empty one wholly. Components beyond 2 ** most_bits / SCALE (32 768 for parts of 8) count as that. Rows that repeat
    an id are vectors of their own; null ids come last, and equal ids go by their components. label_error is the error of all rows of
    the label; null labels are one label. An empty table gives no row and empty codebooks. Other columns are ignored.
    """
    numbers, dim = whole(vectors, id_col, vector_col, label_col)
    books = trained(numbers, dim, rounds)
    if not books.shape[1]:
        return numbers.select(F.col(VEC_ID).alias(id_col), F.col(LABEL).alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    codes = materialize(encoded(numbers, books), "vector-codes")
    by_label = materialize(codes.groupBy(LABEL).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    out = with_totals(codes, by_label, [LABEL], "n", codes.count())
    return out.select(F.col(VEC_ID).alias(id_col), F.col(LABEL).alias("label"), "code", "error", "label_error"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_in_sql() -> str:
    """One assignment and one move for each round; the given vectors have one length, so parts are LEN / 8 long."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
assigned_{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS d
    FROM parts p JOIN book_{r} b USING (part)
  ) GROUP BY ALL
)""")
        if r < ROUNDS:
            out.append(f"""
mean_{r} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, entry, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT a.part, a.entry, unnest(range(len(p.v))) AS place, unnest(p.v) AS x FROM assigned_{r} a JOIN parts p USING (vec_id, part)) GROUP BY ALL
  ) GROUP BY ALL
), book_{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book_{r} b LEFT JOIN mean_{r} m USING (part, entry)
)""")
    return ",".join(out)


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * w + 1 : (part + 1) * w] AS v FROM kept, range(8) t(part)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16
), book_0 AS (
  SELECT part, entry, v FROM firsts JOIN parts USING (vec_id)
), {_rounds_in_sql()}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned_{ROUNDS} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
