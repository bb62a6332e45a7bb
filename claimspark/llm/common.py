"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, TEXT = "__id", "__text"


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that no other column can clash with."""
    return docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with its columns named by their place, so that no name an operator uses inside or adds can clash with one of them;
    `restored` gives the names back."""
    return docs.toDF(*[f"__in{i}" for i in range(len(docs.columns))])


def as_text(docs: DataFrame, column: str) -> DataFrame:
    """docs whose column is a string; one that is already stays as it is."""
    return docs if docs.schema[column].dataType == T.StringType() else docs.withColumn(column, F.col(column).cast("string"))


def place(docs: DataFrame, column: str) -> str:
    """The name that plain_names(docs) gives a column."""
    return f"__in{[c.lower() for c in docs.columns].index(column.lower())}"


def restored(made: DataFrame, docs: DataFrame, *new: str) -> DataFrame:
    """The columns of docs under their names, then the `new` ones of made; a column of docs that has a new name is replaced."""
    old = [(f"__in{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in {n.lower() for n in new}]
    return made.select(*[F.col(i).alias(c) for i, c in old], *new)


class ByteHashes(dict):
    """64-bit hashes of words; few enough are remembered at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


HASHES = ByteHashes()
#: Functions that clear what an operator remembers in a worker from task to task.
REMEMBERED: list[Callable[[], None]] = []


def forget_others(own: Callable[[], None] | None) -> None:
    """A worker that is used again holds nothing of an earlier operator. A function of the module, so that it acts on the worker's own."""
    HASHES.clear()
    for forget in REMEMBERED:
        if forget != own:
            forget()


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, dict], list[list]]], schema: T.StructType, text_col: str = TEXT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One output row for each input row, by Arrow batches of few rows (see small_batches).

    `make` is called once in each task and returns a function from a list of texts (None for
    null) to the new columns; what other operators remember in the worker goes first, all
    but what the function's attribute `forget` would clear. The `keep` columns of df are passed through unchanged. `schema` has the
    kept columns first, then the new ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.select(*keep) if text_col in keep else df.select(*keep, text_col)  # a kept text goes through once
    out = to_arrow_schema(schema)
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        forget_others(getattr(fn, "forget", None))
        for batch in batches:
            for part in slices(batch, text_col):
                cols = fn(part.column(part.schema.get_field_index(text_col)).to_pylist())
                kept = [part.column(part.schema.get_field_index(k)) for k in keep]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(kept, out)]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, list(out)[len(keep) :])]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Lowers the rows of the session's Arrow batches to BATCH_ROWS, so that neither side of a Python task holds more than a few MB of texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, text_col: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few rows and about `size` bytes of text each (one row at least), so that a worker holds little
    decoded text at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if sizes:
        yield batch.slice(start)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves `remainder`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A key of more rows than this, and of more than one in so many of all rows, counts as hot.
HOT_ROWS, HOT_SHARE = 10_000, 10_000


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """rows joined with totals, which has one row for each of the keys (nulls are equal), of `size` of the n rows.

    Hot keys are at most HOT_SHARE, whatever n is, so their totals are broadcast and their rows stay where they are; the
    others meet by a shuffle, in which no key has more rows than HOT_ROWS or n / HOT_SHARE.
    """
    most = max(HOT_ROWS, n // HOT_SHARE)
    there = totals.toDF(*[f"__t_{c}" for c in totals.columns])
    same = lambda other: [F.col(k).eqNullSafe(other[f"__t_{k}"]) for k in keys]
    hot, cold = there.where(F.col(f"__t_{size}") > most), there.where(F.col(f"__t_{size}") <= most)
    new = [F.col(f"__t_{c}").alias(c) for c in totals.columns if c not in keys]
    if hot.isEmpty():
        return rows.join(cold, same(cold)).select(*rows.columns, *new)
    warm = rows.join(F.broadcast(hot), same(hot)).select(*rows.columns, *new)
    rest = rows.join(F.broadcast(hot.select(*[f"__t_{k}" for k in keys])), same(hot), "left_anti")
    return warm.unionByName(rest.join(cold, same(cold)).select(*rows.columns, *new))
