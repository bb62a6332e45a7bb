"""Benchmark decontamination with one FM-index for each training shard.

A shard is a run of documents in a task, of at most SHARD_WORDS words; a longer document is cut into parts that
overlap by a window less one word. The shard's text is all its words, as numbers of the shard's own vocabulary, each
part closed by a terminator. Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet
matrix; every distinct benchmark window whose words all occur in the shard is searched backward through wavelet
ranks, all windows at once, and the matching rows are located by stepping to sampled suffix positions. Word
spans of the occurrences are merged for each document.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, compared by 64-bit hashes. Windows: 13 consecutive words of an
item, or the whole item if it has fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import HASHES, ID, TEXT, map_rows, narrow, place, plain_names, restored, slices, small_batches, struct_of
from claimspark.session import table

WINDOW = 13
#: A document is contaminated if at least one word of 20 is hit.
SHARE = 20
#: UTF-8 bytes of benchmark text in a block, whose word hashes are broadcast; each block of the benchmark is one pass over the documents.
BLOCK_BYTES = 64 << 20
#: Most words in a shard.
SHARD_WORDS = 1 << 17
#: Every so many text positions a suffix position is kept.
SAMPLE = 8
#: Lower-cases A-Z and turns every byte that is in no word into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def hashed(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w))


class Windows:
    """The distinct windows of a block of benchmark rows (item, hashes of its words)."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], width: int = WINDOW):
        self.width = width
        self.items = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.items)}
        sizes = np.array([len(h) for _, h in rows], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *[h for _, h in rows]])
        begins, many = np.cumsum(sizes) - sizes, np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        start = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(many.sum())
        length = np.repeat(np.minimum(sizes, width), many)
        owner = np.repeat(np.array([number[i] for i, _ in rows], np.int64), many)
        # A window's key: its words' hashes, each multiplied by its place, and its length.
        key, mix = length.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for at in range(width):
            inside = at < length
            key = np.where(inside, (key ^ self.words[np.where(inside, start + at, 0)]) * mix, key) if len(self.words) else key
            key = key ^ (key >> np.uint64(29))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        owned = np.unique(same.reshape(-1) * max(1, len(self.items)) + owner)
        self.owner = owned % max(1, len(self.items))
        self.owner_at = np.searchsorted(owned // max(1, len(self.items)), np.arange(len(first) + 1))


class Wavelet:
    """A wavelet matrix: rank of a symbol before a row, for many at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        start = np.zeros_like(row)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k]
            one = ((symbol >> level) & 1).astype(bool)
            row = np.where(one, self.zeros[k] + ones[row], row - ones[row])
            start = np.where(one, self.zeros[k] + ones[start], start - ones[start])
        return row - start


class FMIndex:
    """Over runs of symbols from 1 to sigma - 1, each closed by the terminator 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        self.sa = suffix_order(text)
        self.bwt = text[self.sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.wavelet = Wavelet(self.bwt, sigma)
        # Rows whose suffix position is kept: every SAMPLE-th position, and each run's first.
        first = np.concatenate([[True], text[:-1] == 0])
        self.kept = ((np.arange(n) % SAMPLE == 0) | first)[self.sa]
        self.kept_at = np.cumsum(self.kept) - 1
        self.positions = self.sa[self.kept]
        del self.sa

    def find(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of a pattern, symbols[start:start + length]: the pattern's number and the text position."""
        number, left = np.arange(len(start)), length.copy()
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.bwt), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(number):
            left = left - 1
            symbol = symbols[start[number] + left]
            lo, hi = (self.before[symbol] + self.wavelet.rank(symbol, row) for row in (lo, hi))
            whole = (left == 0) & (lo < hi)
            done.append((number[whole], lo[whole], hi[whole]))
            live = (left > 0) & (lo < hi)
            number, left, lo, hi = number[live], left[live], lo[live], hi[live]
        number, lo, hi = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        count = hi - lo
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(number, count), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            kept = self.kept[rows]
            out[todo[kept]] = self.positions[self.kept_at[rows[kept]]] + steps
            todo, rows = todo[~kept], rows[~kept]
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling of those that are not yet told apart. Terminators differ from each other
    (earlier ones are less), so no comparison goes past the end of a part."""
    n = len(text)
    ends = text == 0
    order = np.argsort(np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum())), kind="stable")
    new = np.concatenate([[True], np.diff(text[order]) != 0]) | ends[order]
    rank, step = np.empty(n, np.int64), 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank: its first place
    alone = new & np.concatenate([new[1:], [True]])
    todo = order[~alone]
    while len(todo):
        old = rank[todo]
        follow = rank[todo + step]  # inside the part, as a suffix that reaches the terminator is alone
        by = np.lexsort((follow, old))
        todo, old, follow = todo[by], old[by], follow[by]
        fresh = np.concatenate([[True], np.diff(old) != 0])
        new = fresh | np.concatenate([[True], np.diff(follow) != 0])
        at = np.arange(len(todo))
        rank[todo] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        todo = todo[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    order[rank] = np.arange(n)
    return order


def search(parts: list[tuple[int, int, np.ndarray]], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard of parts (document, its first word's place, hashes of its words): documents, word places, lengths, windows."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.array([len(h) for _, _, h in parts], np.int64)
    if not sizes.sum() or not len(windows.start):
        return none
    vocab, symbols = np.unique(np.concatenate([h for _, _, h in parts]), return_inverse=True)
    text = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    text[np.arange(len(part)) + part] = symbols.reshape(-1) + 1
    # The benchmark's words in the shard's numbers; windows with a word that the shard lacks can't occur.
    at = np.minimum(np.searchsorted(vocab, windows.words), len(vocab) - 1)
    here = vocab[at] == windows.words
    missing = np.concatenate([[0], np.cumsum(~here)])
    able = np.flatnonzero(missing[windows.start + windows.length] == missing[windows.start])
    if not len(able):
        return none
    index = FMIndex(text, len(vocab) + 1)
    found, place_ = index.find(at + 1, windows.start[able], windows.length[able])
    found = able[found]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    part = np.searchsorted(starts, place_, "right") - 1
    document, first = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return document[part], first[part] + place_ - starts[part], windows.length[found], found


def occurrences(texts: list[str | None], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its words, merged spans of hit words, and items with occurring windows."""
    counts: list[int] = []
    made: list[tuple[np.ndarray, ...]] = []
    shard: list[tuple[int, int, np.ndarray]] = []
    held, stride = 0, max(1, SHARD_WORDS - windows.width + 1)
    for doc, text in enumerate(texts):
        h = hashed(text)
        counts.append(len(h))
        for first in range(0, max(1, len(h) - windows.width + 1), stride):
            part = h[first : first + SHARD_WORDS]
            if shard and held + len(part) > SHARD_WORDS:
                made.append(search(shard, windows))
                shard, held = [], 0
            shard.append((doc, first, part))
            held += len(part)
    made.append(search(shard, windows))
    doc, at, length, window = (np.concatenate(x) for x in zip(*made))

    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    order = np.lexsort((at, doc))
    for d, lo, hi in zip(doc[order].tolist(), at[order].tolist(), (at + length)[order].tolist()):
        mine = spans[d]
        if mine and lo <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(hi, mine[-1][1]))
        else:
            mine.append((lo, hi))
    found: list[list[str]] = [[] for _ in texts]
    pairs = np.unique(doc * max(1, len(windows.start)) + window)
    doc, window = pairs // max(1, len(windows.start)), pairs % max(1, len(windows.start))
    many = windows.owner_at[window + 1] - windows.owner_at[window]
    own = np.repeat(windows.owner_at[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    for key in np.unique(np.repeat(doc, many) * max(1, len(windows.items)) + windows.owner[own]).tolist():
        found[key // len(windows.items)].append(windows.items[key % len(windows.items)])
    return counts, spans, found


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def item_hashes(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, size, hashes) of every row: the item as a string, its text's bytes, its words' hashes."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias(TEXT))

    def make():
        return lambda texts: [[len((t or "").encode()) for t in texts], [hashed(t).tobytes() for t in texts]]

    return map_rows(items, make, struct_of(item=T.StringType(), size=T.LongType(), hashes=T.BinaryType()), TEXT, ("item",))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The benchmark passages in every whole document.

    Returns all columns of docs and n_words (int), hit_spans (array of word positions [start, end), merged) and
    hit_items (array of item ids as strings, sorted), one row for each input row. Null and empty texts
    have no words; items without words have no windows; a null item id counts as ''; rows that repeat an item id are
    one item. Columns of docs that already have one of the new names are replaced.

    The benchmark's words are hashed in tasks. A block of about BLOCK_BYTES of its text, eight bytes a word, is
    broadcast at a time; a benchmark within one block takes one pass over the documents, a later block another one, which merges its spans and items
    with what earlier ones have found.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = docs.sparkSession.sparkContext
    hashes = item_hashes(benchmark, item_col, item_text_col)
    blocks = (benchmark.agg(F.sum(F.octet_length(F.col(item_text_col).cast("string")))).first()[0] or 0) // BLOCK_BYTES + 1
    new = [T.StructField("n_words", T.IntegerType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    mine, text = plain_names(docs), place(docs, text_col)
    small_batches(docs)
    df = mine.withColumns({"n_words": F.lit(0), "hit_spans": F.array().cast(SPANS), "hit_items": F.array().cast("array<string>")})
    for block in range(blocks):
        part = hashes.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else hashes
        model = sc.broadcast(Windows([(r["item"], np.frombuffer(r["hashes"], np.uint64)) for r in part.select("item", "hashes").collect()], window))
        schema = T.StructType(mine.schema.fields + new)
        out = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], model=model, out=out) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, text)):
                counts, spans, found = occurrences(batch.column(batch.schema.get_field_index(text)).to_pylist(), model.value)
                n = batch.num_columns - 3
                if blocks > 1:
                    old_spans, old_items = (batch.column(n + k).to_pylist() for k in (1, 2))
                    spans = [merged([(s["start"], s["end"]) for s in o], s) for o, s in zip(old_spans, spans)]
                    found = [sorted({*o, *f}) for o, f in zip(old_items, found)]
                made = [pa.array(counts, out.field(n).type), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], out.field(n + 1).type), pa.array(found, out.field(n + 2).type)]
                yield pa.RecordBatch.from_arrays([batch.column(k).cast(out.field(k).type) for k in range(n)] + made, schema=out)

        df = df.mapInArrow(run, schema)
    return restored(df, docs, *[f.name for f in new])


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns whatever their names."""
    mine = plain_names(docs)
    found = find_hits(mine, benchmark, id_col=place(docs, id_col), text_col=place(docs, text_col))
    return restored(found.where(~contaminated()), docs)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """At least one hit word, and at least one of SHARE."""
    return (n_hit() > 0) & (n_hit() * SHARE >= F.col("n_words"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    return find_hits(docs, table(spark, sf_dir, "benchmark"), id_col=ID, text_col=TEXT).select(
        F.col(ID).alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
WITH item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc_words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) t(i)
), hits AS (
  SELECT r, i, n, item FROM grams JOIN windows USING (n, g)
), words_hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY r
), items_hit AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""
