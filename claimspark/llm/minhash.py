"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct shingles of WIDTH words. Each of M registers holds the set's least hash under one
hash function, turned into an exponential variable and truncated to its exponent in base BASE: mergeable by the
maximum, and equal between two sets with about the chance of their similarity. ROWS registers make a band.

1. Equal sets are one node from the start.
2. Bands: nodes that share a band's registers share a bucket. Each node is compared with the first node of the buckets that it
   shares most with. Nodes linked so far make groups.
3. Buckets whose nodes are of one group have nothing more to give. In the others, pairs across
   groups remain. In buckets of up to SMALL nodes these pairs are estimated jointly by likelihood from both registers and the
   known set sizes, and the plausible ones are confirmed on full sets first, then all others that are still of two groups. In larger ones every node meets only the nodes outside
   the bucket's largest group, by blocks of BLOCK nodes: a task has the full sets of two blocks, confirms pairs across
   groups and returns only links that join groups. Group members are never listed in pairs.

A pair of similarity 0.8 shares no bucket with the chance (1 - 0.8 ** ROWS) ** (M / ROWS), below 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import HASHES, ID, TEXT, map_rows, narrow, struct_of
from claimspark.llm.fingerprints import FACTORS, mixed
from claimspark.operators.components import components
from claimspark.session import materialize, table

WIDTH = 4
#: Linked from this share of the union on, in hundredths.
PERCENT = 80
M, ROWS = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Pairs whose likeliest similarity is below this are confirmed after the others.
PLAUSIBLE = 0.66
SMALL, BLOCK = 12, 256
#: Shingles of a block of nodes, a longer set aside.
WEIGHT = 300_000
#: Bands whose large buckets are searched first.
FIRST_BANDS = 4
#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_seeds = np.random.default_rng(20)
XOR = _seeds.integers(0, 1 << 63, M, dtype=np.uint64)[:, None]
MULTIPLY = (_seeds.integers(0, 1 << 63, M, dtype=np.uint64) | np.uint64(1))[:, None]
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending: A-Z lower-cased, words between ASCII white space; a
    shorter text is one shingle, a text without words none."""
    words = text.encode().translate(FOLD).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        return mixed((h * FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    s = h[: n - WIDTH + 1] * FACTORS[0]
    for k in range(1, WIDTH):
        s = s + h[k : n - WIDTH + 1 + k] * FACTORS[k]
    return np.unique(mixed(s))


def registers(s: np.ndarray) -> np.ndarray:
    """The M registers of a non-empty set."""
    least = np.full(M, np.uint64(1 << 32))
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (((s[at : at + 2048] ^ XOR) * MULTIPLY) >> np.uint64(32)).min(1))
    e = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, LIMIT).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likeliest(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """The likeliest similarity of pairs of sets, from their registers (pairs by M) and sizes."""
    plus, minus = (u > v).sum(1)[:, None], (u < v).sum(1)[:, None]
    share_u, share_v = (n_u / (n_u + n_v))[:, None], (n_v / (n_u + n_v))[:, None]
    j = np.minimum(share_u / share_v, share_v / share_u) * np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(share_u - share_v * j), p(share_v - share_u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = plus * log(more) + minus * log(less) + (M - plus - minus) * log(1 - more - less)
    best = fit.argmax(1)
    return j[np.arange(len(j)), best]


def sketches(docs: DataFrame) -> DataFrame:
    """(ID, n, set_key, registers) of every row of (ID, TEXT); set_key and registers are null for empty sets."""

    def make():
        def run(texts):
            sets = [shingles(t) for t in texts]
            keys = [xxhash.xxh128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets]
            return [[len(s) for s in sets], keys, [registers(s).tobytes() if len(s) else None for s in sets]]

        return run

    schema = T.StructType([docs.schema[ID], *struct_of(n=T.LongType(), set_key=T.BinaryType(), registers=T.BinaryType()).fields])
    return map_rows(docs, make, schema, TEXT, (ID,))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, set) of the rows of (ID, TEXT) whose id is in ids (node); set: the shingle hashes as longs."""
    few = ids.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if few else ids, docs[ID] == ids["node"], "left_semi")

    def make():
        def run(texts):
            sets = [shingles(t).view(np.int64) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate([np.zeros(0, np.int64), *sets])
            return [pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))]

        return run

    schema = T.StructType([T.StructField("node", docs.schema[ID].dataType), T.StructField("set", T.ArrayType(T.LongType()))])
    return map_rows(some.select(F.col(ID).alias("node"), TEXT), make, schema, TEXT, ("node",))


def similar(shared: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * shared >= PERCENT * (n_a + n_b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    at = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set"))
    both = pairs.select("a", "b").join(at("b"), "b").join(at("a"), "a")
    return both.where(similar(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"))).select("a", "b")


def sizes_allow(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with plausible: whether their likeliest similarity is at least PLAUSIBLE."""
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("registers").alias(f"{end}_registers"))
    both = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b")

    @F.pandas_udf(T.DoubleType())
    def estimate(u, v, n_u, n_v):
        import pandas as pd

        if not len(u):
            return pd.Series([], dtype=float)
        read = lambda x: np.frombuffer(b"".join(x), "<u2").reshape(len(x), M).astype(np.int32)
        few = [slice(at, at + 512) for at in range(0, len(u), 512)]
        return pd.Series(np.concatenate([likeliest(read(u[s]), read(v[s]), n_u[s].to_numpy(float), n_v[s].to_numpy(float)) for s in few]))

    return both.select("a", "b", (estimate("a_registers", "b_registers", "a_n", "b_n") >= PLAUSIBLE).alias("plausible"))


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that are of two groups (node, label)."""
    at = lambda end: groups.select(F.col("node").alias(end), F.col("label").alias(f"{end}_group"))
    both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")


def links_in_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join groups, within the buckets of members (bucket, node, group, size), by blocks.

    A pair across groups has at least one node outside the bucket's largest group. So every node goes to a block of about BLOCK nodes and meets, block by
    block, only those outside; a cell is a block of nodes with a block of outside ones. Blocks have few nodes and few shingles, so a cell of long documents takes no more memory."""
    counted = members.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("weight"))
    top = F.struct("nodes", "group")
    largest = counted.groupBy("bucket").agg(
        F.max_by("group", top).alias("largest"), (F.sum("nodes") - F.max("nodes")).alias("outside"), F.sum("weight").alias("weight"), (F.sum("weight") - F.max_by("weight", top)).alias("outside_weight"),
    )
    blocks = lambda nodes, weight: F.greatest(F.ceil(F.col(nodes) / BLOCK), F.ceil(F.col(weight) / WEIGHT)).cast("int")
    rows = members.join(largest, "bucket").withColumns({"blocks": blocks("size", "weight"), "others": blocks("outside", "outside_weight")})
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    place = lambda i, j, side: F.struct(F.xxhash64("bucket", i, j).alias("cell"), F.lit(side).alias("side"))
    here = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: place(at(F.col("blocks")), j, 0))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(i, at(F.col("others")), 1))
    cells = rows.select("node", "group", F.inline(F.when(F.col("group") == F.col("largest"), here).otherwise(F.concat(here, meets))))
    schema = T.StructType([T.StructField(c, members.schema["node"].dataType) for c in "ab"])

    def run(cell):
        import pandas as pd

        edges = spanning([s.view(np.uint64) for s in cell["set"]], cell["group"].to_numpy(), cell["side"].to_numpy())
        node = cell["node"].to_numpy()
        return pd.DataFrame({"a": node[[e[0] for e in edges]], "b": node[[e[1] for e in edges]]})

    return cells.join(sets, "node").groupBy("cell").applyInPandas(run, schema)


def spanning(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different groups and sides, as few as join what they join."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n < 2 or len(set(group.tolist())) < 2:
        return []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    shared, width = np.zeros((n, n), np.float32), 16_384
    for at in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    shared = np.rint(shared).astype(np.int64)
    link = 100 * shared >= PERCENT * (size[:, None] + size[None, :] - shared)
    link &= (group[:, None] != group[None, :]) & (side[:, None] != side[None, :])
    root = {g: g for g in set(group.tolist())}

    def find(g):
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    out = []
    for i, j in zip(*np.nonzero(np.triu(link, 1))):
        a, b = find(group[i]), find(group[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def groups_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes that are linked with another; nodes: (node, n, registers) by distinct sets, docs: (ID, TEXT)."""
    band = lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"))
    banded = nodes.select("node", "n", F.inline(F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), band)))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "bucket"), "dedup-members")
    sets = materialize(sets_of(docs, materialize(members.select("node").distinct(), "dedup-needed")), "dedup-sets")

    best = members.where("node <> first").groupBy(F.col("node").alias("b"), F.col("first").alias("a")).agg(F.count(F.lit(1)).alias("bands"))
    best = best.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
    links = materialize(confirmed(best, sets), "dedup-links")
    groups = components(links)

    small = still_open(members.where(F.col("size") <= SMALL), groups)
    left, right = (small.select("bucket", F.col("node").alias(e), F.col("n").alias(f"{e}_n"), F.col("group").alias(f"{e}_group")) for e in "ab")
    pairs = left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group")) & sizes_allow("a_n", "b_n")).select("a", "b").distinct()
    pairs = materialize(estimated(pairs, nodes), "dedup-pairs")
    links = links.unionByName(materialize(confirmed(pairs.where("plausible"), sets), "dedup-links"))
    rest = materialize(across(pairs.where("not plausible"), components(links)), "dedup-pairs")
    links = links.unionByName(materialize(confirmed(rest, sets), "dedup-links"))

    large = members.where(F.col("size") > SMALL)
    if large.isEmpty():
        return components(links)
    # A few bands first: they join most of what belongs together, so that later ones have few nodes outside a largest group.
    for these in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        links = links.unionByName(materialize(links_in_cells(still_open(large.where(these), components(links)), sets), "dedup-links"))
    return components(links)


def still_open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one group, with their group."""
    grouped = members.join(groups, "node", "left").select("bucket", "node", "n", "size", F.coalesce("label", "node").alias("group"))
    open_ = grouped.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("bucket")
    return materialize(grouped.join(open_, "bucket"), "dedup-open")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a similarity of at least PERCENT hundredths, confirmed on full sets.

    Returns id_col (a whole number), n_shingles (size of the document's set), component_id (the least id
    reachable by links) and kept (whether that is the document's own id), one row for each input row. Null and empty
    texts have an empty set and are linked with nothing, not even with each other. Rows that repeat an id are one
    document, linked with whatever either text is; an id of null gets the group of its text's other copies,
    or null. Other columns are ignored.
    """
    df = narrow(docs, id_col, text_col)
    signed = materialize(sketches(df), "dedup-sketches")
    distinct = signed.where("n > 0").groupBy("set_key", "n", "registers").agg(F.min(ID).alias("node"))
    distinct = materialize(distinct.where("node is not null"), "dedup-distinct")
    nodes = distinct.select("node", "n", "registers")
    labels = groups_of(df, nodes)
    by_set = distinct.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    out = signed.select(ID, "n", "set_key").join(by_set, "set_key", "left")
    return out.select(
        F.col(ID).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", ID).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the least of their group, with their own columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    dropped = materialize(found.select(id_col).distinct(), "dedup-dropped")
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, id_col, "left_anti").select(*docs.columns)


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact links by joining shingles, then reachability.
OP7_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM doc_words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) t(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(m.n) + any_value(n.n) - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), least_reached AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_reached USING (doc_id)
"""
