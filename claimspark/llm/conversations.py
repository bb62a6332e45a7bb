"""Conversation structure repair by min-plus matrices over a grammar.

A conversation is a sequence of symbols, one for each row: the role's initial and the row's fault. Edits (keep, rerole, delete, insert) lead from
state to state of the roles that are allowed, and the cheapest edits of a run of rows from each state to each are a 4 by 4 matrix of
(cost, audit), the audit being the edits' initials. Matrices of adjoining runs combine by least cost, then least audit; two cheapest audits
of a cell are never the beginning of one another (they edit the same rows, so the longer one would have more insertions), hence least parts make the
least whole.

1. Rows are ordered by ranges of (conversation, turn, role, text's digest), so a long conversation is in many tasks, and written as pieces of up to PIECE symbols.
2. Re-Pair over the distinct pieces of all conversations: in each round the most frequent adjoining pairs become symbols of their own.
3. A rule's matrix is the product of its pair's, made once and bottom-up; its audits are ropes that share the parts' ropes.
4. A conversation's pieces are rewritten by the rules and folded from the start state, symbol by symbol. What the audits of all states have in common is put
   aside at once, so only the undecided ends are compared.
5. The repaired text's SHA-256 is one stream of one conversation by nature: its rows come to one task in order, behind their audit, and
   go through it a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import struct_of
from claimspark.llm.exact import SPACE
from claimspark.session import materialize, table

#: Roles by initial, and what they may follow: states are the start, after s, after u and after a; the start and after a are ends.
START, ENDS = 0, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an insertion or a new role brings in each state, and the state that it leads to.
MADE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
INITIALS, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
#: Symbols of a piece, rows of a range, rounds of pairing and pairs that become symbols in one.
PIECE, RANGE, ROUNDS, PAIRS = 1024, 500_000, 5, 32

Rope = str | tuple
Matrix = list[dict[int, tuple[int, Rope]]]
"""By the state before: the state after, its least cost and least audit; impossible states are absent."""


def flat(rope: Rope) -> str:
    """The text of a rope."""
    out, left = [], [rope]
    while left:
        r = left.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            left += [r[1], r[0]]
    return "".join(out)


def least(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    """The cheaper of two, of equal ones the least by audit."""
    if a is None or b[0] < a[0] or (b[0] == a[0] and flat(b[1]) < flat(a[1])):
        return b
    return a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two runs, one after the other."""
    out: Matrix = []
    for row in a:
        made: dict[int, tuple[int, Rope]] = {}
        for mid, (cost, rope) in row.items():
            for end, (more, further) in b[mid].items():
                made[end] = least(made.get(end), (cost + more, (rope, further) if rope and further else rope or further))
        out.append(made)
    return out


def insertions() -> Matrix:
    """Any number of insertions; none goes through a state twice."""
    out: Matrix = []
    for state in range(4):
        row, cost, audit = {}, 0, ""
        while state not in row:
            row[state] = (cost, audit)
            state, cost, audit = MADE[state][1], cost + INSERT, audit + "I"
        out.append(row)
    return out


def of_row(symbol: str) -> Matrix:
    """The insertions before a row and what is done to it."""
    initial, fault = INITIALS[(ord(symbol) - 97) // 4], FAULTS[(ord(symbol) - 97) % 4]
    edits: Matrix = []
    for state in range(4):
        row = {state: (DELETE, "D")}
        if fault not in ("blank", "duplicate"):
            cut = CUT * (fault == "truncated")
            if (state, initial) in NEXT:
                row[NEXT[state, initial]] = least(row.get(NEXT[state, initial]), (KEEP + cut, "K"))
            to = MADE[state][1]
            row[to] = least(row.get(to), (REROLE + cut, "R"))
        edits.append(row)
    return times(insertions(), edits)


def symbol(initial: Column, blank: Column, duplicate: Column, truncated: Column) -> Column:
    """One letter for a row: its role's initial and its first fault."""
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(blank, 1).when(duplicate, 2).when(truncated, 3).otherwise(0)
    return F.char(which * 4 + fault + 97)


class Grammar:
    """Rules (pair, symbol) in their order, and every symbol's matrix."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {chr(97 + i): of_row(chr(97 + i)) for i in range(16)}
        for pair, name in rules:
            self.matrices[name] = times(self.matrices[pair[0]], self.matrices[pair[1]])

    def rewritten(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols


def repair_pairs(pieces: DataFrame) -> list[tuple[str, str]]:
    """Rules of the most frequent pairs in the distinct pieces; a pair that overlaps another of its round waits for the next.

    A round sends the driver PAIRS * 4 rows at most, and there are ROUNDS * PAIRS rules at most, so the grammar is bounded; what no rule
    covers stays as it is and costs a product of its own.
    """
    distinct = materialize(pieces.groupBy("symbols").count(), "conversation-pieces")
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        grammar = Grammar(rules)

        def count(batches: Iterator[pa.RecordBatch], grammar=grammar) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text, n in zip(batch["symbols"].to_pylist(), batch["count"].to_pylist()):
                    text = grammar.rewritten(text)
                    for pair in map("".join, zip(text, text[1:])):
                        found[pair] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counted = distinct.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        firsts, seconds, before = set(), set(), len(rules)
        for pair in (r["pair"] for r in counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS * 4).collect()):
            if len(rules) - before < PAIRS and pair[0] not in seconds and pair[1] not in firsts:
                firsts.add(pair[0])
                seconds.add(pair[1])
                rules.append((pair, chr(0x100 + len(rules))))
        if len(rules) == before:
            break
    return rules


def ordered(rows: DataFrame, n: int) -> DataFrame:
    """The rows in ranges of about RANGE rows by (conv, turn, role, sha), each in order, with the number of its range."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())


def pieces_of(rows: DataFrame, n: int) -> DataFrame:
    """(conv, range, at, symbols, low, high, turns): each conversation's rows in order, by pieces. rows: (conv, turn, role, sha, times, first, again), the
    symbols of a row's first copy and of the others. A conversation without rows has empty pieces. turns counts distinct turns of a piece, low to high."""
    schema = T.StructType([rows.schema["conv"], *struct_of(range=T.IntegerType(), at=T.LongType(), symbols=T.StringType(), low=T.LongType(), high=T.LongType(), turns=T.LongType()).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, piece, at, where = None, None, 0, 0
        out: list[list] = []

        def close(following: Piece | None) -> None:
            nonlocal piece, at
            out.append([conv, where, at, "".join(piece.symbols), piece.low, piece.high, piece.turns])
            piece, at = following, at + 1

        for batch in batches:
            for c, turn, n_copies, first, again, where in zip(*(batch[k].to_pylist() for k in ("conv", "turn", "times", "first", "again", "range"))):
                if piece is None or c != conv:
                    if piece is not None:
                        close(None)
                    conv, piece = c, Piece()
                for text in copies(first, again, n_copies):
                    if piece.size + len(text) > PIECE:
                        close(Piece())
                    piece.add(text, turn)
            if len(out) >= 1000:
                yield record_batch(out, schema)
                out.clear()
        if piece is not None:
            close(None)
        yield record_batch(out, schema)

    return ordered(rows, n).select("conv", "turn", "times", "first", "again", "range").mapInArrow(run, schema)


class Piece:
    """Symbols of some adjoining rows, and the turns they span."""

    def __init__(self):
        self.symbols, self.size, self.low, self.high, self.turns = [], 0, None, None, 0

    def add(self, symbols: str, turn: int | None) -> None:
        self.symbols.append(symbols)
        self.size += len(symbols)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1


def copies(first: str, again: str, n: int) -> Iterator[str]:
    """The symbols of a row's n copies, PIECE at a time at most."""
    for at in range(0, n, PIECE):
        size = min(PIECE, n - at)
        yield again * size if at else first + again * (size - 1)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def record_batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    """A batch of rows in the schema's order."""
    fields = to_arrow(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


class Fold:
    """The cheapest edits of a conversation so far, for each state."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.states, self.settled = grammar, {START: (0, "")}, []
        self.closing = insertions()

    def step(self, matrix: Matrix) -> None:
        made: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.states.items():
            for end, (more, rope) in matrix[state].items():
                made[end] = least(made.get(end), (cost + more, audit + flat(rope)))
        common = len(commonprefix([audit for _, audit in made.values()]))
        if common:
            self.settled.append(next(iter(made.values()))[1][:common])
        self.states = {s: (cost, audit[common:]) for s, (cost, audit) in made.items()}

    def add(self, symbols: str) -> None:
        for s in self.grammar.rewritten(symbols):
            self.step(self.grammar.matrices[s])

    def end(self) -> tuple[int, str]:
        """The least cost and audit."""
        self.step(self.closing)
        best = None
        for state in ENDS:
            if state in self.states:
                best = least(best, self.states[state])
        return best[0], "".join(self.settled) + best[1]


def counts_of(symbols: str) -> tuple[int, int, int]:
    return tuple(sum(symbols.count(chr(97 + 4 * i + f)) for i in range(4)) for f in (1, 2, 3))


def illegal_in(symbols: str) -> int:
    """Adjoining pairs whose initials are not allowed."""
    roles = symbols.translate({97 + i: INITIALS[i // 4] for i in range(16)})
    return sum(pair not in (("s", "u"), ("u", "a"), ("a", "u")) for pair in zip(roles, roles[1:]))


RESULT = struct_of(gaps=T.LongType(), blank=T.LongType(), duplicate=T.LongType(), truncated=T.LongType(), illegal=T.LongType(), cost=T.LongType(), audit=T.StringType())


def folded(pieces: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """conv and the columns of RESULT, of every conversation's pieces in their order."""
    schema = T.StructType([pieces.schema["conv"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)

        @lru_cache(1 << 14)
        def whole(symbols: str) -> tuple:  # conversations of one piece are often alike
            fold = Fold(grammar)
            fold.add(symbols)
            return (*counts_of(symbols), illegal_in(symbols), *fold.end())

        def close(conv, parts) -> tuple:
            spans = [p[1:] for p in parts if p[1] is not None]
            gaps = spans[-1][1] - spans[0][0] + 1 - sum(s[2] for s in spans) + sum(a[1] == b[0] for a, b in zip(spans, spans[1:])) if spans else 0
            if len(parts) == 1:
                return (conv, gaps, *whole(parts[0][0]))
            fold, faults, illegal, last = Fold(grammar), [0, 0, 0], 0, ""
            for symbols, *_ in parts:
                fold.add(symbols)
                faults = [a + b for a, b in zip(faults, counts_of(symbols))]
                illegal += illegal_in(last + symbols)
                last = symbols[-1:] or last
            return (conv, gaps, *faults, illegal, *fold.end())

        conv, parts = None, []
        for batch in batches:
            out = []
            for c, *part in zip(*(batch[k].to_pylist() for k in ("conv", "symbols", "low", "high", "turns"))):
                if parts and c != conv:
                    out.append(close(conv, parts))
                    parts = []
                conv = c
                parts.append(part)
            yield record_batch(out, schema)
        yield record_batch([close(conv, parts)] if parts else [], schema)

    lined = pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "range", "at")
    return lined.select("conv", "symbols", "low", "high", "turns").mapInArrow(run, schema)


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation's rows in order and its audit."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state, role[:1]]
        else:
            role, state = MADE[state]
        yield role, text


def hashed(results: DataFrame, rows: DataFrame) -> DataFrame:
    """results with repaired_sha256, of rows (conv, turn, role, sha, times, text): in a task a conversation's result comes first, then its rows in order."""
    kept = rows.where("times > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "sha", "times", "text", F.lit(None).cast(RESULT).alias("result"))
    null = lambda kind: F.lit(None).cast(kind)
    heads = results.select("conv", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("sha"), null("long").alias("times"), null("string").alias("text"), F.struct(*RESULT.names).alias("result"))
    order = [F.col("conv").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "sha"]
    lined = heads.unionByName(kept).repartition("conv").sortWithinPartitions(*order).select("conv", "role", "times", "text", "result")
    schema = T.StructType([results.schema["conv"], *RESULT.fields, T.StructField("repaired_sha256", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield from zip(*(part[k].to_pylist() for k in ("conv", "role", "times", "text", "result")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = read(batches), []
        head = next(rows, None)
        while head is not None:
            following = None

            def own():
                nonlocal following
                for r in rows:
                    if r[4] is not None:
                        following = r
                        return
                    for _ in range(r[2]):
                        yield r[1], r[3]

            texts, digest, joint = own(), hashlib.sha256(), ""
            for role, text in edited(head[4]["audit"], texts):
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            for _ in texts:  # an audit has an edit for every row, so none is left but where there is no audit
                pass
            out.append((head[0], *head[4].values(), digest.hexdigest()))
            head = following if following is not None else next(rows, None)
            if len(out) >= 512 or head is None:
                yield record_batch(out, schema)
                out = []

    return lined.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) as damaged by the CRC-32 of `conv:turn` modulo 20, with `times`: 0 drops, 1 empties the text, 2 takes its marks
    that end a sentence, 3 repeats the row, 4 makes it a user's; null conversations, turns, roles and texts are a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn")).cast("binary")) % 20
    return rows.select(
        "conv", "turn",
        F.when(n == 4, "user").otherwise(space("role")).alias("role"),
        F.when(n == 1, "").when(n == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(n == 0, 0).when(n == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation's roles the form (s?(ua)+)?, of (conv, turn, role, text, times).

    Returns conv, gaps in its turns, its blank, duplicate and truncated rows, illegal pairs of roles, cost, audit and repaired_sha256, one row for each conv, null
    ones being one conversation; `times` 0 names a conversation without the row. Rows go by turn, nulls first, then role, then the text's digest; rows
    that are alike in all adjoin. A role of no or another initial can't be kept. No rows: zeros, an empty audit and the digest of no text.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    held = rows.select("conv", "turn", "role", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "text", "times")
    faults = held.select("conv", "turn", "role", "sha", "times", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    alike = faults.groupBy("conv", "turn", "role", "sha", "blank", "truncated").agg(F.sum("times").alias("times"))
    alike = materialize(alike, "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    firsts = alike.where("times > 0").groupBy("conv", "role", "sha").agg(F.min(place).alias("first")).select(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "sha")], F.col("first.turn").alias("f_turn"))
    own = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv", "turn", "role", "sha")]
    seen = F.col("f_sha").isNull()
    initial = F.substring("role", 1, 1)
    letters = alike.join(firsts, own, "left").select("conv", "turn", "role", "sha", "times", symbol(initial, F.col("blank"), seen, F.col("truncated")).alias("first"), symbol(initial, F.col("blank"), F.lit(True), F.lit(False)).alias("again"))
    pieces = materialize(pieces_of(letters, alike.count()), "conversation-runs")
    return hashed(folded(pieces, repair_pairs(pieces)), held)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair(damaged(rows)).withColumnRenamed("conv", "conv_id")


#: The same edits by a recursion over each conversation's rows, one row of it for each state.
OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), numbered AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) % 20 AS n
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE n WHEN 4 THEN 'user' ELSE role END AS role,
         CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM numbered, unnest(range(CASE n WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) t(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, substr(role, 1, 1) AS initial,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged
), held AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM placed
), insertion(before, after, cost, audit, made) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')
), edit(before, after, cost, audit, initial, role) AS (
  VALUES (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL),
         (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL), (3, 2, 0, 'K', 'u', NULL),
         (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant'), (3, 2, 2, 'R', NULL, 'user')
), path(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'repaired': ''} FROM held
  UNION ALL
  SELECT h.conv_id, h.i, e.after, min({'cost': p.best.cost + n.cost + e.cost + CASE WHEN e.audit <> 'D' AND h.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.best.audit || n.audit || e.audit,
      'repaired': p.best.repaired || n.made || CASE WHEN e.audit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, h.role) || ':' || h.text END})
  FROM path p JOIN held h ON h.conv_id IS NOT DISTINCT FROM p.conv_id AND h.i = p.i + 1
  JOIN insertion n ON n.before = p.state JOIN edit e ON e.before = n.after AND (e.initial IS NULL OR e.initial = h.initial)
  WHERE e.audit = 'D' OR h.fault IS NULL OR h.fault = 'truncated'
  GROUP BY h.conv_id, h.i, e.after
), ended AS (
  SELECT p.conv_id, min({'cost': best.cost + n.cost, 'audit': best.audit || n.audit, 'repaired': best.repaired || n.made}) AS best
  FROM path p JOIN (SELECT conv_id, max(i) AS i FROM held GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i
  JOIN insertion n ON n.before = p.state AND n.after IN (0, 3) GROUP BY p.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM held GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.repaired[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
