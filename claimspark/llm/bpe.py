"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so
a cut between its two bytes is certain: the fragments on either side are encoded independently and
their ids concatenated. Two kinds of such cuts are used. Before white space that follows
other text the cut is also a boundary of the pre-tokenizer's pattern, so whole texts fall into
short chunks there and each distinct chunk is encoded once; inside a chunk's pre-tokens all
remaining forced pairs are cut before merging.

Ids equal those of the tokenizers library for the same file (no special tokens added, but
the file's own special tokens found in the text, truncation and padding unused).
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, REMEMBERED, TEXT, map_rows, narrow, struct_of

#: The pre-tokenizer's pattern and the code points with the property White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"
#: Most chunks that a worker remembers, twice over; older ones go first, which changes no result.
MEMORY = 200_000
#: Above every merge's rank.
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.made_array, self.single_array = np.array(self.made, np.int32), np.array(self.single, np.int32)
        self.byte_ranks = self.rank_of(np.repeat(self.single_array, 256), np.tile(self.single_array, 256)).reshape(256, 256)
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            b = [alphabet[c] for c in token]
            inside[b[:-1], b[1:]] = True
        self.forced = ~inside
        self.cut = self.forced.tobytes()  # at 256 * left byte + right byte
        # White space before which every cut is forced whatever precedes it, white space apart.
        solid = [b for b in range(256) if b not in b" \t\n\r\x0b\x0c"]
        ends = "".join(chr(w) for w in b" \n\t\r" if self.forced[[b for b in solid if b < 0x80], w].all())
        space = f"[{WHITE}]"
        # Chunks begin at such white space (or where the text does) and run up to the next cut.
        self.chunk = regex.compile(f"{space}*[^{WHITE}]+(?:(?![{ends}]){space}+[^{WHITE}]+)*|{space}+" if ends else ".+", regex.S)
        if set(ends) >= set(" \n"):
            import re

            # The usual case, in the faster engine: other white space is rare and only makes chunks longer.
            other = WHITE.replace(" ", "").replace("\t-\r", "\t\x0b-\r")
            self.chunk = re.compile(f"{space}*[^ \n]+(?:[ \n]+(?=[{other}])[^ \n]+)*|{space}+")
        self.words = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        REMEMBERED.append(self.forget)

    def forget(self) -> None:
        self.seen, self.older = {}, {}

    def merge_equal(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of fragments of one length, all at once: each round joins in every fragment
        its lowest-ranked pair, the leftmost of equals."""
        n, length = len(pieces), len(pieces[0])
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, length)
        ids, rows = self.single_array[raw], np.arange(n)
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        out: list = [None] * n
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(1)
            rank = ranks[np.arange(len(rows)), at]
            live = rank < NEVER
            if not live.all():
                for row, final in zip(rows[~live].tolist(), ids[~live].tolist()):
                    out[row] = final
                ids, ranks, rows, at, rank = ids[live], ranks[live], rows[live], at[live], rank[live]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = self.made_array[rank]
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            for x in (at - 1, at):
                ok = np.flatnonzero((x >= 0) & (x < width - 2))
                ranks[ok, x[ok]] = self.rank_of(ids[ok, x[ok]], ids[ok, x[ok] + 1])
        for row, final in zip(rows.tolist(), ids.tolist()):
            out[row] = final
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long fragment, with a heap over linked positions."""
        ranks, made, n = self.ranks, self.made, len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = made[rank], -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def fragments(self, word: str) -> list[bytes]:
        """A pre-token's bytes, cut at every forced pair."""
        b, cut, at, out = word.encode(), self.cut, 0, []
        for i in range(1, len(b)):
            if cut[b[i - 1] << 8 | b[i]]:
                out.append(b[at:i])
                at = i
        out.append(b[at:] if at else b)
        return out

    def learn_chunks(self, chunks: list[str]) -> None:
        """Encode chunks that are not remembered: the distinct pre-tokens, then their distinct fragments."""
        words = [self.words.findall(c) for c in chunks]
        pieces = {w: self.fragments(w) for ws in words for w in ws}
        by_length: dict[int, set[bytes]] = {}
        for fragments in pieces.values():
            for f in fragments:
                by_length.setdefault(len(f), set()).add(f)
        ids: dict[bytes, list[int]] = {}
        for length, same in by_length.items():
            if length == 1:
                ids.update((f, [self.single[f[0]]]) for f in same)
            elif length > 64:
                ids.update((f, self.merge_long([self.single[b] for b in f])) for f in same)
            else:
                some = list(same)
                ids.update(zip(some, self.merge_equal(some)))
        for chunk, ws in zip(chunks, words):
            flat = [i for w in ws for f in pieces[w] for i in ids[f]]
            self.seen[chunk] = struct.pack(f"<{len(flat)}I", *flat)

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text (None: of the empty text)."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < 2_000_000):
                size += len(texts[end] or "")
                end += 1
            out += self.encode_some(texts[at:end])
            at = end
        return out

    def encode_some(self, texts: list[str | None]) -> list[bytes]:
        if len(self.seen) > MEMORY:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        lists: list[list] = []
        unknown: set[str] = set()
        for text in texts:
            parts = []
            for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
                if part in self.special:
                    parts.append(part)
                else:
                    chunks = self.chunk.findall(part)
                    parts.append(chunks)
                    unknown.update(chunks)
            lists.append(parts)
        unknown.difference_update(seen)
        for chunk in [c for c in unknown if c in older]:
            seen[chunk] = older[chunk]
            unknown.discard(chunk)
        self.learn_chunks(list(unknown))
        get = seen.__getitem__
        out = [b"".join([struct.pack("<I", self.special[p]) if isinstance(p, str) else b"".join(map(get, p)) for p in parts]) for parts in lists]
        for chunk in [c for c in unknown if len(c) > 64]:
            del seen[chunk]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, special tokens as their own text."""
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with the vocabulary at `path` (readable on every executor) and decode its ids.

    Returns id_col, ids (binary: little-endian unsigned 32-bit ids) and decoded (string), one row for each input
    row. A null or empty text has no ids and decodes to the empty text. Repeated rows
    and null ids are kept as they are; other columns are ignored.
    """

    def make():
        tok = load(path)

        def run(texts: list[str | None]) -> list:
            ids = tok.encode_many(texts)
            return [pa.array(ids, pa.binary()), pa.array([tok.decode(i) for i in ids], pa.string())]

        run.forget = tok.forget
        return run

    df = narrow(docs, id_col, text_col)
    schema = struct_of(**{ID: df.schema[ID].dataType, "ids": T.BinaryType(), "decoded": T.StringType()})
    return map_rows(df, make, schema, TEXT, (ID,)).withColumnRenamed(ID, id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what round_trip() returns."""
    return encoded.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimspark.session import table

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
