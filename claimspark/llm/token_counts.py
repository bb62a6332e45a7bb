"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates every vocabulary match of a text unit; dynamic programming over
the matches' ends carries the best score and the number of pieces of the best path, nothing else.
The rules are those of the tokenizers library's Unigram model under a Metaspace
pre-tokenizer that always prepends and splits:

- spaces become U+2581, one is put before the text, and each U+2581 starts a new unit;
- at each start position the matches are tried in ascending length, and a path replaces another that ends at the same
  place only if its score is strictly higher, so the earliest start wins a tie;
- where no match is just the character at a position, an unknown piece of that character is tried at
  the vocabulary's least score less 10;
- unknown characters count as their UTF-8 bytes (byte fallback).

A character that no piece holds can only be an unknown piece, so units are also cut around it.

The vocabulary's scores are taken as they stand. The given 32k file is a BPE model: its scores are merge ranks, not log probabilities, so
the counts are those of the Unigram model with these scores, not of the file's own BPE encoder. A true unigram file works alike.
"""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, map_rows, narrow, struct_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NO_PATH = float("-inf")
#: Most pieces of text that a worker remembers before it forgets them all, which changes no result.
MEMORY = 1_000_000
#: Longer ones are not remembered.
LONG = 64


class Remembered(dict):
    """Pieces and score of what stands between two spaces."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, part: str) -> tuple[int, float]:
        found = self.counter.measure(part)
        if len(part) < LONG:
            self[part] = found
        return found


class Counter:
    """Piece counts under a vocabulary of (piece, score) rows."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        inside = "".join(sorted({c for piece, _ in vocab for c in piece} - {SPACE}))
        known = f"[{regex.escape(inside, special_only=False)}]"
        # A unit: U+2581 with the known characters after it, or such a run alone, or a run of unknown characters.
        self.unit = regex.compile(f"{SPACE}{known}*|{known}+|[^{SPACE}{regex.escape(inside, special_only=False)}]+", regex.S)
        # A line break that no piece holds is a cut too: parts that begin with one then have no space before them.
        self.line_cut = "\n" not in inside
        self.seen = Remembered(self)
        self.units: dict[str, tuple[int, float]] = {}

    def best(self, unit: str) -> tuple[int, float]:
        """Pieces and score of the best path of one unit."""
        n = len(unit)
        # At each end: the best score so far and its pieces. Matches come by end, longest first, so by ascending start.
        score_at, pieces_at = [0.0, *[NO_PATH] * n], [0] * (n + 1)
        done, single = 0, True
        for last, (length, score) in self.automaton.iter(unit):
            end = last + 1
            while done < end:
                if not single:
                    self.try_unknown(unit, done, score_at, pieces_at)
                done, single = done + 1, False
            score += score_at[end - length]
            if score > score_at[end]:
                score_at[end], pieces_at[end] = score, pieces_at[end - length] + 1
            if length == 1:
                single = True
        while done <= n:
            if not single:
                self.try_unknown(unit, done, score_at, pieces_at)
            done, single = done + 1, False
        return pieces_at[n], score_at[n]

    def try_unknown(self, unit: str, end: int, score_at: list[float], pieces_at: list[int]) -> None:
        score = score_at[end - 1] + self.unknown
        if score > score_at[end]:
            score_at[end], pieces_at[end] = score, pieces_at[end - 1] + len(unit[end - 1].encode())

    def measure(self, part: str) -> tuple[int, float]:
        """Pieces and score of a part between two spaces; its units are remembered too."""
        pieces, score = 0, 0.0
        for unit in self.unit.findall(part if self.line_cut and part[:1] == "\n" else SPACE + part):
            found = self.units.get(unit)
            if found is None:
                found = self.best(unit)
                if len(unit) < LONG:
                    self.units[unit] = found
            pieces += found[0]
            score += found[1]
        return pieces, score

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text; none for a null or empty text."""
        if not text:
            return 0, 0.0
        text = text.replace(SPACE, " ")
        if text[0] != " ":
            text = " " + text
        if self.line_cut:
            text = text.replace("\n", " \n")
        if len(self.seen) + len(self.units) > MEMORY:
            self.seen.clear()
            self.units.clear()
        found = list(map(self.seen.__getitem__, text[1:].split(" ")))
        return sum(map(itemgetter(0), found)), sum(map(itemgetter(1), found))


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())])


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the pieces of every whole text under the vocabulary at `path` (readable on every executor).

    Returns id_col, n_tokens (long) and best_score (double, the best path's score), one row
    for each input row. A null or empty text has 0 pieces and score 0. Repeated rows and null ids
    are kept as they are; other columns are ignored.
    """

    def make():
        counter = load(path)

        def run(texts):
            found = [counter.count(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    df = narrow(docs, id_col, text_col)
    schema = struct_of(**{ID: df.schema[ID].dataType, "n_tokens": T.LongType(), "best_score": T.DoubleType()})
    return map_rows(df, make, schema, TEXT, (ID,)).withColumnRenamed(ID, id_col)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from claimspark.session import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
