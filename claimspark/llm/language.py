"""Language identification by inference of a mixture of languages.

Each word of a text is taken to be written in one language and each language to write words by its own
character trigrams (hashed into buckets, with marks at a word's ends). A document is a mixture: expectation-maximisation
over its words estimates the languages' proportions. The set of languages is chosen by penalised
likelihood: starting with the one of the greatest proportion, languages join as long as the log likelihood gains more than half
the log of the number of words for each. The prediction is the set's language of the greatest
proportion, its score that proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, held_out, map_rows, narrow, struct_of
from claimspark.session import table

#: The most labelled documents that the trigram counts are taken from, drawn by a hash of the id.
MAX_TRAIN = 20_000
BUCKETS = 1 << 16
ROUNDS = 12
SMOOTH = 0.3
UNDETERMINED = "und"
#: Characters of text that are worked on at once in a task.
CHUNK = 1_500_000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def word_trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, where each word begins among them, and the text each word is in."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    marked = np.where(is_letter, codes, np.uint32(32))
    at = np.flatnonzero(is_letter)
    h = marked[at - 1] * np.uint32(0x9E3779B1) + marked[at] * np.uint32(0x85EBCA77) + marked[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    begins = np.flatnonzero(~is_letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return (h >> np.uint32(16)).astype(np.int64), begins, np.searchsorted(ends, at[begins] - 1, "right")


def mixture(likelihood: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents by languages) and log likelihood by EM, for words sorted by document. allowed: the
    languages of each document's set."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = likelihood * np.repeat(share, counts, 0)
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, starts, 0) / counts[:, None]
    return share, np.add.reduceat(np.log((likelihood * np.repeat(share, counts, 0)).sum(1)), starts)


class Languages:
    """Trigram log probabilities of each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.array([counts[k] for k in self.names], float).reshape(len(self.names), BUCKETS)
        self.logp = np.log((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * BUCKETS)).T.astype(np.float32)

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores, at = [], [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < CHUNK):
                size += len(texts[end] or "")
                end += 1
            a, b = self.identify_some(texts[at:end])
            names += a
            scores += b
            at = end
        return names, scores

    def identify_some(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        best, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        grams, begins, doc = word_trigrams(texts)
        if not len(begins) or not self.names:
            return best, score
        logs = np.add.reduceat(self.logp[grams], begins, 0).astype(np.float64)
        top = logs.max(1)
        likelihood = np.maximum(np.exp(logs - top[:, None]), 1e-30)
        docs, starts, counts = np.unique(doc, return_index=True, return_counts=True)
        n, width = len(docs), len(self.names)
        share, _ = mixture(likelihood, starts, counts, np.ones((n, width)))
        ranked = np.argsort(-share, axis=1, kind="stable")
        chosen = np.zeros((n, width))
        chosen[np.arange(n), ranked[:, 0]] = 1
        loglik = np.add.reduceat(np.log(likelihood[np.arange(len(doc)), np.repeat(ranked[:, 0], counts)]), starts)
        result, growing = chosen.copy(), np.arange(n)
        for size in range(1, width):
            wider = chosen[growing].copy()
            wider[np.arange(len(growing)), ranked[growing, size]] = 1
            rows = np.repeat(np.isin(np.arange(n), growing, assume_unique=True), counts)
            c = counts[growing]
            share, wider_log = mixture(likelihood[rows], np.concatenate([[0], np.cumsum(c)[:-1]]), c, wider)
            better = wider_log - loglik[growing] > 0.5 * np.log(c + 1)
            growing, share, wider = growing[better], share[better], wider[better]
            chosen[growing], result[growing], loglik[growing] = wider, share, wider_log[better]
            if not len(growing):
                break
        pick = result.argmax(1)
        for d, p, s in zip(docs.tolist(), pick.tolist(), result[np.arange(n), pick].tolist()):
            best[d], score[d] = self.names[p], min(1.0, s)
        return best, score


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int = 4, remainder: int = 2, most: int = MAX_TRAIN) -> Languages:
    """Trigram counts of each language over at most about `most` labelled rows whose id does not hash to `remainder`."""
    marked = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT), F.col(lang_col).cast("string").alias("lang"))
    marked = marked.where(F.col("lang").isNotNull() & ~held_out(ID, modulus, remainder))
    n = marked.select(ID, "lang").count()
    if n > most:
        marked = marked.where(F.pmod(F.xxhash64(ID), F.lit(1 << 30)) < int((1 << 30) * most / n))
    pairs = T.ArrayType(struct_of(bucket=T.IntegerType(), n=T.LongType()))

    def make():
        def run(texts):
            out = []
            for text in texts:
                bucket, count = np.unique(word_trigrams([text])[0], return_counts=True)
                out.append([{"bucket": b, "n": c} for b, c in zip(bucket.tolist(), count.tolist())])
            return [pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))]

        return run

    grams = map_rows(marked, make, struct_of(lang=T.StringType(), grams=pairs), TEXT, ("lang",))
    grams = grams.select("lang", F.inline("grams")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows for each language.
    counts: dict[str, np.ndarray] = {}
    for r in grams.collect():
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return Languages(counts)


def identify(docs: DataFrame, model: Languages, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns id_col, lang_pred (a learnt language; "und" for a null text, one without letters, or if nothing was learnt)
    and score (its proportion, 0 to 1; 0 for "und"), one row for each input row. Equal proportions go to the language whose
    name is least. Rows that repeat an id are predicted each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts):
            return list(shared.value.identify(texts))

        return run

    df = narrow(docs, id_col, text_col)
    schema = struct_of(**{ID: df.schema[ID].dataType, "lang_pred": T.StringType(), "score": T.DoubleType()})
    return map_rows(df, make, schema, TEXT, (ID,)).withColumnRenamed(ID, id_col)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
