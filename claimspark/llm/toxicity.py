"""Toxicity with noisy-channel deobfuscation.

Words with a digit, symbol or repeated letter anywhere, and three or more characters set apart, become lattices: at each character the writer may have meant it, a letter it stands for, or nothing (a separator or a
repetition). A Viterbi search over the lattice under a character trigram model picks the likeliest
reading; elsewhere the lattice has one path, the text itself. The restored text is scored by
the words and word beginnings that mark toxic documents, calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, as_text, held_out, map_rows, narrow, place, plain_names, restored, slices, struct_of
from claimspark.llm.quality import training_sample
from claimspark.session import materialize, table

MAX_TRAIN = 16_000
THRESHOLD = 0.7
#: Features that mark toxic documents: the least documents, twice the log likelihood ratio (p is about 2e-5), log odds.
LEAST_DOCS, LEAST_G, LEAST_ODDS = 4, 18.0, 1.5
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log costs of the channel: a letter stood for, a character meant although it could stand for a letter, a repetition dropped, a repetition meant.
SWAP, KEEP_ODD, DROP_REPEAT, KEEP_REPEAT = -0.7, -3.0, -0.3, -0.7

SIGNS = "@$!|+(€"
ONE = rf"(?:[^\W_]|[{SIGNS}])"
#: Three or more characters set apart; what has no white space or separator in it; what makes the latter odd.
PART = r"[\s.,/\-_*]"
APART = re.compile(rf"(?<!{ONE}){ONE}(?:{PART}+{ONE}){{2,}}(?!{ONE})", re.UNICODE)
#: The second and third of such characters: where this is not found, there are none.
SECOND = re.compile(rf"{PART}{ONE}{PART}+{ONE}(?!{ONE})", re.UNICODE)
TOKEN = re.compile(rf"{ONE}+", re.UNICODE)
ODD = re.compile(r"[0-9@$!|+(€]|([^\W\d_])\1", re.UNICODE)
LETTER = re.compile(r"[^\W\d_]|@", re.UNICODE)
WORD = re.compile(r"[^\W\d_]+", re.UNICODE)


class Classes(dict):
    """Characters as the language model sees them: from U+0530 on, all of a block of 256 are one, so that the scripts of many
    thousand characters, which no substitute stands for, leave the table of trigrams small."""

    def __missing__(self, code: int) -> int:
        self[code] = found = code if code < 0x530 else 0xF0000 + (code >> 8)
        return found


CLASSES = Classes()


def trigrams(words: list[str]) -> Counter:
    """Character trigrams of words, each with two marks before and one after it."""
    by_count: dict[int, list[str]] = {}
    for w, n in Counter(words).items():
        by_count.setdefault(n, []).append(f"\x02\x02{w if w.isascii() else w.translate(CLASSES)}\x03")
    found: Counter = Counter()
    for n, marked in by_count.items():
        for gram, many in Counter([w[i : i + 3] for w in marked for i in range(len(w) - 2)]).items():
            found[gram] += n * many
    return found


def count_trigrams(docs: DataFrame) -> dict[str, int]:
    """Character trigrams of all words of (ID, TEXT), labelled or not."""

    def run(batches):
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, TEXT):
                for t in part.column(0).to_pylist():
                    words.update(WORD.findall((t or "").lower()))
                if len(words) > 100_000:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    def counted(words):
        grams = trigrams(words)
        return pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["gram", "n"])

    grams = docs.select(TEXT).mapInArrow(run, struct_of(gram=T.StringType(), n=T.LongType())).groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in grams.collect()}


class CharModel:
    """Interpolated character trigram log probabilities from trigram counts."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.tri_of, self.bi, self.bi_of, self.uni = Counter(), Counter(), Counter(), Counter()
        for g, n in counts.items():
            self.tri_of[g[:2]] += n
            self.bi[g[1:]] += n
            self.bi_of[g[1]] += n
            self.uni[g[2]] += n
        self.total = max(1, sum(self.uni.values()))
        self.cache: dict[str, float] = {}

    def logp(self, context: str, c: str) -> float:
        key = context + c
        p = self.cache.get(key)
        if p is None:
            p = 0.7 * self.tri.get(key, 0) / max(1, self.tri_of[context]) + 0.2 * self.bi[key[1:]] / max(1, self.bi_of[context[1]]) + 0.1 * (self.uni[c] + 0.1) / (self.total + 100)
            p = self.cache[key] = math.log(p)
        return p


def decode(span: str, model: CharModel) -> str:
    """The likeliest reading of a lower-cased span. A character that stays although it is no letter ends a word."""
    start = "\x02\x02"
    states: dict[str, tuple[float, tuple]] = {start: (0.0, ())}  # by the last two characters: score, reading as a linked list
    before = ""
    for c in span:
        if len(states) == 1 and c.isalpha() and c != before:
            # All paths so far share this letter's cost, so it decides nothing.
            ((context, (_, path)),) = states.items()
            states, before = {context[1] + (c if c.isascii() else c.translate(CLASSES)): (0.0, (path, c))}, c
            continue
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, KEEP_REPEAT if c == before else 0.0))
        elif c in LEET:
            options += [(x, SWAP) for x in LEET[c]] + [(c, KEEP_ODD)]
        elif c.isdigit():
            options.append((c, 0.0))
        else:
            options.append(("", 0.0))  # a separator inside the span
            if before and not before.isalnum() and before not in LEET:
                options.append((" ", 0.0))  # several of them may part two words
        if c == before:
            options.append(("", DROP_REPEAT))
        new: dict[str, tuple[float, tuple]] = {}
        for context, (score, path) in states.items():
            for x, cost in options:
                s = score + cost
                if not x:
                    to = context
                elif x.isalpha():
                    seen = x if x.isascii() else x.translate(CLASSES)
                    to, s = context[1] + seen, s + model.logp(context, seen)
                else:
                    to, s = start, s + ended(context, model)
                if to not in new or s > new[to][0]:
                    new[to] = (s, (path, x) if x else path)
        states, before = new, c
    path = max(((s + ended(k, model), k, p) for k, (s, p) in states.items()), key=lambda x: x[:2])[2]
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def ended(context: str, model: CharModel) -> float:
    """The log probability that a word ends; 0 where none has begun."""
    return 0.0 if context == "\x02\x02" else model.logp(context, "\x03")


def plain(span: str) -> bool:
    """Whether a span of a token or of characters set apart has no lattice to search: neither a substitute nor a repeated
    letter, or a number, price or row of one sign, without a letter."""
    if LETTER.search(span):
        return not ODD.search(span)
    return any(c.isdigit() for c in span) or len(set(span) & set(LEET)) < 2


class Readings(dict):
    """Readings of tokens that hold a substitute or a doubled letter."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> str:
        found = token if plain(token) else decode(token, self.model)
        if len(token) < 64:
            if len(self) > 100_000:
                self.clear()
            self[token] = found
        return found


class Restorer:
    def __init__(self, model: CharModel):
        self.model, self.readings = model, Readings(model)

    def __reduce__(self):
        return Restorer, (self.model,)

    def apart(self, m: re.Match) -> str:
        span = m.group()
        return decode(span, self.model) if LETTER.search(span) or not plain(span) else span

    def restore(self, text: str) -> str:
        """The lower-cased text with the reading of every span that has a lattice; one pass, whatever a token's length."""
        text = text.lower()
        if SECOND.search(text):
            text = APART.sub(self.apart, text)
        parts, done, odd = [], 0, ODD.search(text)
        while odd:
            start = odd.start()
            while start > done and (text[start - 1].isalnum() or text[start - 1] in SIGNS):
                start -= 1
            end = TOKEN.match(text, start).end()
            parts += text[done:start], self.readings[text[start:end]]
            done, odd = end, ODD.search(text, end)
        return "".join(parts) + text[done:]


def features(word: str) -> list[str]:
    """A word and its beginnings of 4 and 5 letters, if it is longer."""
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)]


class Model:
    """Log odds of marking features, grouped by their first letters for a fast search."""

    def __init__(self, odds: dict[str, float], counts: dict[str, int]):
        self.odds = odds
        self.heads = {f.rstrip("*")[:4] for f in odds}
        self.restorer = Restorer(CharModel(counts))

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The strongest marking word's log odds and the logarithm of one and the sum of all."""
        if not text:
            return 0.0, 0.0
        heads, odds = self.heads, self.odds
        words = {w for w in set(WORD.findall(self.restorer.restore(text))) if w[:4] in heads}
        found = [max((odds.get(f, 0.0) for f in features(w)), default=0.0) for w in words]
        return max(found, default=0.0), math.log1p(math.fsum(found))


def with_evidence(docs: DataFrame, model: Model, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts):
            found = [shared.value.evidence(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    schema = T.StructType([docs.schema[k] for k in keep] + struct_of(__first=T.DoubleType(), __all=T.DoubleType()).fields)
    return map_rows(docs, make, schema, text_col, keep)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN):
    """docs: ID and TEXT. Returns the model and its calibration (intercept, two weights). Copies of a text count once."""
    sample = training_sample(docs, labels, "toxic", 3, 1, most).where(F.length(TEXT) > 0)
    sample = sample.groupBy(TEXT).agg(F.max("label").alias("label"), F.min(ID).alias(ID))
    sample = materialize(sample.repartition(16, ID), "toxicity-sample")
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = seen.get(1.0, 0), seen.get(0.0, 0)
    if not toxic or not clean:
        return Model({}, {}), (4.0 if toxic else -4.0, 0.0, 0.0)

    counts = count_trigrams(docs)
    restorer = sample.sparkSession.sparkContext.broadcast(Restorer(CharModel(counts)))

    def find_features():
        def run(texts):
            return [[sorted({f for w in set(WORD.findall(restorer.value.restore(t or ""))) for f in features(w)}) for t in texts]]

        return run

    found = map_rows(sample, find_features, struct_of(label=T.DoubleType(), features=T.ArrayType(T.StringType())), TEXT, ("label",))
    t, n = F.col("t"), F.col("n")
    expected = (t + n) * (toxic / (toxic + clean))
    g = 2 * (t * F.log(t / expected) + F.when(n > 0, n * F.log(n / (t + n - expected))).otherwise(0.0))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1))
    marks = (
        found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("n"))
        .where(t >= LEAST_DOCS).select("feature", g.alias("g"), odds.alias("odds")).where((F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))  # of the bounded sample
    )
    model = Model({r["feature"]: r["odds"] for r in marks.collect()}, counts)
    rows = with_evidence(sample, model, TEXT, ("label", ID)).repartition(1).sortWithinPartitions(ID).select("label", "__first", "__all")
    rows = materialize(rows, "toxicity-evidence")
    rows = VectorAssembler(inputCols=["__first", "__all"], outputCol="features").transform(rows)
    fit = LogisticRegression(labelCol="label", regParam=0.001, maxIter=100).fit(rows)
    return model, (float(fit.intercept), *map(float, fit.coefficients.toArray()))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for toxicity after deobfuscation.

    Returns all columns of docs (a column that has a new name already is replaced) and held_out, score (0 to 1),
    predicted (1 if score >= THRESHOLD). Null and empty texts have no evidence and get the calibration's base score.
    Learns marking words from at most MAX_TRAIN labelled rows that are not held out, and trigrams from all texts; a
    score's other inputs are the text only.
    Rows that repeat an id are scored each; a label without a document is ignored.
    """
    model, (base, first, every) = train(narrow(docs, id_col, text_col), labels)
    mine, text = plain_names(docs), place(docs, text_col)
    scored = with_evidence(as_text(mine, text), model, text, tuple(mine.columns))
    score = 1.0 / (1.0 + F.exp(-(F.lit(base) + F.lit(first) * F.col("__first") + F.lit(every) * F.col("__all"))))
    scored = scored.select(*mine.columns, held_out(place(docs, id_col), 3, 1).alias("held_out"), score.alias("score"))
    return restored(scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), docs, "held_out", "score", "predicted")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text")
