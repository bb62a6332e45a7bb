"""Quality classification by a sparse rule ensemble.

Statistics of each whole text are the inputs. A small random forest is grown on labelled
documents; every path from a root to a node is a rule, a conjunction of comparisons. A lasso
logistic regression over the rules keeps few of them, and the kept rules are compiled into one Spark
column expression over the statistics, which scores the corpus inside the JVM.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import islice
from operator import and_, eq

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import ID, TEXT, as_text, held_out, map_rows, narrow, place, plain_names, restored, struct_of
from claimspark.session import materialize, table

#: The most labelled documents that the model is fitted on, drawn by a hash of the id.
MAX_TRAIN = 16_000
TREES, DEPTH, LASSO, SEED = 16, 4, 0.0005, 7
#: A document is of good quality from this score on.
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "word_length", "log_longest_word", "line_words", "upper", "digit", "symbol", "punctuation", "bars", "space", "wide",
    "distinct_words", "repeated_words", "distinct_lines", "title_words",
)

CLASS = {
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "symbol": [ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~/!"],
    "punctuation": [ord(c) for c in ".,;:?'\"()-"],
    "bars": [ord("|")],
    "space": [9, 10, 11, 12, 13, 32],
    "wide": list(range(128, 256)),
}


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one text; zeros for a null or empty one. Shares are of bytes, words or lines."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w = len(raw), max(1, len(words))
    lengths = list(map(len, words))
    share = {k: float(counts[v].sum()) / n for k, v in CLASS.items()}
    return [
        float(np.log1p(len(words))), sum(lengths) / w, float(np.log1p(max(lengths, default=0))), w / len(lines), *share.values(),
        len(set(words)) / w, sum(map(eq, words, islice(words, 1, None))) / w, len(set(lines)) / len(lines), sum(map(str.istitle, words)) / w,
    ]


def with_statistics(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and one double column for each of STATISTICS, prefixed with s_."""

    def make():
        def run(texts):
            rows = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            return list(rows.T)

        return run

    schema = T.StructType([docs.schema[k] for k in keep] + struct_of(**{f"s_{s}": T.DoubleType() for s in STATISTICS}).fields)
    return map_rows(docs, make, schema, text_col, keep)


Rule = tuple[tuple[str, str, float], ...]


def rules_of(description: str) -> list[Rule]:
    """Every path of the trees in a forest's printed form, as a conjunction of (statistic, <= or >, threshold)."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    rules: set[Rule] = set()
    for line in description.split("\n"):
        depth = len(line) - len(line.lstrip())
        if "Tree" in line:
            path = []
        elif m := re.search(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            path = [p for p in path if p[0] < depth] + [(depth, (f"s_{STATISTICS[int(m[1])]}", m[2], float(m[3])))]
            rules.add(simplified([p[1] for p in path]))
    return sorted(rules)


def simplified(tests: list[tuple[str, str, float]]) -> Rule:
    """The tightest bound for each statistic and direction."""
    bounds: dict[tuple[str, str], float] = {}
    for name, op, value in tests:
        old = bounds.get((name, op), value)
        bounds[name, op] = min(old, value) if op == "<=" else max(old, value)
    return tuple(sorted((name, op, value) for (name, op), value in bounds.items()))


def holds(rule: Rule) -> Column:
    return reduce(and_, [F.col(name) <= value if op == "<=" else F.col(name) > value for name, op, value in rule])


class RuleEnsemble:
    """Weighted rules; score() is a column expression over the statistics."""

    def __init__(self, intercept: float, weights: list[tuple[Rule, float]]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame) -> RuleEnsemble:
    """Fit on a bounded table of statistics and a label column (0 or 1). Without both labels the score is the labels' mean, or 0.5 without labels."""
    seen = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(seen) < 2:
        only = next(iter(seen), None)
        return RuleEnsemble({None: 0.0, 0.0: -4.0, 1.0: 4.0}[only], [])
    columns = [f"s_{s}" for s in STATISTICS]
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=SEED).fit(data)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleEnsemble(float(np.log(seen[1.0] / seen[0.0])), [])
    fired = labelled.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("rules"))
    from pyspark.ml.functions import array_to_vector

    fired = fired.select("label", array_to_vector("rules").alias("features"))
    model = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=80).fit(fired)
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """At most about `most` labelled documents that are not held out, as (ID, TEXT, label): one for each labelled id
    (the least text of rows that repeat it), drawn by a hash of the id."""
    marked = labels.select(F.col("doc_id").alias(ID), F.col(label).cast("double").alias("label")).where("label is not null").where(~held_out(ID, modulus, remainder))
    marked = marked.groupBy(ID).agg(F.max("label").alias("label"))
    n = marked.count()
    if n > most:
        marked = marked.where(F.pmod(F.xxhash64(ID), F.lit(1 << 30)) < int((1 << 30) * most / n))
    # The sample has a bounded number of ids, 16 bytes each.
    return docs.join(F.broadcast(marked), ID).groupBy(ID, "label").agg(F.min(TEXT).alias(TEXT))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, most: int = MAX_TRAIN) -> RuleEnsemble:
    """docs: ID and TEXT. Rows whose id hashes to `remainder` are never learnt from."""
    sample = training_sample(docs, labels, label, modulus, remainder, most)
    rows = with_statistics(sample, TEXT, (ID, "label")).repartition(1).sortWithinPartitions(ID)  # bounded, and so the fit is repeatable
    return fit(materialize(rows, "quality-sample"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for quality.

    Returns all columns of docs (a column that has a new name already is replaced) and held_out, score (0 to 1),
    predicted (1 if score >= THRESHOLD). Null and empty texts have all-zero statistics and are scored like any other.
    Learns from at most MAX_TRAIN labelled rows that are not held out; the other inputs of a score are the text's statistics only.
    Rows that repeat an id are scored each; a label without a document is ignored.
    """
    model = train(narrow(docs, id_col, text_col), labels)
    mine, text = plain_names(docs), place(docs, text_col)
    scored = with_statistics(as_text(mine, text), text, tuple(mine.columns))
    scored = scored.select(*mine.columns, held_out(place(docs, id_col), 5, 0).alias("held_out"), model.score().alias("score"))
    return restored(scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), docs, "held_out", "score", "predicted")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns whatever their names."""
    mine = plain_names(docs)
    kept = classify(mine, labels, id_col=place(docs, id_col), text_col=place(docs, text_col)).where("predicted = 1")
    return restored(kept, docs)
