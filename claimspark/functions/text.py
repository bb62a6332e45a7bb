"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.operators.sizes import broadcast_if_small

# The word list and patterns that define puffery and specificity.
PUFFERY = [
    "amazing", "best", "best-in-class", "brilliant", "compelling", "cutting-edge", "exceptional", "excellent", "extraordinary", "fantastic",
    "flawless", "incredible", "industry-leading", "leading", "marquee", "outstanding", "phenomenal", "premier", "remarkable", "spectacular",
    "state-of-the-art", "superb", "superior", "terrific", "tremendous", "unmatched", "unparalleled", "unprecedented", "world-class",
]
SUPERLATIVE = r"^(most|best|greatest|largest|strongest|highest|fastest|[a-z]{4,}est)$"
DATE = r"(?i)\b(19|20)\d{2}\b|\bq[1-4]\b|\bfirst|second|third|fourth\s+quarter\b|\bfiscal\b|\bthis (quarter|year)\b|\bnext (quarter|year)\b"
BASELINE = r"(?i)\b(versus|vs\.?|compared (to|with)|against|up from|down from|year[- ]over[- ]year|sequentially|prior year|last year|a year ago|same period)\b"
VERIFIER = r"(?i)\b(certified|audited|verified|validated|ranked|rated|accredited)\s+by\b|\baccording to\b|\bas reported by\b|\bindependently\b"
CATEGORIES = ("Negative", "Positive", "Uncertainty", "Litigious", "Strong_Modal", "Weak_Modal", "Constraining")


def found(text: Column | str, pattern: str) -> Column:
    """All matches, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column | str) -> Column:
    """ASCII words with inner hyphens."""
    return found(text, "[A-Za-z][A-Za-z-]*")


def token_set(text: Column | str, pattern: str) -> Column:
    return F.array_distinct(found(F.lower(text), pattern))


def passage_tokens(text: Column | str) -> Column:
    """The set by which two passages are compared."""
    return token_set(text, "[a-z]{4,}")


def match_tokens(text: Column | str) -> Column:
    """The set by which a claim is matched with a risk passage."""
    return token_set(text, "[a-z0-9]{3,}")


def index_tokens(text: Column | str) -> Column:
    """The set by which passages are searched."""
    return token_set(text, "[a-z0-9]+")


def per_hundred(hits: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * hits / total).otherwise(0.0)


def puffery_density(text: Column | str) -> Column:
    """Words per hundred that assert quality: in PUFFERY, or a superlative."""
    w = words(text)
    hits = F.filter(w, lambda x: F.lower(x).isin(PUFFERY) | F.lower(x).rlike(SUPERLATIVE))
    return per_hundred(F.size(hits), F.size(w))


def stated(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def specificity(text: Column, value=None, unit=None, period=None, denominator=None, population=None, metric=None) -> dict[str, Column]:
    """Six checkable things that a claim states or not, by its text and its structured fields (null where unknown)."""
    none = F.lit(None).cast("string")
    value, unit, period, denominator, population, metric = (none if c is None else c for c in (value, unit, period, denominator, population, metric))
    text = F.coalesce(text, F.lit(""))
    return {
        "number": F.concat_ws(" ", F.coalesce(value, F.lit("")), text).rlike(r"\d"),
        "unit": stated(unit),
        "date": stated(period) | text.rlike(DATE),
        "baseline": stated(denominator) | stated(population) | text.rlike(BASELINE),
        "metric": stated(metric),
        "verifier": text.rlike(VERIFIER),
    }


def specificity_score(axes: dict[str, Column]) -> Column:
    total = F.lit(0)
    for c in axes.values():
        total = total + c.cast("int")
    return total


def densities(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of each category per hundred words: id_col, words, and one column for each of the lexicon's categories.

    lexicon: (word, category), lower-cased; it is broadcast while it is small. Texts without words score 0.
    """
    categories = sorted(r["category"] for r in lexicon.select("category").distinct().collect())
    w = docs.select(id_col, F.explode_outer(F.transform(words(text_col), F.lower)).alias("word"))
    members = lexicon.groupBy("word").agg(F.collect_set("category").alias("categories"))
    hit = w.join(broadcast_if_small(members), "word", "left")
    counts = hit.groupBy(id_col).agg(F.count("word").alias("words"), *[F.count_if(F.array_contains("categories", c)).alias(c) for c in categories])
    return counts.select(id_col, "words", *[per_hundred(F.col(c), F.col("words")).alias(c) for c in categories])


def squash(text: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def family_key(quote: Column | str) -> Column:
    """The key of an observation: equal for quotes that differ only in case and punctuation."""
    return F.concat(F.lit("grp-"), F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(quote), r"(?U)\W+", " ")), 256), 1, 12))


def number_tokens(text: Column | str) -> Column:
    """Numbers as written, with thousands commas dropped and no dot at the end."""
    return F.transform(found(text, r"\d[\d,]*\.?\d*"), lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"\.$", ""))


def sentences(text: Column | str) -> Column:
    """A text cut after sentence ends that white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def packed(pieces: Column, limit: int = 800) -> Column:
    """Pieces joined by spaces, in order, into passages that are closed before they would pass the limit."""

    def put(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        return (
            F.when(F.size(done) == 0, F.array(piece))
            .when(F.length(last) + F.length(piece) > limit, F.concat(done, F.array(piece)))
            .otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), piece))))
        )

    return F.aggregate(pieces, F.array().cast("array<string>"), put)


def passages(text: Column | str, limit: int = 800) -> Column:
    """Plain text as passages: blocks between blank lines, a long one cut where a sentence ends and another begins, packed up to the limit."""
    blocks = F.split(F.col(text) if isinstance(text, str) else text, r"\n\s*\n")
    cut = lambda block: F.split(F.regexp_replace(squash(block), r"([.!?])\s+(?=[A-Z‘“\"(])", "$1\u0001"), "\u0001")
    return F.filter(F.flatten(F.transform(blocks, lambda b: packed(cut(b), limit))), lambda p: p != "")
