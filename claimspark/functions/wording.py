"""Wording that decides how a claim is treated: families, labels, guards, tags, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions import text as X

# Wording of claim families, in the order in which they are tried, and the questions of each family.
FAMILIES = {
    "environmental": r"emission|carbon|co2|recycl|climate|energy|waste|sustainab|packaging|net.zero",
    "business_growth": r"revenue|growth|sales|customer|user|booking|profit|margin",
    "ai_capability": r"\bai\b|model|accura|autonom|machine learning|algorithm",
    "privacy_security": r"privacy|encrypt|security|personal data|breach",
}
OTHER_FAMILY, TARGET_FAMILY = "product_attribute", "future_target"
QUESTIONS = {
    "environmental": [
        "Is the stated change absolute or intensity-based?",
        "Which baseline period and value does the comparison use?",
        "Do both periods cover the same operations and reporting method?",
        "Which emissions or lifecycle components are included?",
    ],
    "business_growth": [
        "Is the growth organic or acquisition-driven?",
        "Are the compared periods comparable?",
        "Which metric is measured: revenue, bookings, users, or another?",
        "Do one-off contributions affect the figure?",
    ],
    "ai_capability": [
        "Which task and metric does the capability refer to?",
        "What population was it evaluated on, and was the data held out?",
        "How much human assistance is involved?",
        "What deployment restrictions apply?",
    ],
    "product_attribute": [
        "Which components does the attribute cover?",
        "Under which conditions does it hold, and what is excluded?",
        "Which test or certification covers the claim?",
    ],
    "privacy_security": [
        "Which data, processing, and threat model does the statement cover?",
        "What exceptions apply?",
        "Is this a stated policy or a verified implementation?",
    ],
    "future_target": [
        "Which metric, boundary, and deadline define the target?",
        "Which interim milestones are stated?",
        "Which source would resolve whether the target was met?",
    ],
}
# Wording of a rate, of a measure the company defined itself, of a part of the company.
RATE = r"(?i)%|\bper\s?cent|\bbasis\s+points?\b|\bbps\b|\bpercentage\b"
ADJUSTED = r"(?i)\b(?:adjusted|non[- ]?gaap|underlying|organic|pro[- ]?forma|normali[sz]ed|excluding|before\s+\w+|constant[- ]currency|same[- ]store|comparable|like[- ]for[- ]like)"
SUBSET = r"(?i)\b(?:acquired|segment|division|store|region|product line|business unit|brand)s?\b"
# The tags that a metric may be filed under, the most specific first.
TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "net revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"],
    "net income": ["NetIncomeLoss"],
    "net earnings": ["NetIncomeLoss"],
    "operating income": ["OperatingIncomeLoss"],
    "gross profit": ["GrossProfit"],
    "total assets": ["Assets"],
    "earnings per share": ["EarningsPerShareDiluted", "EarningsPerShareBasic"],
    "diluted earnings per share": ["EarningsPerShareDiluted"],
    "research and development": ["ResearchAndDevelopmentExpense"],
    "operating cash flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "quarterly dividend": ["CommonStockDividendsPerShareDeclared"],
}
# How firm a conclusion is.
FIRMNESS = {"insufficient": 0, "not_yet_resolvable": 0, "mixed": 1, "supported": 2, "contradicted": 2}
# A label written in two ways.
SAME_LABEL = {"Conflicting Evidence/Cherry-picking": "Conflicting Evidence/Cherrypicking"}
REPOSITORY = r"https?://(?:www\.)?(?:github|gitlab)\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"


def family(text: Column, metric: Column, future_target: Column) -> Column:
    """The family whose questions a claim gets: a target first, then the first family whose wording occurs."""
    both = F.lower(F.concat_ws(" ", text, metric))
    out = F.lit(OTHER_FAMILY)
    for name, pattern in reversed(FAMILIES.items()):
        out = F.when(both.rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(future_target, F.lit(False)), TARGET_FAMILY).otherwise(out)


def questions(of_family: Column) -> Column:
    """The questions of a family, in order."""
    out = F.array().cast("array<string>")
    for name, asked in QUESTIONS.items():
        out = F.when(of_family == name, F.array(*[F.lit(q) for q in asked])).otherwise(out)
    return out


def tags_of(metric: Column) -> Column:
    """The tags of a metric's wording: those of the longest phrase in it; none for wording that is not known."""
    said = F.lower(F.trim(F.coalesce(metric, F.lit(""))))
    out = F.array().cast("array<string>")
    for phrase in sorted(TAGS, key=len):
        out = F.when(said.contains(phrase), F.array(*[F.lit(t) for t in TAGS[phrase]])).otherwise(out)
    return out


def canonical(label: Column, same: dict[str, str] = SAME_LABEL) -> Column:
    """A label in its one spelling."""
    out = label
    for other, name in same.items():
        out = F.when(label == other, name).otherwise(out)
    return out


def plain_text(value: Column) -> Column:
    """Lower-cased, white space collapsed: two texts are the same if this is."""
    return X.squash(F.lower(F.coalesce(value, F.lit(""))))


def neutralized(text: Column, tag: str) -> Column:
    """The text with each opening or closing `tag` made harmless; escaping its bracket leaves none that could be read as the tag."""
    return F.regexp_replace(text, rf"(?i)<(/?{tag})", "&lt;$1")


def retention(protected: Column, text: Column) -> Column:
    """The share of an array of passages that a text holds exactly, white space aside; 1 without passages."""
    kept = F.size(F.filter(protected, lambda p: X.squash(text).contains(X.squash(p))))
    return F.when(F.size(protected) == 0, 1.0).otherwise(kept / F.size(protected))


def repositories(text: Column) -> Column:
    """Code repositories that a text links, each once, in order, without the ending .git or a full stop."""
    return F.array_distinct(F.transform(X.found(text, REPOSITORY), lambda u: F.regexp_replace(F.regexp_replace(u, r"[.]+$", ""), r"\.git$", "")))


def firmness(status: Column) -> Column:
    out = F.lit(0)
    for name, n in FIRMNESS.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def wants_firmer(decision: Column, narrowed: Column, status: Column) -> Column:
    """Whether a review asks for a firmer conclusion than was reached."""
    return F.coalesce((decision == "narrow") & narrowed.isNotNull() & (firmness(narrowed) > firmness(status)), F.lit(False))


def reviewed(decision: Column, narrowed: Column, status: Column) -> Column:
    """The status after a review: a rejection leaves too little, a narrowing only weakens."""
    weaker = (decision == "narrow") & narrowed.isNotNull() & (firmness(narrowed) < firmness(status))
    return F.when(decision == "reject", "insufficient").when(F.coalesce(weaker, F.lit(False)), narrowed).otherwise(status)
