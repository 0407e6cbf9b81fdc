"""Map questions to analyses, for a whole table of questions at once."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from marketlens.functions.text import bound, contains_any, normalize

CORE_KPIS = "core_kpis"
MONTHLY_TREND = "monthly_revenue_trend"
BY_CATEGORY = "revenue_by_category"
BY_STATE = "revenue_by_state"
DELIVERY_BY_STATE = "delivery_by_state"
LATE_VS_ON_TIME = "late_vs_on_time"
INVESTIGATION = "revenue_change_investigation"
UNSUPPORTED = "unsupported"

# The words that stand for a topic. A word counts wherever it occurs, also inside
# a longer word.
REVENUE = ("revenue", "sales", "money", "income")
CAUSE = (
    "why",
    "what drove",
    "what caused",
    "driver",
    "drivers",
    "contributed",
    "contribution",
    "reason",
    "reasons",
)
CHANGE = (
    "decline",
    "declined",
    "decrease",
    "decreased",
    "drop",
    "dropped",
    "fall",
    "fell",
    "increase",
    "increased",
    "growth",
    "change",
    "changed",
)
LATE = ("late", "delayed", "delay")
ON_TIME = ("on time", "on-time", "ontime")
REVIEW = ("review", "reviews", "rating", "ratings", "customer satisfaction")
GEOGRAPHY = ("state", "states", "region", "regions", "geography", "geographic")
DELIVERY = ("delivery", "late", "delay", "shipping", "fulfillment")
CATEGORY = ("category", "categories", "product category", "product categories")
TREND = (
    "month",
    "monthly",
    "trend",
    "growth",
    "over time",
    "changed",
    "change over time",
    "decline",
    "decrease",
    "increase",
)
OVERVIEW = (
    "kpi",
    "kpis",
    "key metrics",
    "business metrics",
    "overall metrics",
    "overview",
    "business overview",
    "summary of the business",
)


@dataclass(frozen=True)
class Route:
    """An analysis and the groups of words a question needs one word each of."""

    analysis_type: str
    rule: str
    needs: tuple

    def matches(self, normalized: str) -> bool:
        return all(any(word in normalized for word in words) for words in self.needs)


# The routes in the order they are tried and the names of their rules.
ROUTES = (
    Route(
        INVESTIGATION,
        "question requests drivers of a revenue change",
        (REVENUE, CAUSE, CHANGE + ("what drove", "what caused")),
    ),
    Route(
        LATE_VS_ON_TIME,
        "question compares late delivery with on-time delivery or reviews",
        (LATE, ON_TIME + REVIEW),
    ),
    Route(
        DELIVERY_BY_STATE,
        "question combines geography and delivery performance",
        (GEOGRAPHY, DELIVERY),
    ),
    Route(BY_CATEGORY, "question combines product category and revenue", (CATEGORY, REVENUE)),
    Route(BY_STATE, "question combines geography and revenue", (GEOGRAPHY, REVENUE)),
    Route(MONTHLY_TREND, "question combines revenue and time-based change", (REVENUE, TREND)),
    Route(CORE_KPIS, "question requests a business KPI overview", (OVERVIEW,)),
)
# Fixed values
EMPTY_RULE = "empty_question"
NO_RULE = "no supported deterministic route matched"


def route_index(normalized):
    """Position of the first matching route as a column, NULL if none matches."""
    index = F.lit(None).cast("int")
    for i, route in reversed(list(enumerate(ROUTES))):
        hit = F.lit(True)
        for words in route.needs:
            hit = hit & contains_any(normalized, words)
        index = F.when(hit, F.lit(i)).otherwise(index)
    return index


def _pick(index, values, otherwise):
    listed = F.array(*[F.lit(v) for v in values])
    return F.when(index.isNotNull(), F.get(listed, index)).otherwise(otherwise)


def route_questions(questions, question="question"):
    """Add normalized_question, analysis_type and matched_rule; no shuffle, no Python."""
    index = F.col("_route")
    blank = F.col("normalized_question") == ""
    return (
        questions.withColumn(
            "normalized_question", normalize(F.coalesce(F.col(question), F.lit("")))
        )
        .withColumn("_route", bound(F.col("normalized_question"), route_index))
        .withColumn(
            "analysis_type", _pick(index, [r.analysis_type for r in ROUTES], F.lit(UNSUPPORTED))
        )
        .withColumn(
            "matched_rule",
            _pick(
                index,
                [r.rule for r in ROUTES],
                F.when(blank, F.lit(EMPTY_RULE)).otherwise(F.lit(NO_RULE)),
            ),
        )
        .drop("_route")
    )


def route_text(normalized: str) -> str:
    """The analysis for one normalized text, for use inside a task."""
    return next((r.analysis_type for r in ROUTES if r.matches(normalized)), UNSUPPORTED)
