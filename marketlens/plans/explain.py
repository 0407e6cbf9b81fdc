"""Texts around an evidence record: refusals, prompts, display clean-up and citation checks."""

from pyspark.sql import functions as F

DEFAULT_LIMITATION = "The available analyses hold no evidence for this request."

# The four sections of an explanation.
SECTIONS = ("Direct answer", "Key evidence", "Business interpretation", "Limitations")


def unsupported_explanation(summary="summary", warnings="warnings"):
    """The explanation of an unsupported question, made without a model."""
    first_warning = F.coalesce(F.get(F.col(warnings), F.lit(0)), F.lit(DEFAULT_LIMITATION))
    bodies = (
        F.col(summary),
        F.lit("No supported analysis produced evidence for this question."),
        F.lit("The available analyses do not allow a reliable answer."),
        first_warning,
    )
    parts = [F.concat(F.lit(f"{title}:\n"), body) for title, body in zip(SECTIONS, bodies)]
    return F.concat_ws("\n\n", *parts)


EVIDENCE_FIELDS = (
    "question",
    "analysis_type",
    "supported",
    "summary",
    "metrics",
    "supporting_rows",
    "methodology",
    "warnings",
)


def explanation_prompt():
    """Question and evidence as the user prompt of a model job that runs elsewhere."""
    evidence = F.to_json(F.struct(*EVIDENCE_FIELDS), {"pretty": "true"})
    return F.concat(
        F.lit("Question asked:\n\n"),
        F.col("question"),
        F.lit("\n\nWhat the data shows, as JSON:\n\n"),
        evidence,
        F.lit("\n\nUse nothing but this evidence and name the part that each statement rests on."),
    )


def explanations(answers):
    """Answered questions with a ready `explanation` or else a `prompt` for a model job."""
    supported = F.col("supported")
    return answers.withColumn(
        "explanation", F.when(~supported & F.col("error").isNull(), unsupported_explanation())
    ).withColumn("prompt", F.when(supported, explanation_prompt()))


# How an explanation refers to its evidence, in either bracket style.
CITATION = r"(?i)[\[【]\s*(metric|row|method|warning):([^\]】]+)[\]】]"

_HEADING = rf"(?i)^[ \t]*(?:#{{1,6}}[ \t]*)?(?:\*\*)?({'|'.join(SECTIONS)})(?:\*\*)?[ \t]*:?[ \t]*"
_BEFORE_SIGN, _BLANKS = r"[ \t]+([,.;:!?])", r"[ \t]{2,}"


def _shown_line(line):
    """One line without citations and spare blanks; a section's title stands on its own."""
    plain = F.regexp_replace(line, f"`*{CITATION}`*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, _BEFORE_SIGN, "$1"), _BLANKS, " ")
    titles = F.create_map(*[F.lit(x) for title in SECTIONS for x in (title.lower(), title)])
    title = F.try_element_at(titles, F.lower(F.regexp_extract(plain, _HEADING, 1)))
    alone = F.concat(F.lit("**"), title, F.lit("**\n\n"), F.regexp_replace(plain, _HEADING, ""))
    return F.coalesce(alone, plain)


def display_markdown(c):
    """An explanation for readers, line by line; dollar signs don't begin a formula."""
    text = F.array_join(F.transform(F.split(c, "\n", -1), _shown_line), "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?<!\\)\$", r"\\\$")


def citations(explained, explanation="explanation"):
    """One row per citation of an explanation, with whether the evidence holds what it names.

    Rows and warnings are numbered from 1; metrics and methods are named by key.
    """
    whole = F.regexp_extract_all(F.col(explanation), F.lit(CITATION), F.lit(0))
    kind = F.lower(F.regexp_extract("citation", CITATION, 1))
    target = F.btrim(F.regexp_extract("citation", CITATION, 2))
    number = target.try_cast("int")
    known = (
        F.when(F.col("kind") == "metric", F.array_contains(F.map_keys("metrics"), F.col("target")))
        .when(F.col("kind") == "method", F.array_contains(F.map_keys("methodology"), F.col("target")))
        .when(F.col("kind") == "row", number.between(1, F.size("supporting_rows")))
        .otherwise(number.between(1, F.size("warnings")))
    )
    return (
        explained.select("*", F.posexplode(whole).alias("position", "citation"))
        .withColumn("kind", kind)
        .withColumn("target", target)
        .withColumn("is_known", F.coalesce(known, F.lit(False)))
    )
