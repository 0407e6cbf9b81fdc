import random
import re
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from marketlens.plans import contexts, evidence, explain, followups, routing
from marketlens.plans.investigate import month_key_text
from tests.fixtures import evidence_table

EXPECTED = {
    "Show me the main business KPIs.": "core_kpis",
    "How has monthly revenue changed?": "monthly_revenue_trend",
    "Which product categories make the most revenue?": "revenue_by_category",
    "Which states generate the most revenue?": "revenue_by_state",
    "Which state has the worst delivery performance?": "delivery_by_state",
    "How do late deliveries affect review scores?": "late_vs_on_time",
    "Why did monthly revenue decline?": "revenue_change_investigation",
    "What will revenue be next year?": "unsupported",
    "Predict customer churn next year.": "unsupported",
    "  \t": "unsupported",
}


@pytest.fixture(scope="module")
def answers(spark):
    questions = spark.createDataFrame([(q,) for q in EXPECTED], "question string")
    answered = evidence.answer_questions(evidence_table(spark), questions, 1)
    return {r.question: r for r in answered.collect()}


def test_routes(spark):
    questions = spark.createDataFrame([(q,) for q in EXPECTED], "question string")
    rows = routing.route_questions(questions).collect()
    assert {r.question: r.analysis_type for r in rows} == EXPECTED
    assert all(routing.route_text(r.normalized_question) == r.analysis_type for r in rows)
    assert {r.matched_rule for r in rows if not r.normalized_question} == {"empty_question"}


def test_every_question_gets_one_answer(answers):
    assert {q: r.analysis_type for q, r in answers.items()} == EXPECTED
    for r in answers.values():
        assert r.methodology["router_rule"] == r.matched_rule
        assert r.supported == (r.analysis_type != "unsupported")


def test_category_leader(answers):
    r = answers["Which product categories make the most revenue?"]
    assert r.metrics["leading_category"] == "electronics"
    assert r.metrics["leading_category_revenue"] == "450.00"
    assert len(r.supporting_rows) == 3


def test_review_gap(answers):
    r = answers["How do late deliveries affect review scores?"]
    assert r.metrics["late_average_review_score"] == "1.50"
    assert r.metrics["on_time_average_review_score"] == "4.50"
    assert r.metrics["review_score_gap"] == "3.00"
    assert r.warnings


def test_unsupported_question_has_no_rows(answers):
    r = answers["Predict customer churn next year."]
    assert (r.supported, r.supporting_rows, r.metrics) == (False, [], {})


def test_too_few_months_and_missing_groups(spark):
    table = evidence_table(spark).filter("purchase_month_start = '2024-02-01' AND NOT is_late_delivery")
    questions = spark.createDataFrame([(q,) for q in EXPECTED], "question string")
    rows = evidence.answer_questions(table, questions, 1).collect()
    by_type = {r.analysis_type: r for r in rows if r.question.strip()}
    assert by_type["revenue_change_investigation"].error
    assert not by_type["revenue_change_investigation"].supported
    assert by_type["monthly_revenue_trend"].metrics == {}
    assert len(by_type["monthly_revenue_trend"].supporting_rows) == 1
    assert by_type["late_vs_on_time"].metrics == {}
    empty = evidence.answer_questions(table.limit(0), questions, 1).collect()
    assert {r.analysis_type for r in empty if r.supporting_rows} == {"core_kpis"}


def test_explanations(spark, answers):
    questions = spark.createDataFrame([(q,) for q in EXPECTED], "question string")
    rows = explain.explanations(
        evidence.answer_questions(evidence_table(spark), questions, 1)
    ).collect()
    for r in rows:
        if r.supported:
            assert r.explanation is None
            assert r.prompt.startswith(f"Question asked:\n\n{r.question}")
            assert '"analysis_type" : "' + r.analysis_type in r.prompt
        else:
            assert r.prompt is None
            assert r.summary in r.explanation and r.warnings[0] in r.explanation
            assert [r.explanation.find(t) >= 0 for t in explain.SECTIONS] == [True] * 4


def test_display(spark):
    text = (
        "direct answer: up $5 【metric:a】 , `[row:1]`\n\n\n\n### Key evidence\nx  \t y [method:k]\n"
        "**Limitations**: \\$3"
    )
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(explain.display_markdown(F.col("t"))).first()[0] == (
        "**Direct answer**\n\nup \\$5, \n\n**Key evidence**\n\nx y \n**Limitations**\n\n\\$3"
    )


def test_citations(spark):
    df = spark.createDataFrame(
        [
            (
                "[metric:a] [metric:b] 【row:1】 [row:2] [row:x] [warning:1] [method:m]",
                {"a": "1"},
                ["{}"],
                {"m": "k"},
                ["w"],
            )
        ],
        "explanation string, metrics map<string,string>, supporting_rows array<string>, "
        "methodology map<string,string>, warnings array<string>",
    )
    rows = explain.citations(df).orderBy("position").collect()
    assert [r.is_known for r in rows] == [True, False, True, False, False, True, True]


def star_schema(spark, folder):
    """Small tables as the adapter reads them; all months have more orders than the evidence asks for."""
    orders = spark.range(600).selectExpr(
        "id AS o_orderkey",
        "id % 40 AS o_custkey",
        "if(id % 9 = 0, 'P', 'F') AS o_orderstatus",
        "CAST(100 + id AS double) AS o_totalprice",
        "timestamp_ntz '1998-01-05 10:00:00' + make_interval(0, CAST(id % 3 AS int)) AS o_orderdate",
    )
    lineitem = spark.range(1500).selectExpr(
        "id % 600 AS l_orderkey",
        "id % 30 AS l_partkey",
        "id % 7 AS l_suppkey",
        "CAST(id % 7 + 1 AS int) AS l_linenumber",
        "CAST(id % 50 + 1 AS double) AS l_quantity",
        "CAST(10 + id % 90 AS double) AS l_extendedprice",
    )
    customer = spark.range(40).selectExpr(
        "id AS c_custkey", "concat('C', id) AS c_name", "'A' AS c_mktsegment", "id % 3 AS c_nationkey"
    )
    nation = spark.range(3).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name")
    part = spark.range(30).selectExpr("id AS p_partkey", "if(id % 2 = 0, 'LARGE', 'OTHER') AS p_type")
    for name, df in dict(orders=orders, lineitem=lineitem, customer=customer, nation=nation, part=part).items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_cited_answers_meet_their_texts_without_shuffling_evidence(spark, tmp_path):
    import __spark_entry__ as registered

    folder = star_schema(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cited = registered.queries()["EX4_citations"](spark, folder)
        plan = spark._jvm.PythonSQLUtils.explainString(cited._jdf.queryExecution(), "formatted")
        dealt = re.findall(r"(?m)^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan)
        assert any("question#" in columns for columns in dealt)
        assert not [columns for columns in dealt if "supporting_rows#" in columns or "metrics#" in columns]
        rows = cited.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    answers = registered.queries()["EV11_answers"](spark, folder).filter("supported")
    # The template has eight references in known forms.
    per_answer = {}
    for row in rows:
        per_answer.setdefault(row.question_id, []).append(row)
    assert set(per_answer) == {r.question_id for r in answers.collect()} and per_answer
    assert {tuple(r.position for r in found) for found in map(sorted, per_answer.values())} == {tuple(range(8))}


def sequential(turns, months):
    """What a person-by-person pass over each conversation would give."""
    out, last = [], {}
    for conv, turn, text in sorted(turns):
        question = text.strip()
        resolved = question
        if conv in last and LEANS[text]:
            resolved = followups.rewrite(question, *FEATURES[text], *last[conv])
        kind = routing.route_text(" ".join(resolved.lower().split()))
        answered = kind != "unsupported" and (
            kind != "revenue_change_investigation" or month_key_text(resolved) in months
        )
        if answered:
            last[conv] = (resolved, kind)
        out.append((conv, turn, resolved, kind, answered))
    return out


TEXTS = [
    "Why did revenue drop in March 2024?",
    "Why did revenue drop in June 2024?",
    "Which states generate the most revenue?",
    "What about states?",
    "categories",
    "aov",
    "how about the order volume",
    "What about delivery",
    "and the reviews",
    "How about 2024-03?",
    "what drove that",
    "What about it?",
    "Tell me a joke",
    "   ",
    "Show the KPI overview",
]
LEANS, FEATURES = {}, {}


def _learn(spark, said):
    texts = spark.createDataFrame([(t,) for t in set(said)], "text string")
    for r in texts.select(
        "text",
        followups.needs_context(F.col("text")).alias("leans"),
        followups._topic(F.col("text")).alias("topic"),
        F.regexp_extract("text", f"(?i){followups.MONTH_REFERENCE}", 0).alias("month"),
    ).collect():
        LEANS[r.text], FEATURES[r.text] = r.leans, (r.topic, r.month)


def test_conversations_agree_with_a_sequential_pass(spark, monkeypatch):
    monkeypatch.setattr(followups, "CHUNK", 3)
    _learn(spark, TEXTS)
    chance = random.Random(7)
    turns = [
        (conv, turn, chance.choice(TEXTS))
        for conv in range(6)
        for turn in range(60 if conv == 0 else 12)
    ]
    months = ["ym:2024-03", "my:3-2024", "m:3", "decline"]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, question string")
    rows = followups.resolve_conversations(df, months).collect()
    found = sorted(
        (r.conv_id, r.turn, r.resolved_question, r.analysis_type, r.answered) for r in rows
    )
    assert found == sequential(turns, set(months))
    assert all(r.was_rewritten == (r.question != r.resolved_question) for r in rows)


def _texts_of_a_long_talk(chance, n):
    """Leaning turns only, after one question; what each becomes hangs on all before it."""
    said = ["Why did revenue drop in March 2024?"]
    for i in range(1, n):
        said.append(chance.choice(["What about states?", "categories", "How about 2024-03?", "aov", "what drove that",
                                   "How about \ue000 then", "What about it?", "What about sales in May 2024"]))
    return said


@pytest.mark.parametrize("first", ["Why did revenue drop in March 2024?", "categories", "Show the KPI overview"])
def test_one_long_conversation_of_leaning_turns_in_many_chunks(spark, monkeypatch, first):
    monkeypatch.setattr(followups, "CHUNK", 7)
    said = [first, *_texts_of_a_long_talk(random.Random(len(first)), 300)[1:]]
    _learn(spark, said)
    turns = [(1, 3 * turn, text) for turn, text in enumerate(said)] + [(2, 0, "states"), (2, 9, "aov")]
    months = ["ym:2024-03", "my:3-2024", "my:5-2024", "m:3", "decline"]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, question string")
    result = followups.resolve_conversations(df, months)
    found = sorted(
        (r.conv_id, r.turn, r.resolved_question, r.analysis_type, r.answered) for r in result.collect()
    )
    assert found == sequential(turns, set(months))
    # No row of a later chunk waits for the ones before it: chunks are keys of the last shuffle.
    assert "chunk" in result._jdf.queryExecution().executedPlan().toString()


def test_context_maps_compose_to_the_pass_over_all_turns():
    """Maps of chunks, found without the text before, against the same chunks after each text."""
    chance = random.Random(11)
    topics = [None, "cause", "state", "category", "order_value", "orders", "delivery", "reviews"]
    befores = [
        None, "Why did revenue drop in March 2024?", "Which states generate the most revenue?", "Show the KPI overview!",
        "How did sales change over time", "late deliveries and reviews 2023-11 \ue001", "Reason for the fall of income in May",
        "What caused the drop in sales, 2024-03 or May 2024?",
    ]
    months = frozenset(["ym:2024-03", "my:3-2024", "m:5", "decline"])
    step = followups._step(months)
    Row = namedtuple("Row", "question topic month")
    asked = ["about it", "and 2024-03?", "Why did sales drop", "revenue by state of May 2024", "\ue000 \ue002", "orders"]
    for _ in range(60):
        turns = [
            Row(chance.choice(asked), chance.choice(topics), chance.choice(["", "", None, "2024-03", "May 2024"]))
            for _ in range(chance.randrange(1, 7))
        ]
        quoted = [row._replace(question=contexts.quoted(row.question)) for row in turns]
        found = contexts.to_json(contexts.context_map(quoted, step, followups.month_of, months))
        for before in befores:
            text = before
            for row in turns:
                became = followups.rewrite(row.question, row.topic, row.month, text) if text else row.question
                kind = routing.route_text(" ".join(became.lower().split()))
                if kind != "unsupported" and (kind != "revenue_change_investigation" or month_key_text(became) in months):
                    text = became
            after = contexts.apply_map(found, before, followups.month_of, months)
            # Only the marks at the end of a text that stays as it is may differ; no turn reads them.
            assert (after and contexts.bare(after)) == (text and contexts.bare(text)), (before, turns)


def test_rewrites():
    rewrite = followups.rewrite
    drop = "Why did revenue drop in March 2024?"
    assert rewrite("states?", "state", "", drop, "revenue_change_investigation") == (
        "Which states contributed most to the revenue change in March 2024?"
    )
    assert rewrite("states?", "state", "", "Show KPIs.", "core_kpis") == (
        "Which states generate the most revenue?"
    )
    assert rewrite("2024-05?", None, "2024-05", "Show KPIs.", "core_kpis") == (
        "Show KPIs for 2024-05?"
    )
    assert rewrite("why is that", "cause", "", "Show KPIs.", "core_kpis") == (
        "What drove the result described by this question: Show KPIs?"
    )
    assert rewrite("it?", None, "", "Show KPIs.", "core_kpis") == "it?"
