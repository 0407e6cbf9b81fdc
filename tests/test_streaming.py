import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marketlens.plans import followups
from marketlens.session import new_table_path
from marketlens.streaming import conversations
from tests.test_questions import TEXTS

MONTHS = ["ym:2024-03", "my:3-2024", "m:3", "decline"]
SCHEMA = "conv_id bigint, turn bigint, question string"


@pytest.fixture
def resolved(spark):
    """Feed parts one after the other, each to a new run of the query on the same checkpoint."""
    conversations.use_state_store(spark)

    def feed(parts, ttl_ms=None):
        base = new_table_path(spark, "stream-test")
        for rows in parts:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
            turns = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
            conversations.run_available(turns, f"{base}/out", f"{base}/state", MONTHS, ttl_ms)
        return spark.read.schema(conversations.RESOLVED).parquet(f"{base}/out")

    return feed


def test_stream_with_restarts_equals_the_batch(spark, resolved):
    chance = random.Random(5)
    turns = [(conv, turn, chance.choice(TEXTS)) for turn in range(24) for conv in range(4)]
    found = resolved([turns[:31], turns[31:60], turns[60:]])
    batch = followups.resolve_conversations(spark.createDataFrame(turns, SCHEMA), MONTHS)
    assert sorted(found.drop("was_late").collect()) == sorted(batch.drop("was_rewritten").collect())
    assert found.filter("was_late").isEmpty()


def test_a_stream_is_packed_and_goes_on_from_a_state_that_was_packed_otherwise(spark):
    conversations.use_state_store(spark)
    assert spark.conf.get(conversations.STATE_PACKING) == "zstd"
    chance = random.Random(6)
    turns = [(conv, turn, chance.choice(TEXTS)) for turn in range(24) for conv in range(4)]
    base = new_table_path(spark, "packed-stream-test")
    for packing, rows in (("lz4", turns[:50]), ("zstd", turns[50:])):
        spark.conf.set(conversations.STATE_PACKING, packing)
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        conversations.run_available(arriving, f"{base}/out", f"{base}/state", MONTHS)
    files = glob.glob(f"{base.removeprefix('file://')}/out/*.parquet")
    groups = [pq.read_metadata(f).row_group(0) for f in files if pq.read_metadata(f).num_row_groups]
    assert {group.column(2).compression for group in groups} == {"ZSTD"}
    found = spark.read.schema(conversations.RESOLVED).parquet(f"{base}/out")
    batch = followups.resolve_conversations(spark.createDataFrame(turns, SCHEMA), MONTHS)
    assert sorted(found.drop("was_late").collect()) == sorted(batch.drop("was_rewritten").collect())


def test_a_late_turn_is_resolved_with_the_answer_before_it(resolved):
    first = [(1, 0, "Why did revenue drop in March 2024?"), (1, 10, "Show the KPI overview"), (1, 11, "aov")]
    found = resolved([first, [(1, 5, "What about states?"), (1, 12, "What about states?")]])
    rows = {r.turn: r for r in found.collect()}
    assert rows[5].resolved_question == "Which states contributed most to the revenue change in March 2024?"
    assert rows[12].resolved_question == "Which states generate the most revenue?"
    assert [t for t, r in sorted(rows.items()) if r.was_late] == [5]


def test_answers_are_forgotten(resolved):
    first = [(1, 0, "Why did revenue drop in March 2024?")]
    later = [(1, 1, "What about states?")]
    kept = resolved([first, later], ttl_ms=3_600_000).filter("turn = 1").first()
    gone = resolved([first, later], ttl_ms=1).filter("turn = 1").first()
    assert kept.resolved_question == "Which states contributed most to the revenue change in March 2024?"
    assert (kept.answered, gone.answered) == (True, False)
    assert gone.resolved_question == "What about states?"


class CountedState:
    """A state variable in memory that counts the messages it would send to the JVM."""

    def __init__(self, calls):
        self.calls, self.value, self.listed = calls, None, []

    def get(self):
        self.calls.append("get")
        return self.listed or self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def appendList(self, values):
        self.calls.append("append")
        self.listed = [*self.listed, *values]


class CountedHandle:
    def __init__(self):
        self.calls = []

    def getValueState(self, name, schema, ttl=None):
        return CountedState(self.calls)

    getListState = getValueState


def test_a_conversation_reads_and_writes_its_state_once_per_batch():
    turn_type = Row("conv_id", "turn", "question", "analysis_type", "leans", "answered", "topic", "month")
    handle = CountedHandle()
    processor = conversations.LastAnswers(MONTHS)
    processor.init(handle)
    turns = [turn_type(1, t, f"reviews {t}", "core_kpis", False, True, None, None) for t in range(500)]
    out = list(processor.handleInputRows((1,), iter(reversed(turns)), None))
    assert [row.turn for row in out] == list(range(500))
    assert sorted(handle.calls) == ["append", "get", "get", "update", "update"]
    # A late turn that leans is the only one for which the earlier answers are read.
    late = turn_type(1, 7, "What about it?", "unsupported", True, False, None, None)
    found = list(processor.handleInputRows((1,), iter([late]), None))
    assert [row.was_late for row in found] == [True]
    assert handle.calls[5:].count("get") == 3
