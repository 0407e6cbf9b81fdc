"""Follow-up questions of running conversations, as a stream: the twin of `plans.followups`."""

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marketlens.plans import contexts, followups

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PACKING = "spark.sql.streaming.stateStore.rocksdb.compression"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
RESOLVED = f"{followups.FOLDED}, was_late boolean"
RESOLVED_ROW = Row(*followups.COLUMNS, "was_late")
TURN = StructType([StructField("turn", LongType())])
TEXT = StructType([StructField("text", StringType())])


class LastAnswers(StatefulProcessor):
    """Per conversation, the last answered question and, for turns that come late, those before.

    Turns of a micro-batch are taken in order. A turn that comes after a later one of its
    conversation is resolved with the last answer before it that is still known; what has been
    sent out for later turns stays. Answers are forgotten `ttl_ms` after they were given.

    Every access to the state is a message to the JVM, so a conversation reads and writes once per
    micro-batch; the earlier answers are only read for a turn that comes late.
    """

    def __init__(self, months, ttl_ms=None):
        self.months, self.ttl_ms = None if months is None else frozenset(months), ttl_ms

    def init(self, handle):
        answer = StructType([*TURN.fields, *TEXT.fields])
        self.step = followups._step(self.months)
        self.newest_turn = handle.getValueState("newest_turn", TURN)
        self.newest = handle.getValueState("newest", answer, self.ttl_ms)
        self.answers = handle.getListState("answers", answer, self.ttl_ms)

    def _before(self, turn, newest, fresh):
        """The last answer before a turn, or None; of one turn's answers the one given last."""
        if newest is None or newest[0] < turn:
            return newest and newest[1]
        found = None
        for answer in (*self.answers.get(), *fresh):
            if answer[0] < turn and (found is None or found[0] <= answer[0]):
                found = answer
        return found and found[1]

    def handleInputRows(self, key, rows, timer_values):
        seen, newest = self.newest_turn.get(), self.newest.get()
        seen, newest = seen and seen[0], newest and tuple(newest)
        kept, fresh, out = newest, [], []
        for row in sorted(rows, key=lambda row: row.turn):
            text, kind, answered = row.question, row.analysis_type, row.answered
            last = self._before(row.turn, newest, fresh) if row.leans else None
            if row.leans:
                context = contexts.given(last, followups.month_of, self.months) if last else None
                form, became, answered = self.step(row, context)
                if form:
                    text = form[0].format(month=form[1], previous=contexts.bare(last))
                    kind = became.analysis_type()
            if answered:
                fresh.append((row.turn, text))
                if newest is None or newest[0] <= row.turn:
                    newest = (row.turn, text)
            late = seen is not None and row.turn < seen
            out.append(RESOLVED_ROW(row.conv_id, row.turn, row.question, text, kind, bool(answered), late))
        if fresh:
            self.answers.appendList(fresh)
        if newest != kept:
            self.newest.update(newest)
        if out and (seen is None or seen < out[-1].turn):
            self.newest_turn.update((out[-1].turn,))
        yield from out

    def close(self):
        pass


def resolve_stream(turns, months=None, ttl_ms=None):
    """The rows of `followups.resolve_conversations` and `was_late`, for a stream of turns.

    Everything that a turn says by itself is computed by column expressions; the state is keyed by
    conversation. With `ttl_ms` the state of a conversation goes that long after its last answer.
    The session needs the RocksDB state store (`use_state_store`); a restart from the checkpoint of
    the query goes on with the state as it was.
    """
    described = followups.described(turns, months)
    return described.groupBy("conv_id").transformWithState(
        LastAnswers(months, ttl_ms), RESOLVED, "Append", "None" if ttl_ms is None else "ProcessingTime"
    )


def use_state_store(spark):
    """States are full of texts that resemble each other, so they are packed with zstd.

    A state that was written with another packing is read as it is.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(STATE_PACKING, "zstd")


def run_available(turns, target, checkpoint, months=None, ttl_ms=None):
    """Resolve what has arrived since the last run and append it to the table at `target`.

    Batches without data are off meanwhile: with a time to live they would never end.
    """
    conf = turns.sparkSession.conf
    before = conf.get(_NO_DATA)
    conf.set(_NO_DATA, "false")
    try:
        query = (
            resolve_stream(turns, months, ttl_ms)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .option("compression", "zstd")
            .outputMode("append")
            .trigger(availableNow=True)
            .start(target)
        )
        query.awaitTermination()
    finally:
        conf.set(_NO_DATA, before)
