"""Live runs: late answers apart, running summaries, the import queue's state, windows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from inkwell.operators import joins


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: States that the runs of an unordered cut-off share.
BUCKETS = 1024


def timing(latency: str, timeout: float) -> F.Column:
    return F.when(F.col(latency) > timeout, "late_after_timeout").otherwise("on_time")


def split_late(stream: DataFrame, timeout: float) -> tuple[DataFrame, DataFrame]:
    """What is scored, a late answer as a timeout without a text; and the trace of every answer, which changes no score."""
    marked = stream.withColumn("timing", timing("latency", timeout))
    late = F.col("timing") != "on_time"
    return marked.withColumn("status", F.when(late, "timeout").otherwise("success")).withColumn("score", F.when(~late, F.col("score"))).drop("timing"), marked


def running_summary(stream: DataFrame) -> DataFrame:
    """A summary a model after each batch (complete or update mode); the state is a row a model."""
    return stream.groupBy("model").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "success").alias("success"), F.sum(F.col("score").cast("decimal(18, 6)")).alias("score"))


def queue_state(stream: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's last value that is not null of every column; the state is a row a key."""
    return joins.latest(stream, key, order, values)


def until_errors(stream: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """A run's rows up to the one that reaches so many errors; the state is a number a run. Batches come in the run's order."""
    schema = stream.schema
    names = schema.names

    def go_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors = state.get[0] if state.exists else 0
        if errors < most:
            rows = pd.concat(frames).sort_values(order, kind="stable")
            wrong = (rows["status"] != "success").astype("int64")
            state.update((int(errors + wrong.sum()),))
            yield rows[errors + wrong.cumsum() - wrong < most][names]

    return stream.groupBy(by).applyInPandasWithState(go_on, schema, "errors long", "append", GroupStateTimeout.NoTimeout)


#: What may follow a state of a client's import; "" is the state before the first event. A client that has ended may be imported anew.
FOLLOWS = {
    "": ("discovered", "failed"),
    "discovered": ("documents_detected", "failed"),
    "documents_detected": ("downloaded", "failed"),
    "downloaded": ("label_normalized", "ready_without_label"),
    "label_normalized": ("ready",),
    "ready": ("discovered", "failed"),
    "ready_without_label": ("discovered", "failed"),
    "failed": ("discovered", "failed"),
}


def import_states(stream: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Every event with a verdict and the client's state after it: accepted, illegal or repeated.

    Only a legal event changes the state. An event whose number is not above the last one's that was seen
    is repeated; so is one without a number. The state is a text and a number for each client. Events of a client are
    taken by number within a batch; batches come in order.
    """
    schema = StructType([*stream.schema.fields]).add("verdict", "string").add("state", "string")
    names = stream.schema.names

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else ("", None)
        rows = pd.concat(frames).sort_values(order, kind="stable")
        verdicts, states = [], []
        for number, event in zip(rows[order].tolist(), rows[status].tolist(), strict=True):
            if pd.isna(number) or (last is not None and number <= last):
                verdicts.append("repeated")
            else:
                last = int(number)
                verdicts.append("accepted" if event in FOLLOWS[now] else "illegal")
                now = event if verdicts[-1] == "accepted" else now
            states.append(now)
        state.update((now, last))
        yield rows[names].assign(verdict=verdicts, state=states)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "state string, last long", "append", GroupStateTimeout.NoTimeout)


def to_parted_table(spark: SparkSession, stream: DataFrame, part: str, folder: str) -> DataFrame:
    """An appending stream as a table in folders by a column, each batch written once: its outputs are read apart."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy(part).parquet(f"{folder}/out/batch={number}")

    drain(spark, stream, "append", folder, keep)
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/*").select(stream.columns)


def until_errors_unordered(stream: DataFrame, by: str, order: str, time: str, late: str, most: int, buckets: int = BUCKETS) -> DataFrame:
    """``until_errors`` for rows that come in any order, at most ``late`` after the newest: a buffer by number, timers and a watermark.

    The rows that count, and those that came too late, by ``verdict``. Runs share ``buckets`` states, so that a batch
    costs a few calls of the state store for each bucket, whatever the number of runs and rows. State is kept in RocksDB; a
    session that names no state store gets that one.
    """
    spark = stream.sparkSession
    if STATE_STORE not in spark.conf.getAll:
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the time travels as microseconds: no time zone has a say in it
    waiting = StructType([f for f in stream.schema.fields if f.name != time]).add("due_", "long")
    processor = OrderedCutoff(waiting, by, order, most)
    out = StructType([*waiting.fields]).add("verdict", "string")
    rows = stream.withWatermark(time, late).withColumns({"due_": F.unix_micros(time), "bucket_": F.pmod(F.xxhash64(by), F.lit(buckets))})
    found = rows.groupBy("bucket_").transformWithState(processor, out, "append", "eventtime")
    return found.select(*[F.timestamp_micros("due_").alias(c) if c == time else c for c in stream.columns], "verdict")


def per_window(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts by model and window, with a watermark. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), "model").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "model", "n")


def drain(spark: SparkSession, stream: DataFrame, mode: str, folder: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(spark: SparkSession, stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """The stream's result: appended rows, or the last state of a complete or update stream."""
    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs twice writes its own folder again: exactly once
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    drain(spark, stream, mode, folder, keep)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/*")


class OrderedCutoff(StatefulProcessor):
    """Runs' rows in the order of a number, up to the one that reaches so many errors, whatever the order they come in.

    Rows wait in the state until the watermark has passed their time: then no earlier row can still come.
    They leave by number; one whose time has not come holds up those of its run behind it. A row that comes
    after a higher number has left is told by ``verdict`` late, and counts no more. Rows without a
    number come after the others that wait; those without a time don't wait.

    The state of a bucket of runs is a block of rows for each batch, and each run's last number and
    errors. One timer stands for the first row that can leave, not one for each row.
    """

    def __init__(self, kinds: StructType, by: str, order: str, most: int) -> None:
        self.names, self.most = kinds.names, most
        self.run, self.number, self.due, self.status = (kinds.names.index(c) for c in (by, order, "due_", "status"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.told = handle, Row(*self.names, "verdict")
        self.waiting = handle.getListState("waiting", "block binary")
        self.judged = handle.getValueState("judged", "runs binary")
        self.passed = handle.getValueState("passed", "watermark long")

    def milliseconds(self, row: tuple) -> int:
        """Up to the next whole one, so that no row leaves before its time; a row without a time waits for none."""
        return 0 if row[self.due] is None else -(-row[self.due] // 1000)

    def runs(self) -> dict:
        """Each run's last number and errors."""
        return pickle.loads(self.judged.get()[0]) if self.judged.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        runs = self.runs()
        new = [t for t in (tuple(r[c] for c in self.names) for r in rows) if runs.get(t[self.run], (None, 0))[1] < self.most]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(max(min(map(self.milliseconds, new)), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.passed.exists() and self.passed.get()[0] >= watermark:
            return  # another timer of this batch has let all go that can
        self.passed.update((watermark,))
        waiting: dict = {}
        for (block,) in self.waiting.get():
            for r in pickle.loads(block):
                waiting.setdefault(r[self.run], []).append(r)
        runs, stay, first, changed = self.runs(), [], [], False
        for run, rows in waiting.items():
            rows.sort(key=lambda r: (r[self.number] is None, r[self.number] or 0))
            last, errors = runs.get(run, (None, 0))
            n = 0
            while n < len(rows) and self.milliseconds(rows[n]) <= watermark:
                r, n = rows[n], n + 1
                number = r[self.number]
                if last is not None and number is not None and number < last:
                    yield self.told(*r, "late")
                elif errors < self.most:
                    yield self.told(*r, "counted")
                    last, errors = last if number is None else number, errors + (r[self.status] != "success")
            if n:
                runs[run], changed = (last, errors), True
            if n < len(rows) and errors < self.most:
                stay += rows[n:]
                first.append(self.milliseconds(rows[n]))
        if changed:
            self.judged.update((pickle.dumps(runs),))
        if stay:
            self.waiting.put([(pickle.dumps(stay),)])
            self.handle.registerTimer(min(first))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass
