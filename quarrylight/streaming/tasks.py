"""Task states as a stream: a state a task, final ones stick, and tasks that say nothing for too long are told of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: States that nothing changes any more.
FINAL = ("completed", "failed", "cancelled")
HANGING = "hanging"
OUT = "task string, state string, at long, heard timestamp, version long"
HELD = "version long, last_at long, last_state string, final_at long, final_state string, heard long, due long"


class TaskStates(StatefulProcessor):
    """Keeps of each task its last state, its first final state, both by ``at``, and when it was last heard of; bounded, whatever is logged.

    Rows may come late, twice and in any order: what a task stands at depends only on the set of its rows.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("task", HELD)

    def _told(self, key: tuple, version: int, state: str, at: int, heard: int) -> pd.DataFrame:
        return pd.DataFrame({"task": [key[0]], "state": [state], "at": [at], "heard": [pd.Timestamp(heard, unit="us")], "version": [version]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, last_at, last, final_at, final, heard, due = self.held.get() or (0, None, None, None, None, 0, 0)
        for part in rows:
            ended = part[part["state"].isin(FINAL)]
            if len(ended) and (final_at is None or ended["at"].min() < final_at):
                first = ended.loc[ended["at"].idxmin()]
                final_at, final = int(first["at"]), first["state"]
            if last_at is None or part["at"].max() > last_at:
                newest = part.loc[part["at"].idxmax()]
                last_at, last = int(newest["at"]), newest["state"]
            heard = max(heard, int(part["ts"].max().value // 1000))
        if due:
            self.handle.deleteTimer(due)
        due = 0 if final else timerValues.getCurrentProcessingTimeInMs() + self.patience * 1000
        if due:
            self.handle.registerTimer(due)
        version += 1
        self.held.update((version, last_at, last, final_at, final, heard, due))
        yield self._told(key, version, final or last, final_at if final else last_at, heard)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, last_at, last, final_at, final, heard, _ = self.held.get()
        version += 1
        self.held.update((version, last_at, last, final_at, final, heard, 0))
        yield self._told(key, version, final or HANGING, last_at, heard)

    def close(self) -> None:
        pass


def standing(stream: DataFrame, patience: int = 3600) -> DataFrame:
    """task, state, at, heard, version: a row whenever a task's standing may have changed; its highest version counts.

    ``stream``: task, state, at (the order of its log), ts. A task that has not ended and of which no row came
    for ``patience`` seconds stands at ``hanging``, until it is heard of again. There is no horizon: rows count
    however late they come. Null tasks, states and times are left out.
    """
    rows = stream.select(F.col("task").cast("string").alias("task"), "state", F.col("at").cast("long").alias("at"), F.col("ts").cast("timestamp").alias("ts")).dropna()
    return rows.groupBy("task").transformWithStateInPandas(TaskStates(patience), OUT, "Update", "ProcessingTime")


#: A stream that ends with its data must not wait for timers: they are then looked at with each batch of rows.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def start(stream: DataFrame, sink: str, checkpoint: str, patience: int = 3600) -> StreamingQuery:
    """Takes what there is and writes every row of ``standing`` to the Parquet table ``sink``, a folder a batch: a batch that runs again replaces its own."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k) for k in SETTINGS}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        return standing(stream, patience).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def latest(told: DataFrame) -> DataFrame:
    """task, state, heard: where each task stands, of all rows that ``start`` wrote."""
    return told.groupBy("task").agg(F.max_by(F.struct("state", "heard"), "version").alias("x")).select("task", "x.*")
