"""Review runs as a stream of events with state: summaries, cancellation, late results, latest drafts; and their replay in batch.

Events (key, order, kind) of a key's runs: `start` opens a run, named by its order, and ends one that is open (superseded); `result` and
`failure` count for the open run and are dropped without one; `cancel` and `finish` end it; `draft` is a newer
version of the text, of which the last counts. A cancelled or superseded run, and one with failures, is partial.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key {key}, run long, event string, done long, failed long, dropped long, draft long, partial boolean"
STATE = "run long, open boolean, done long, failed long, dropped long, draft long, seen long"
ENDS = {"cancel": "cancelled", "finish": "finished"}


class RunProcessor(StatefulProcessor):
    """One row of state a key: its last run. A row goes out where a run ends, and for each late result."""

    def __init__(self, patience_ms: int | None = None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def _row(self, key, s: dict, event: str) -> tuple:
        partial = event != "finished" or s["failed"] > 0
        return (key[0], s["run"], event, s["done"], s["failed"], s["dropped"], s["draft"], partial)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["run", "open", "done", "failed", "dropped", "draft", "seen"]
        held = self.state.get() if self.state.exists() else (None, False, 0, 0, 0, None, None)
        s, out = dict(zip(names, held)), []
        every = pd.concat(list(rows)).sort_values("order")
        for order, kind in zip(every["order"].tolist(), every["kind"].tolist()):
            if s["seen"] is not None and order <= s["seen"]:
                continue  # a source that repeats itself changes nothing
            s["seen"] = order
            if kind == "start":
                if s["open"]:
                    out.append(self._row(key, s, "superseded"))
                s |= {"run": order, "open": True, "done": 0, "failed": 0, "dropped": 0, "draft": None}
            elif kind == "draft":
                s["draft"] = order
            elif kind in ENDS and s["open"]:
                s["open"] = False
                out.append(self._row(key, s, ENDS[kind]))
            elif kind in ("result", "failure"):
                if s["open"]:
                    s["done" if kind == "result" else "failed"] += 1
                elif s["run"] is not None:
                    s["dropped"] += 1
                    out.append(self._row(key, s, "dropped"))
        self.state.update(tuple(s[n] for n in names))
        if self.patience is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if s["open"]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = ["run", "open", "done", "failed", "dropped", "draft", "seen"]
        s = dict(zip(names, self.state.get()))
        if s["open"]:
            s["open"] = False
            self.state.update(tuple(s[n] for n in names))
            yield self._frame([self._row(key, s, "expired")])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "run", "event", "done", "failed", "dropped", "draft", "partial"])
        return out.astype({"draft": "Int64"})

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Summaries and late results of a stream (key, order, kind), in rows as OUT. A run that hears nothing for `patience_ms` expires.

    The session must keep state by spark.sql.streaming.stateStore.providerClass = ROCKS.
    """
    kind = events.schema["key"].dataType.simpleString()
    mode = "ProcessingTime" if patience_ms is not None else "None"
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=RunProcessor(patience_ms), outputStructType=OUT.format(key=kind), outputMode="Append", timeMode=mode)


def replay(events: DataFrame) -> DataFrame:
    """(key, run, status, done, failed, dropped, draft, partial) of every run of a finished log (key, order, kind).

    The same by windows over a key's events: a run is the events from its start to the next one; its first end parts counted results from
    dropped ones. Runs without an end are superseded, the last of a key open.
    """
    w = W.partitionBy("key").orderBy("order")
    run = F.last(F.when(F.col("kind") == "start", F.col("order")), ignorenulls=True).over(w)
    held = events.withColumn("run", run).where("run IS NOT NULL")
    end = F.min(F.when(F.col("kind").isin(*ENDS), F.struct("order", "kind"))).over(W.partitionBy("key", "run"))
    held = held.withColumn("end", end).withColumn("late", F.coalesce(F.col("order") > F.col("end.order"), F.lit(False)))
    result, failure = F.col("kind") == "result", F.col("kind") == "failure"
    runs = held.groupBy("key", "run").agg(
        F.first("end.kind").alias("end"), F.count_if(result & ~F.col("late")).alias("done"), F.count_if(failure & ~F.col("late")).alias("failed"),
        F.count_if((result | failure) & F.col("late")).alias("dropped"), F.max(F.when(F.col("kind") == "draft", F.col("order"))).alias("draft"),
    )
    last = F.col("run") == F.max("run").over(W.partitionBy("key"))
    status = F.when(F.col("end") == "cancel", "cancelled").when(F.col("end") == "finish", "finished").when(last, "open").otherwise("superseded")
    return runs.select("key", "run", status.alias("status"), "done", "failed", "dropped", "draft", ((status != "finished") | (F.col("failed") > 0)).alias("partial"))
