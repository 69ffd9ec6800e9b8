"""The fold of event streams into answers, as a stream: runs are kept apart, in any order and cut of their events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: State that is keyed within a run lives in this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Events of a run that lie in one entry of its state.
ENTRY = 1000
FOLDED = "run_id {run}, answer string, model string, n long, ended boolean, closed boolean, version long"


def fold(events: dict[int, tuple[str | None, str | None]]) -> tuple[str, str | None, int, bool]:
    """(answer, model, n, ended) of a run's events (type, text) by number: see scorecard.fold_events."""
    end = min((s for s, (kind, _) in events.items() if kind == "done"), default=None)
    told = sorted(s for s in events if end is None or s < end)
    reset = max((s for s in told if events[s][0] == "answer_reset"), default=-1)
    answer = "".join(events[s][1] or "" for s in told if s > reset and events[s][0] in ("token", "response"))
    models = [events[s][1] for s in told if events[s][0] == "model"]
    return answer, models[-1] if models else None, len(told), end is not None


class RunFold(StatefulProcessor):
    """A run's events until none has come for `idle_ms` of event time; then it is closed and they go.

    Each batch that brings a run new events gives its fold so far, numbered by version. Events that come again (with
    a number that is known), and whatever comes for a closed run, change nothing. State is read and written by entries.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("entries", "entry long", "seqs array<long>, types array<string>, texts array<string>")
        self.state = handle.getValueState("state", "version long, closed boolean")

    def _held(self) -> tuple[int, dict[int, tuple[str | None, str | None]]]:
        """The number of entries, and the events (type, text) by number."""
        entries, events = 0, {}
        for _, (seqs, kinds, texts) in self.events.iterator():
            entries += 1
            events.update(zip(map(int, seqs), zip(kinds, texts, strict=True), strict=True))
        return entries, events

    def _row(self, key, closed: bool, events: dict) -> pd.DataFrame:
        held = self.state.get()
        version = (held[0] if held else 0) + 1
        self.state.update((version, closed))
        return pd.DataFrame([(key[0], *fold(events), closed, version)], columns=["run_id", "answer", "model", "n", "ended", "closed", "version"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, latest = self.state.get(), None
        if held and held[1]:
            for _ in rows:
                pass
            return
        entries, events = self._held()
        fresh = {}
        text = lambda x: x if isinstance(x, str) else None
        for frame in rows:
            latest = max(frame["at"].max(), latest or frame["at"].max())
            for seq, kind, said in zip(frame["seq"], frame["type"], frame["text"], strict=True):
                if int(seq) not in events:
                    events[int(seq)] = fresh[int(seq)] = (text(kind), text(said))
        seqs = list(fresh)
        for lo in range(0, len(seqs), ENTRY):
            part = seqs[lo : lo + ENTRY]
            self.events.updateValue((entries + lo // ENTRY,), (part, *(list(x) for x in zip(*(fresh[s] for s in part), strict=True))))
        if fresh:
            timers = list(self.handle.listTimers())
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([*timers, int(latest) + self.idle_ms]))
            yield self._row(key, False, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._row(key, True, self._held()[1])
        self.events.clear()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, idle_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame of events(run_id, seq, type, text, ts) as rows of FOLDED, for output mode update.

    The row of a run with the largest version holds its fold over all its events so far. Rows without run_id, seq or ts
    belong to no run. Sessions need the state store named in STORE.
    """
    rows = events.where("run_id is not null and seq is not null and ts is not null").select("run_id", F.col("seq").cast("long").alias("seq"), "type", "text", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_millis("ts"))
    kind = events.schema["run_id"].dataType.simpleString()
    return rows.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(RunFold(idle_ms), FOLDED.format(run=kind), "Update", "EventTime")


def fold_to(events: DataFrame, target: str, checkpoint: str, **kw) -> StreamingQuery:
    """Starts the fold of all events there are now; each batch's rows go to a folder of their own below target.

    A batch that is run again after a failure replaces its folder, so target holds each version of a run once.
    """
    spark = events.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        out = fold_stream(events, **kw).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return out.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}")).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def folded(spark: SparkSession, target: str) -> DataFrame:
    """(run_id, answer, model, n, ended, closed): the latest fold of each run below target."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(target)
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("version")))
    return rows.withColumn("k", newest).where("k = 1").select("run_id", "answer", "model", "n", "ended", "closed")
