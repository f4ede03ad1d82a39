"""Jobs with a life cycle: queued, running, done, failed or expired, as state with timers keyed by job."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a job may do from where it is; what is left out is ignored, so a repeated or late message changes nothing.
MOVES = {None: {"queued"}, "queued": {"running", "failed"}, "running": {"running", "done", "failed"}, "done": set(), "failed": set(), "expired": set()}
STATE = "status string, since timestamp, progress double, kind string"
EVENTS = "job_id string, kind string, status string, at timestamp, progress double, result string"
OUT = "job_id string, kind string, status string, at timestamp, progress double, result string"


def moved(state: tuple | None, event: dict, kinds: set[str]) -> tuple[tuple | None, dict | None]:
    """The state after an event, and what is told of it (None if nothing changes). A queued job of an unknown kind fails."""
    status, since, progress, kind = state or (None, None, 0.0, event["kind"])
    wanted = event["status"]
    if wanted not in MOVES.get(status, set()):
        return state, None
    result = event["result"]
    if wanted == "queued" and event["kind"] not in kinds:
        wanted, result = "failed", f"no handler for {event['kind']}"
    progress = 1.0 if wanted == "done" else max(progress, event["progress"] or 0.0)
    new = (wanted, event["at"], progress, kind)
    return new, {"kind": kind, "status": wanted, "at": event["at"], "progress": progress, "result": result}


class JobProcessor(StatefulProcessor):
    """One job's state. A running job that says nothing for the time allowed expires by a timer."""

    def __init__(self, kinds: list[str], allowed_ms: int) -> None:
        self.kinds, self.allowed_ms = set(kinds), allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _told(self, key, told: list[dict]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame([{"job_id": key[0], **t} for t in told], columns=["job_id", "kind", "status", "at", "progress", "result"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, told = (tuple(self.state.get()) if self.state.exists() else None), []
        order = {"queued": 0, "running": 1, "done": 2, "failed": 3}
        events = pd.concat(list(rows)).to_dict("records")
        for event in sorted(events, key=lambda e: (e["at"], order.get(e["status"], 9))):
            event = {k: None if v is not None and not isinstance(v, str) and pd.isna(v) else v for k, v in event.items()}
            event["at"] = pd.Timestamp(event["at"]).to_pydatetime()
            state, said = moved(state, event, self.kinds)
            told += [said] if said else []
        if state is not None:
            self.state.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state[0] == "running":
                self.handle.registerTimer(int(pd.Timestamp(state[1], tz="UTC").timestamp() * 1000) + self.allowed_ms)
        yield from self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        if state and state[0] == "running":
            at = datetime.utcfromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
            self.state.update(("expired", at, state[2], state[3]))
            yield from self._told(key, [{"kind": state[3], "status": "expired", "at": at, "progress": state[2], "result": None}])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, kinds: list[str], allowed: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """job_id, kind, status, at, progress, result: a row for each change of a job's state, from a stream of EVENTS."""
    allowed_ms = int(pd.Timedelta(allowed).total_seconds() * 1000)
    keyed = events.filter("job_id is not null and at is not null").withWatermark("at", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(statefulProcessor=JobProcessor(kinds, allowed_ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def follow(spark: SparkSession, path: str, kinds: list[str], out: str, checkpoint: str, **times: str) -> StreamingQuery:
    """Follows JSON events added to a folder. States are in RocksDB below the checkpoint, and files are written exactly once, so
    a query that is stopped between two states goes on where it was."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    states = job_states(spark.readStream.schema(EVENTS).json(path), kinds, **times)
    return states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """job_id, kind, status, at, progress, result: where each job is."""
    return changes.groupBy("job_id").agg(F.max_by(F.struct("kind", "status", "at", "progress", "result"), F.col("at")).alias("x")).select("job_id", "x.*")
