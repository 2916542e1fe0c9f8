"""Live job state: progress that is emitted on change until a job ends, and a work queue whose leases run out.

Both keep jobs' states by buckets of jobs and act on a job's events in the order of their times, whatever batches they come in: an
event waits until the watermark has passed it, then what is due is taken in order of (time, id). A timer a bucket calls it up. State survives restarts in the stream's checkpoint. Events later than the watermark are dropped, as
everywhere; ``late`` says how late one may be.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docspark.operators.tables import written

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "job long, event_id long, ts timestamp, step string"
ACTIONS = "job long, ts timestamp, action string, attempt int"
#: Keys of the state: jobs share these. A stream's checkpoint holds for the number that it began with.
BUCKETS = 1024


@contextmanager
def state_store(spark: SparkSession):
    """While streams are started here: the state store that keyed state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Ordered(StatefulProcessor):
    """Holds the events of a bucket's jobs until the watermark has passed them, then gives each job's to ``due`` in order.

    A timer is set for the earliest of what waits and of what ``wakes`` asks for. Times are microseconds; timers are milliseconds.
    Calls of the state store and of Python cost far more than a row, and so do rows of the store: jobs share them by the bucket, in
    which a batch's events are one row and the jobs' states another, both pickled.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")  # lists of (job, at, event_id, step)
        self.states = handle.getValueState("states", "states binary")  # by job

    def due(self, job, state: tuple | None, events: list[tuple], until: int, out: list[tuple]) -> tuple | None:
        """Adds to ``out`` what comes of a job's ``events(at, event_id, step)``; gives its next state."""
        raise NotImplementedError

    def wakes(self, state: tuple) -> int | None:
        return None

    def _set_timer(self, at: int | None, keep: bool) -> None:
        """A timer for what is at ``at``, unless one that stands and may be kept is early enough."""
        timer, old = None if at is None else at // 1000 + 1, list(self.handle.listTimers())
        if keep and old and (timer is None or min(old) <= timer):
            return
        for t in old:
            self.handle.deleteTimer(t)
        if timer is not None:
            self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(j, a, i, None if s is None else str(s)) for pdf in rows for j, a, i, s in zip(pdf["job"].tolist(), pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["step"].tolist())]
        self.waiting.appendValue((pickle.dumps(new),))
        self._set_timer(min(e[1] for e in new), True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = {}, []
        for e in (e for (events,) in self.waiting.get() for e in pickle.loads(events)):
            if e[1] <= until:
                ready.setdefault(e[0], []).append(e[1:])
            else:
                rest.append(e)
        now = self.states.get()
        states = pickle.loads(now[0]) if now else {}
        out: list[tuple] = []
        for job in ready.keys() | {j for j, s in states.items() if (w := self.wakes(s)) is not None and w <= until}:
            states[job] = self.due(job, states.get(job), sorted(ready.get(job, ()), key=lambda e: e[:2]), until, out)
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
        else:
            self.waiting.clear()
        if states:
            self.states.update((pickle.dumps(states),))
        self._set_timer(min([e[1] for e in rest] + [w for s in states.values() if (w := self.wakes(s)) is not None], default=None), False)
        if out:
            yield self.frame(out)


class Progress(_Ordered):
    """Emits a job's step when it isn't that of the event before; after a terminal step nothing more of that job."""

    def __init__(self, terminal: tuple[str, ...] = ()):
        self.terminal = terminal

    def due(self, job, state, events, until, out):
        (before, ended), first = state or (None, False), state is None
        for at, event_id, step in events:
            if ended:
                break
            if first or step != before:
                out.append((job, event_id, at, step))
            before, first = step, False
            ended = step in self.terminal
        return before, ended

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["job", "event_id", "at", "step"])
        return pd.DataFrame({"job": pdf["job"], "event_id": pdf["event_id"], "ts": pd.to_datetime(pdf["at"], unit="us"), "step": pdf["step"]})


class Leases(_Ordered):
    """A job that is put is dealt out under a lease, which heartbeats renew; when it runs out, the job is dealt again, ``attempts`` times in all, then it has failed.

    Steps are ``put``, ``beat``, ``done`` and ``failed``; a job that isn't running takes only ``put``, a running one doesn't.
    """

    def __init__(self, lease: int, attempts: int = 2):
        self.lease, self.attempts = lease, attempts

    def _run_out(self, job, running, attempt, beat, until, out):
        """What runs out before ``until``."""
        while running and beat + self.lease < until:
            beat += self.lease
            if attempt < self.attempts:
                attempt += 1
                out.append((job, beat, "dealt again", attempt))
            else:
                running = False
                out.append((job, beat, "given up", attempt))
        return running, attempt, beat

    def due(self, job, state, events, until, out):
        running, attempt, beat = state or (False, 0, 0)
        for at, _, step in events:
            running, attempt, beat = self._run_out(job, running, attempt, beat, at, out)
            if step == "put" and not running:
                running, attempt, beat = True, 1, at
                out.append((job, at, "dealt", attempt))
            elif running and step == "beat":
                beat = at
            elif running and step in ("done", "failed"):
                running = False
                out.append((job, at, step, attempt))
        return self._run_out(job, running, attempt, beat, until, out)

    def wakes(self, state):
        return state[2] + self.lease + 1 if state[0] else None

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["job", "at", "action", "attempt"])
        return pd.DataFrame({"job": pdf["job"], "ts": pd.to_datetime(pdf["at"], unit="us"), "action": pdf["action"], "attempt": pdf["attempt"].astype("int32")})


def _keyed(events: DataFrame, late: str):
    rows = events.where("job is not null and ts is not null").select("job", "event_id", "ts", "step", F.unix_micros("ts").alias("at"))
    return rows.withColumn("bucket", F.pmod(F.hash("job"), F.lit(BUCKETS))).withWatermark("ts", late).groupBy("bucket")


def progress(events: DataFrame, late: str = "1 hour", terminal: tuple[str, ...] = ()) -> DataFrame:
    """Stream of ``(job, event_id, ts, step)``: the events at which a job's step changes.

    ``events(job, event_id, ts, step)`` is a stream. Events without a job or time are left out; a null step is one of its own.
    """
    return _keyed(events, late).transformWithStateInPandas(Progress(terminal), PROGRESS, "Append", "EventTime")


def leases(events: DataFrame, lease_seconds: float, late: str = "1 hour", attempts: int = 2) -> DataFrame:
    """Stream of ``(job, ts, action, attempt)``: what a queue does with its jobs, see ``Leases``."""
    return _keyed(events, late).transformWithStateInPandas(Leases(int(lease_seconds * 1e6), attempts), ACTIONS, "Append", "EventTime")


class Stuck(StatefulProcessor):
    """As ``Leases``, by the clock instead of events' times: a job is stuck if nothing has come of it for a lease."""

    def __init__(self, lease_ms: int, attempts: int = 2):
        self.lease, self.attempts = lease_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "attempt int")

    def _renew(self, now: int, running: bool) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if running:
            self.handle.registerTimer(now + self.lease)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        attempt = (self.state.get() or (0,))[0]  # 0: not running
        events = sorted((int(a), int(i), str(s)) for pdf in rows for a, i, s in zip(pdf["at"], pdf["event_id"], pdf["step"]))
        for _, _, step in events:
            if step == "put" and not attempt:
                attempt = 1
                out.append((key[0], now * 1000, "dealt", attempt))
            elif attempt and step in ("done", "failed"):
                out.append((key[0], now * 1000, step, attempt))
                attempt = 0
        self.state.update((attempt,))
        self._renew(now, attempt > 0)
        if out:
            yield Leases.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, attempt = timerValues.getCurrentProcessingTimeInMs(), (self.state.get() or (0,))[0]
        if attempt:
            again = attempt < self.attempts
            out = [(key[0], now * 1000, "dealt again" if again else "given up", attempt + again)]
            self.state.update((attempt + 1 if again else 0,))
            self._renew(now, again)
            yield Leases.frame(out)


def stuck_jobs(events: DataFrame, lease_ms: int, attempts: int = 2) -> DataFrame:
    """Stream of ``(job, ts, action, attempt)`` by processing time; ``events`` as in ``leases``.

    Timers by the clock ask for batches without end, so run it by an interval, not until what is available is done.
    """
    rows = events.where("job is not null").select("job", "event_id", "step", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"))
    return rows.groupBy("job").transformWithStateInPandas(Stuck(lease_ms, attempts), ACTIONS, "Append", "ProcessingTime")


def replay(spark: SparkSession, events: DataFrame, make, folder: str, parts: int = 4) -> DataFrame:
    """Runs ``make`` over stored ``events(job, event_id, ts, step)`` as a stream of ``parts`` batches in order of time; its rows.

    The stored events are cut by time, and files are written one after the other, as a stream takes them by age. A last row of no
    job, far later, moves the watermark past them all.
    """
    cut = written(events.select("job", "event_id", "ts", "step").repartitionByRange(parts, "ts").withColumn("_part", F.spark_partition_id()), "events")
    for k in range(parts):
        cut.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/events")
    far = spark.range(1).select(F.lit(-1).cast("long").alias("job"), F.lit(-1).cast("long").alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit("end").alias("step"))
    far.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    return run(spark, make, f"{folder}/events", folder)


def run(spark: SparkSession, make, source: str, folder: str) -> DataFrame:
    """All that ``make(stream)`` gives for the files that ``source`` has now, one file a batch; goes on where the last run has stopped."""
    with state_store(spark):
        stream = spark.readStream.schema("job long, event_id long, ts timestamp, step string").option("maxFilesPerTrigger", 1).parquet(source)
        out = make(stream)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
