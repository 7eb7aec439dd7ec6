"""What subscribers of jobs see: events in order, signs of life in silence, an end; with keyed state that timers clear.

A job's stream of events (`server_events`) lasts until a last event
(`refdata.LAST_EVENTS`) or until the job has been idle for longer than its time
to live. In silence a keep-alive row stands after each ``silence``; the one that
finds the job gone is the last. `server_events_of` says the same of a table of
events, by windows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from finquery import refdata as R

KEEP_ALIVE = "keepalive"
ROWS = "life long, number long, at timestamp, event_id long, event string"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of keys lies in RocksDB while a query is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def micros(at: pd.Timestamp) -> int:
    return at.value // 1000


class Subscription(StatefulProcessor):
    """State of a job: when it began and was last heard of, rows sent, and whether its stream has ended.

    The state is cleared by a timer once the job has been idle for longer than
    its time to live, so it holds no more jobs than are alive. A job's events of
    one micro-batch are put in order in memory; the trigger bounds them.
    """

    def __init__(self, job: str, silence: int, idle: int):
        self.job, self.silence, self.idle = job, silence, idle

    def init(self, handle: object) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "life long, at long, number long, kept long, ended boolean")

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["life", "number", "at", "event_id", "event"])
            out["at"], out["event_id"] = pd.to_datetime(out["at"], unit="us"), out["event_id"].astype("Int64")
            out.insert(0, self.job, key[0])
            yield out

    def _silent(self, state: list, until: int, rows: list[tuple]) -> None:
        """Keep-alive rows up to a time; the first beyond the time to live is the last."""
        life, at, number, kept, ended = state
        while not ended and at + (kept + 1) * self.silence <= until:
            kept, number = kept + 1, number + 1
            rows.append((life, number, at + kept * self.silence, None, KEEP_ALIVE))
            ended = kept * self.silence > self.idle
        state[2:] = number, kept, ended

    def _watch(self, state: list) -> None:
        """One timer: at the next keep-alive, or, where there is none to come, when the job expires."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        _, at, _, kept, ended = state
        self.handle.registerTimer((at + self.idle if ended else at + (kept + 1) * self.silence) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        known = self.state.get()
        state, out = list(known) if known else None, []
        for ts, event_id, event in zip(events["ts"], events["event_id"], events["event"], strict=True):
            at = micros(ts)
            if state is not None and at - state[1] > self.idle:
                self._silent(state, at, out)
                state = None
            if state is None:
                state = [at, at, 0, 0, False]
            self._silent(state, at, out)
            state[1], state[3] = max(state[1], at), 0
            if not state[4]:
                state[2] += 1
                out.append((state[0], state[2], at, event_id, event))
                state[4] = event in R.LAST_EVENTS
        self.state.update(tuple(state))
        self._watch(state)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out, now = list(self.state.get()), [], timerValues.getCurrentWatermarkInMs() * 1000
        self._silent(state, now, out)
        if state[4] and now - state[1] > self.idle:
            self.state.clear()
        else:
            self.state.update(tuple(state))
            self._watch(state)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def server_events(stream: DataFrame, job: str, late: str = "10 minutes", silence: float = 25, minutes: float = 60) -> DataFrame:
    """Rows (job and `ROWS`) for subscribers of a stream of ``job, ts, event_id, event``, in append mode; start it within `keyed_state`.

    ``life`` is the time (in microseconds) at which the life began, ``number``
    counts its rows. Keep-alive rows after a job's last event come as the
    watermark (``late`` behind the newest event) passes.
    """
    rows = stream.select(job, "ts", "event_id", "event").withWatermark("ts", late)
    out = StructType().add(stream.schema[job])
    for field in StructType.fromDDL(ROWS):
        out = out.add(field)
    return rows.groupBy(job).transformWithStateInPandas(statefulProcessor=Subscription(job, int(silence * 1e6), int(minutes * 60e6)), outputStructType=out, outputMode="Append", timeMode="EventTime")


def server_events_of(events: DataFrame, job: str, until: Column, silence: float = 25, minutes: float = 60) -> DataFrame:
    """What `server_events` gives for a table of events and a watermark (``until``, in milliseconds), by windows."""
    gap, ttl = int(silence * 1e6), int(minutes * 60e6)
    order = Window.partitionBy(job).orderBy("ts", "event_id")
    rows = events.select(job, "ts", "event_id", "event", F.unix_micros("ts").alias("us"))
    rows = rows.withColumn("new", F.coalesce(F.col("us") - F.lag("us").over(order) > ttl, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(order))
    alive = Window.partitionBy(job, "k").orderBy("ts", "event_id")
    ended = F.sum(F.col("event").isin(R.LAST_EVENTS).cast("int")).over(alive.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"life": F.min("us").over(Window.partitionBy(job, "k")), "after": F.lead("us").over(order), "over": F.coalesce(ended, F.lit(0)) > 0}).where("not over")
    stops = F.coalesce("after", until * 1000)
    quiet = F.least(F.floor((stops - F.col("us")) / gap), F.lit(ttl // gap + 1)).cast("int")
    last = F.col("event").isin(R.LAST_EVENTS)
    kept = F.when(last | (quiet < 1), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), quiet))
    shown = F.concat(F.array(F.struct(F.col("us").alias("at"), F.col("event_id").alias("event_id"), F.col("event").alias("event"))), F.transform(kept, lambda n: F.struct((F.col("us") + n.cast("long") * gap).alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(KEEP_ALIVE).alias("event"))))
    rows = rows.select(job, "life", "ts", F.col("event_id").alias("of"), F.posexplode(shown).alias("place", "x"))
    number = F.row_number().over(Window.partitionBy(job, "life").orderBy("ts", "of", "place")).cast("long")
    return rows.select(job, "life", number.alias("number"), F.timestamp_micros("x.at").alias("at"), "x.event_id", "x.event")


def handed_over(history: DataFrame, stream: DataFrame, job: str, number: str, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """A subscriber's replay, then its live stream: the last ``most`` events of each job in ``history``, and the events of ``stream`` that are newer than those that the history held.

    The hand-over goes by event number, which rises within a job: whatever
    arrives between the snapshot and the start of the stream is in the stream
    and above the job's last number, and what both hold is below it, so no event
    is lost or told twice. ``history`` must be a snapshot (a table that was
    written, say), as both results read it.
    """
    back = Window.partitionBy(job).orderBy(F.desc(number))
    replayed = history.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most).drop("_back")
    cuts = history.groupBy(F.col(job).alias("_job")).agg(F.max(number).alias("_cut"))
    live = stream.join(cuts, stream[job] == F.col("_job"), "left").where(F.col("_cut").isNull() | (F.col(number) > F.col("_cut"))).drop("_job", "_cut")
    return replayed, live


def sse_text(event: Column, payload: Column) -> Column:
    """A row as server-sent text: a comment for a keep-alive, else the event and its JSON."""
    return F.when(event == KEEP_ALIVE, F.lit(": keepalive\n\n")).otherwise(F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n")))
