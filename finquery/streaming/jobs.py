"""Progress of jobs as a stream of events: latest state, percent, replay, idle expiry, end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER = 500
TERMINAL = ("job_completed", "job_failed")


def progress_percent(page: Column, total: Column) -> Column:
    """Between 15 and 80 while pages are read."""
    return F.least(F.lit(80), 15 + F.floor(F.lit(70) * page / total)).cast("int")


def latest_state(events: DataFrame, job: str, at: Column, *values: str) -> DataFrame:
    """For each job the last value of each column that is not null, and how many events there were; batch or stream.

    A stream keeps a state for every job it has seen; where jobs do not come to
    an end by themselves use `latest_state_of_sessions`.
    """
    return _latest(events, job, at, values)


def latest_state_of_sessions(events: DataFrame, job: str, ts: str, at: Column, *values: str, minutes: int = 60, late: str | None = None) -> DataFrame:
    """`latest_state` for each stretch of a job's events without a gap of ``minutes``, with ``expires_at``. With a watermark of ``late`` a stream forgets what has expired."""
    rows = events.withWatermark(ts, late) if late else events
    return _latest(rows.withColumn("_w", F.session_window(ts, f"{minutes} minutes")), [job, "_w"], at, values).withColumn("expires_at", F.col("_w.end")).drop("_w")


def _latest(events: DataFrame, keys: str | list[str], at: Column, values: tuple[str, ...]) -> DataFrame:
    return events.groupBy(keys).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(f"last_{v}") for v in values), F.count("*").alias("n_events"))


def replay(events: DataFrame, job: str, *order: str, most: int = BUFFER) -> DataFrame:
    """The last ``most`` events of each job, with their place."""
    back = Window.partitionBy(job).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most).withColumnRenamed("_back", "place_from_end")


def until_terminal(events: DataFrame, job: str, is_terminal: Column, *order: str) -> DataFrame:
    """Events up to the first terminal one."""
    done = F.sum(F.when(is_terminal, 1).otherwise(0)).over(Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_done", F.coalesce(done, F.lit(0))).where("_done = 0").drop("_done")


def idle_sessions(events: DataFrame, job: str, at: str, minutes: int = 60, late: str | None = None) -> DataFrame:
    """Stretches of a job's events without a gap of ``minutes``: a job expires after each. For streams give ``late``, the watermark's delay."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(job, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_events")).select(job, F.col("w.start").alias("first_at"), F.col("w.end").alias("expires_at"), "n_events")


def result_gate(status: Column) -> Column:
    """The answer to a request for a result: 200, 404 if unknown, 409 while running, 422 if failed."""
    return F.when(status.isNull(), 404).when(status == "completed", 200).when(status == "failed", 422).otherwise(409)


def run_once(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Drain what is there into Parquet below ``path`` (a folder that all executors share) and return it.

    Each batch is a table of its own, so that a batch that runs again replaces
    what it wrote. In complete mode the last batch is the result, else all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows") if query.lastProgress else stream.sparkSession.createDataFrame([], stream.schema.add("batch", "long"))
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(last))
    return rows.drop("batch")


def run_each(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Drain what is there, batch by batch, into ``write(batch, number)``, which a batch that fails reaches again under its number."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
