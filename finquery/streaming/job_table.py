"""The job table: jobs folded from their events, kept as versioned snapshots that batches are merged into.

A job's life ends when it is idle for longer than its time to live; a later
event begins a new one. Folding all events at once, or batch by batch into the
table, gives the same: a batch is folded onto the states that its jobs have in
the snapshot, by windows over the batch's rows alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery import refdata as R

#: Of a job: what progress tells, when it began and was last heard of, and how many events it had.
STATE = "status string, step string, progress_pct int, current_page int, pages_total int, pages_financial long, pages_skipped long, pages_failed long, created_at timestamp, updated_at timestamp, n_events long"
COUNTED = {"pages_financial": "page_extracted", "pages_skipped": "page_skipped", "pages_failed": "page_failed"}


def from_steps(event_type: Column, place: int) -> Column:
    """A column of the table of steps for an event type."""
    given = {k: v[place] for k, v in R.JOB_STEPS.items() if v[place] is not None}
    return F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[event_type]


def folded(events: DataFrame, job: str, ts: str, number: str, minutes: int = 60, before: DataFrame | None = None) -> DataFrame:
    """The state (`STATE`) of the last life of each job with ``events`` (``event_type, page, count`` beside job, time and number).

    ``before``: states of jobs as they were, which a job's first life goes on
    from where it is not idle for longer than ``minutes``. Null pages and counts
    tell nothing; unknown event types count as signs of life.
    """
    rows = events.select(job, F.col(ts).alias("_ts"), F.col(number).alias("_number"), "event_type", F.col("page").cast("int").alias("page"), F.col("count").cast("int").alias("count"))
    if before is None:
        before = rows.sparkSession.createDataFrame([], f"{job} {events.schema[job].dataType.simpleString()}, {STATE}")
    rows = rows.join(before.select(job, F.struct(*(c for c in before.columns if c != job)).alias("was")), job, "left")
    order = Window.partitionBy(job).orderBy("_ts", "_number")
    last = F.coalesce(F.lag("_ts").over(order), F.col("was.updated_at"))
    idle = F.coalesce(F.unix_micros("_ts") - F.unix_micros(last) > minutes * 60_000_000, F.lit(False))
    rows = rows.withColumn("_life", F.sum(idle.cast("int")).over(order)).withColumn("_lives", F.max("_life").over(Window.partitionBy(job))).where("_life = _lives")
    went_on = (F.col("_life") == 0) & F.col("was").isNotNull()
    rows = rows.withColumn("was", F.when(went_on, F.col("was")))
    total = F.coalesce(F.last(F.when(F.col("event_type") == "pages_rendered", F.col("count")), True).over(order), F.col("was.pages_total"))
    paged = F.when(F.col("page").isNotNull() & (total > 0), F.least(F.lit(80), 15 + F.floor(70 * F.col("page") / total)).cast("int"))
    rows = rows.withColumns({"total": total, "pct": F.coalesce(paged, from_steps(F.col("event_type"), 1)), "step": from_steps(F.col("event_type"), 0), "status": from_steps(F.col("event_type"), 2)})
    at = F.struct("_ts", "_number")
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    first = F.first("was")
    told = {"status": "status", "step": "step", "progress_pct": "pct", "current_page": "page", "pages_total": "total"}
    begun = {"status": "queued", "step": "queued", "progress_pct": 0}
    state = [F.coalesce(newest(c), first[n], *([F.lit(begun[n])] if n in begun else [])).alias(n) for n, c in told.items()]
    state += [(F.count_if(F.col("event_type") == kind) + F.coalesce(first[n], F.lit(0))).alias(n) for n, kind in COUNTED.items()]
    state += [F.coalesce(first["created_at"], F.min("_ts")).alias("created_at"), F.max("_ts").alias("updated_at"), (F.count("*") + F.coalesce(first["n_events"], F.lit(0))).alias("n_events")]
    return rows.groupBy(job).agg(*state)


class JobTable:
    """Snapshots below ``path`` (a folder that driver and executors share); a manifest names the one that counts.

    A version is written whole before the manifest that names it is moved into
    place, so a reader always finds a complete one. A batch is merged once: its
    number stands in the manifest, and one that was merged already is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, job: str, kind: str = "long", minutes: int = 60):
        self.spark, self.path, self.job, self.kind, self.minutes = spark, path.rstrip("/"), job, kind, minutes
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        if not self._fs.exists(self._at("manifest")):
            return {"version": -1, "batch": -1, "now": None}
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(self._at("manifest")) if f.getPath().getName().isdigit()]
        if not numbers:
            return {"version": -1, "batch": -1, "now": None}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(numbers)}", wholetext=True).first()[0])

    def read(self) -> DataFrame:
        """The jobs of the newest snapshot."""
        version, schema = self._manifest()["version"], f"{self.job} {self.kind}, {STATE}"
        return self.spark.createDataFrame([], schema) if version < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/jobs/{version}")

    def merge(self, events: DataFrame, batch: int, ts: str, number: str) -> bool:
        """Fold a batch into the table and drop jobs that are idle for longer than their time at its last event; False where it was merged before."""
        known = self._manifest()
        if batch <= known["batch"]:
            return False
        before = self.read()
        changed = folded(events, self.job, ts, number, self.minutes, before)
        now = events.agg(F.max(F.unix_micros(ts))).first()[0]
        now = max(x for x in (now, known["now"], -(1 << 62)) if x is not None)
        kept = before.join(changed.select(self.job), self.job, "left_anti").unionByName(changed)
        kept = kept.where(F.lit(now) - F.unix_micros("updated_at") <= self.minutes * 60_000_000)
        version = known["version"] + 1
        kept.write.mode("overwrite").parquet(f"{self.path}/jobs/{version}")
        self._publish({"version": version, "batch": batch, "now": now})
        self._fs.delete(self._at(f"jobs/{version - 2}"), True)  # the one before stays for readers that began with it
        self._fs.delete(self._at(f"manifest/{version - 2}"), False)
        return True

    def _publish(self, manifest: dict) -> None:
        name, aside = self._at(f"manifest/{manifest['version']}"), self._at(f"manifest-{manifest['version']}.new")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._at("manifest"))
        self._fs.delete(name, False)
        if not self._fs.rename(aside, name):
            raise OSError(f"could not publish {name}")


class ResultSink:
    """JSON results of completed jobs, one folder a batch: a batch that is delivered again replaces what it wrote.

    A result is let through where its job's status says that it may be asked for (`jobs.result_gate`).
    """

    def __init__(self, spark: SparkSession, path: str, job: str):
        self.spark, self.path, self.job = spark, path.rstrip("/"), job

    def write(self, results: DataFrame, states: DataFrame, batch: int) -> None:
        """``results``: the job and any columns, which become one JSON object a line."""
        from finquery.streaming.jobs import result_gate

        open_ = states.where(result_gate(F.col("status")) == 200).select(self.job)
        rows = results.join(open_, self.job, "left_semi").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        rows.write.mode("overwrite").text(f"{self.path}/batch={batch}")

    def read(self, schema: str) -> DataFrame:
        """All results; of a job that several batches tell of, the last."""
        lines = self.spark.read.text(f"{self.path}").select("batch", F.from_json("value", schema).alias("r"))
        return lines.groupBy(f"r.{self.job}").agg(F.max_by("r", "batch").alias("r")).select("r.*")
