"""Streams over several micro-batches against one pass over all events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finquery.streaming import job_table, jobs, live

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, event string, event_type string, page int, count int"
TYPES = ["job_started", "pages_rendered", "page_extracted", "page_skipped", "page_failed", "page_extracted", "unknown", "result_ready", "job_failed"]


def made(seed: int, n: int = 600, users: int = 15, hours: int = 200) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for k, at in enumerate(sorted(rng.uniform(0, hours * 60) for _ in range(n))):
        kind = rng.choice(TYPES)
        rows.append((rng.randrange(users), START + timedelta(minutes=round(at, 5)), k, kind, kind, rng.choice([None, 1, 2, 7]) if kind.startswith("page_") else None, rng.choice([None, 0, 8, 20]) if kind == "pages_rendered" else None))
    return rows


def files(spark, rows, path, parts):
    """One file a micro-batch, in order."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_keyed_state_over_batches(spark, tmp_path):
    rows = made(1)
    stream = files(spark, rows, f"{tmp_path}/events", 6)
    seen = []
    with live.keyed_state(spark):
        query = live.server_events(stream, "user_id", silence=600).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    until = int(max(r[1] for r in rows).timestamp() * 1000) - 600_000
    want = live.server_events_of(spark.createDataFrame(rows, SCHEMA), "user_id", F.lit(until), silence=600)
    assert sorted(map(str, (r[1:] for r in seen))) == sorted(str(tuple(r)) for r in want.collect())
    assert len({n for n, *_ in seen}) >= 6 and any(r[-1] == live.KEEP_ALIVE for r in seen)
    # What has expired is forgotten: after the last batch only jobs heard of within their time are left.
    alive = {r[0] for r in rows if r[1].timestamp() * 1000 >= until - 3_600_000}
    left = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "job").load().select("key.user_id").distinct().count()
    assert left <= len(alive) < 15


def test_a_quiet_and_an_ended_job(spark):
    rows = [(1, START, 1, "job_started", "job_started", None, None), (1, START + timedelta(seconds=60), 2, "result_ready", "result_ready", None, None), (1, START + timedelta(seconds=61), 3, "page_extracted", "page_extracted", 1, None), (2, START, 4, "job_started", "job_started", None, None)]
    shown = live.server_events_of(spark.createDataFrame(rows, SCHEMA), "user_id", F.lit(1 << 50)).orderBy("user_id", "number").collect()
    assert [r["event"] for r in shown if r["user_id"] == 1] == ["job_started", "keepalive", "keepalive", "result_ready"]
    assert [r["event"] for r in shown if r["user_id"] == 2] == ["job_started"] + ["keepalive"] * 145  # the first beyond an hour is the last
    text = spark.createDataFrame([("keepalive", None), ("job_failed", "{}")], "e string, p string").select(live.sse_text(F.col("e"), F.col("p"))).collect()
    assert [r[0] for r in text] == [": keepalive\n\n", "event: job_failed\ndata: {}\n\n"]


def plain(rows, minutes):
    """One loop over the events: a job's state as the source of events keeps it."""
    jobs_ = {}
    fixed = {k: v for k, v in job_table.R.JOB_STEPS.items()}
    for user, ts, _, kind, _, page, count in rows:
        job = jobs_.get(user)
        if job is None or ts - job["updated_at"] > timedelta(minutes=minutes):
            job = jobs_[user] = {"status": "queued", "step": "queued", "progress_pct": 0, "current_page": None, "pages_total": None, "pages_financial": 0, "pages_skipped": 0, "pages_failed": 0, "created_at": ts, "n_events": 0}
        step, pct, status = fixed.get(kind, (None, None, None))
        job["step"], job["status"], job["progress_pct"] = step or job["step"], status or job["status"], job["progress_pct"] if pct is None else pct
        if kind == "pages_rendered" and count is not None:
            job["pages_total"] = count
        if page is not None:
            job["current_page"] = page
            if job["pages_total"]:
                job["progress_pct"] = min(80, 15 + int(70 * page / job["pages_total"]))
        for name, counted in job_table.COUNTED.items():
            job[name] += kind == counted
        job["n_events"] += 1
        job["updated_at"] = ts
    return jobs_


@pytest.mark.parametrize(("minutes", "parts"), [(60, 4), (3000, 7), (1 << 20, 3)])
def test_job_table_in_batches_is_one_fold(spark, tmp_path, minutes, parts):
    rows = made(minutes, 250, 9)
    table = job_table.JobTable(spark, f"file://{tmp_path}/jobs", "user_id", minutes=minutes)
    assert table.read().count() == 0
    for k in range(parts):
        batch = spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], SCHEMA)
        assert table.merge(batch, k, "ts", "event_id") and not table.merge(batch, k, "ts", "event_id")
    want, now = plain(rows, minutes), rows[-1][1]
    want = {k: v for k, v in want.items() if now - v["updated_at"] <= timedelta(minutes=minutes)}
    assert {r["user_id"]: {c: r[c] for c in want[r["user_id"]]} for r in table.read().collect()} == want
    once = {r["user_id"]: r.asDict() for r in job_table.folded(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", minutes).collect()}
    assert {k: {c: once[k][c] for c in v} for k, v in want.items()} == want
    assert table.merge(spark.createDataFrame([], SCHEMA), parts, "ts", "event_id") and table.read().count() == len(want)


def test_results_once_and_only_through_the_gate(spark, tmp_path):
    sink = job_table.ResultSink(spark, f"file://{tmp_path}/results", "user_id")
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "user_id long, answer string")
    states = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "completed")], "user_id long, status string")
    sink.write(results, states, 0)
    sink.write(results, states, 0)
    sink.write(spark.createDataFrame([(1, "newer")], "user_id long, answer string"), states, 1)
    assert sorted(tuple(r) for r in sink.read("user_id long, answer string").collect()) == [(1, "newer"), (3, None)]


def test_hand_over_while_events_arrive(spark, tmp_path):
    rows = made(3, 300)
    path = f"{tmp_path}/events"
    files(spark, rows[:150], path, 2)
    snapshot = f"{tmp_path}/snapshot"
    spark.read.schema(SCHEMA).parquet(path).write.parquet(snapshot)
    files(spark, rows[150:200], path, 1)  # between the snapshot and the start
    replayed, fresh = live.handed_over(spark.read.schema(SCHEMA).parquet(snapshot), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "user_id", "event_id", most=1000)
    files(spark, rows[200:], path, 2)
    got = [r[0] for r in replayed.select("event_id").collect()] + [r[0] for r in jobs.run_once(fresh.select("event_id"), f"file://{tmp_path}/live", mode="append").collect()]
    assert sorted(got) == list(range(300))
