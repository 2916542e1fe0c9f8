"""Keyed state over streams, interrupted ingest and failing models, against plain loops."""

from __future__ import annotations

import random
import threading
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docspark.functions import models
from docspark.operators.tables import delete
from docspark.streaming import ingest, jobs, page_batches

EVENT = "job long, event_id long, ts timestamp, step string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def events(rng, n, jobs_, steps, gap=600):
    at, out = START, []
    for i in range(n):
        at += timedelta(seconds=rng.expovariate(1 / gap))
        out.append((rng.randrange(jobs_), i, at, rng.choice(steps)))
    return out


def ended(rows):
    """``rows`` and a last one of no job that moves the watermark past them."""
    return [*rows, (-1, -1, datetime(2200, 1, 1, tzinfo=UTC), "end")]


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def changes(rows, terminal=()):
    out, last, over = [], {}, set()
    for job, i, at, step in sorted(rows, key=lambda r: (r[2], r[1])):
        if job in over or job is None:
            continue
        if last.get(job) != step:
            out.append((job, i, step))
        last[job] = step
        if step in terminal:
            over.add(job)
    return sorted(out)


@pytest.mark.parametrize("split,terminal", [("one", ()), ("shuffled", ()), ("restarted", ("c",))])
def test_progress_in_any_split(spark, split, terminal):
    rng = random.Random(1)
    rows = events(rng, 150, 6, "abc", 60)
    folder = ingest.work_folder(spark)
    make = lambda e: jobs.progress(e, "10 minutes", terminal)
    if split == "one":
        put(spark, folder, ended(rows))
    elif split == "shuffled":  # events come late, but not too late
        late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.random() * 500))
        for k in range(0, 150, 50):
            put(spark, folder, late[k : k + 50])
        put(spark, folder, ended([]))
    else:
        put(spark, folder, rows[:70])
        jobs.run(spark, make, f"{folder}/events", folder)
        put(spark, folder, rows[70:])
        put(spark, folder, ended([]))
    got = jobs.run(spark, make, f"{folder}/events", folder)
    assert sorted((r.job, r.event_id, r.step) for r in got.collect()) == changes(rows, terminal)


def queue(rows, lease, attempts=2):
    out, state = [], {}
    for job, i, at, step in [*sorted(rows, key=lambda r: (r[2], r[1])), *[(j, 0, datetime(2199, 1, 1, tzinfo=UTC), "end") for j in {r[0] for r in rows}]]:
        attempt, beat = state.get(job, (0, at))
        while attempt and beat + lease < at:
            beat += lease
            out.append((job, beat, "dealt again" if attempt < attempts else "given up", attempt + (attempt < attempts)))
            attempt = attempt + 1 if attempt < attempts else 0
        if step == "put" and not attempt:
            attempt, beat = 1, at
            out.append((job, at, "dealt", 1))
        elif attempt and step == "beat":
            beat = at
        elif attempt and step in ("done", "failed"):
            out.append((job, at, step, attempt))
            attempt = 0
        state[job] = (attempt, beat)
    return sorted(out)


def test_queue_against_a_loop(spark):
    rows = events(random.Random(2), 200, 5, ["put", "put", "beat", "beat", "done", "failed", "other"])
    folder = ingest.work_folder(spark)
    make = lambda e: jobs.leases(e, 3600, "10 minutes")
    put(spark, folder, rows[:120])
    jobs.run(spark, make, f"{folder}/events", folder)  # the next run is a restart
    put(spark, folder, ended(rows[120:]))
    got = jobs.run(spark, make, f"{folder}/events", folder).withColumn("us", F.unix_micros("ts")).collect()
    us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
    want = [(j, us(t), a, n) for j, t, a, n in queue(rows, timedelta(seconds=3600))]
    assert sorted((r.job, r.us, r.action, r.attempt) for r in got) == want and {r.action for r in got} >= {"dealt again", "given up", "done"}


def test_jobs_share_keys_of_the_state(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)  # before, every job was a key, with calls of the state store for each of its batches
    rows = events(random.Random(5), 300, 40, ["put", "put", "beat", "done", "failed"])
    folder = ingest.work_folder(spark)
    make = lambda e: jobs.leases(e, 3600, "10 minutes")
    put(spark, folder, rows[:170])
    jobs.run(spark, make, f"{folder}/events", folder)
    put(spark, folder, ended(rows[170:]))
    got = jobs.run(spark, make, f"{folder}/events", folder).withColumn("us", F.unix_micros("ts")).collect()
    us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
    assert sorted((r.job, r.us, r.action, r.attempt) for r in got) == [(j, us(t), a, n) for j, t, a, n in queue(rows, timedelta(seconds=3600))]


def test_stuck_job_by_the_clock_is_dealt_once_more_after_a_restart(spark):
    folder = ingest.work_folder(spark)

    def run(until):
        """Runs until the rows have what is awaited; timers by the clock ask for batches without end."""
        with jobs.state_store(spark):
            stream = spark.readStream.schema(EVENT).parquet(f"{folder}/events")
            query = jobs.stuck_jobs(stream, 1500, 2).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="300 milliseconds").start()
        for _ in range(60):
            time.sleep(0.5)
            rows = {(r.job, r.action, r.attempt) for r in spark.read.schema(jobs.ACTIONS).parquet(f"{folder}/out").collect()} if query.lastProgress else set()
            if until <= rows:
                break
        query.stop()
        return rows

    put(spark, folder, [(1, 1, START, "put"), (2, 2, START, "put"), (2, 3, START, "done")])
    got = run({(1, "dealt", 1), (2, "done", 1)})
    assert got >= {(1, "dealt", 1), (2, "dealt", 1), (2, "done", 1)}
    got = run({(1, "given up", 2)})  # a restart: the lease has gone on running
    assert {x for x in got if x[0] == 1} == {(1, "dealt", 1), (1, "dealt again", 2), (1, "given up", 2)} and len([x for x in got if x[0] == 2]) == 2


def test_ingest_goes_on_where_it_was_killed(spark):
    rng = random.Random(3)
    pages = [(d, p, None if rng.random() < 0.1 else "bad" if rng.random() < 0.1 else "\n".join(f"line {d} {p} {i}" for i in range(rng.randint(0, 4)))) for d in range(6) for p in range(1, rng.randint(2, 40))]
    pages += [(None, 1, "x"), (1, None, "x"), (2, 1, "twice")]
    df = spark.createDataFrame(pages, "doc_id long, page int, content string").withColumn("batch", F.lit("clash"))

    def parse(content):
        if content == "bad":
            raise ValueError("unreadable")
        return content.split("\n")

    folder = f"{ingest.work_folder(spark)}/a"
    assert page_batches.ingest(df, parse, folder, 15, 5, most=2) == 3

    def killed(content):
        raise KeyboardInterrupt

    first = {(r.doc_id, r.element_id, r.page, r.text, r.error) for r in page_batches.merged(spark, folder).collect()}
    with pytest.raises(Exception):
        page_batches.ingest(df, killed, folder, 15, 5)
    assert {(r.doc_id, r.element_id, r.page, r.text, r.error) for r in page_batches.merged(spark, folder).collect()} == first
    with pytest.raises(ValueError):
        page_batches.finish(spark, folder, f"{folder}-out")
    assert page_batches.ingest(df, parse, folder, 7, 99) == 0  # dealt as the manifest says
    want, no = [], {}
    for d, p, content in sorted((x for x in pages if None not in x[:2]), key=lambda x: (x[0], x[1], x[2] or "")):
        if content == "bad":
            want.append((d, None, p, None, "unreadable"))
        elif content is not None:
            for line in content.split("\n"):
                k = (d, (p - 1) // 15)
                want.append((d, p, line))
                no[k] = no.get(k, 0) + 1
    got = page_batches.merged(spark, folder).collect()
    assert sorted((r.doc_id, r.page, r.text) for r in got if r.error is None) == sorted(w for w in want if len(w) == 3)
    assert sorted((r.doc_id, r.page) for r in got if r.error == "unreadable") == sorted((w[0], w[2]) for w in want if len(w) == 5)
    ids = [(r.doc_id, r.element_id) for r in got if r.error is None]
    assert sorted(ids) == sorted((d, f"b{b}_{i}") for (d, b), n in no.items() for i in range(n))
    page_batches.finish(spark, folder, f"{folder}-out")
    assert spark.read.parquet(f"{folder}-out").count() == len(got)
    delete(spark, f"{folder}-out")


def test_models_that_fail_lose_only_their_items():
    seen, lock = [], threading.Lock()

    def model(items):
        with lock:
            seen.append(len(items))
        if any(x % 10 == 7 for x in items):
            raise ValueError("seven")
        return [x * 2 for x in items]

    how = models.Calls(size=5, tries=2, wait=0)
    got = models.answers(list(range(5)), [model], how)
    assert got == [(2 * x, None, 1) for x in range(5)]
    got = models.answers(list(range(5, 10)), [model], how)
    assert [(r, e) for r, e, _ in got] == [(10, None), (12, None), (None, "seven"), (16, None), (18, None)] and seen == [5, 5, 5, 1, 1, 1, 1, 1]
    assert models.answers([7], [model, lambda items: [-1] * len(items)], how) == [(-1, None, 3)]
    assert models.answers([7], [lambda items: []], how) == [(None, "0 results for 1 items", 2)]
    tried = []

    def flaky(items):
        tried.append(1)
        if len(tried) < 3:
            raise OSError()
        return items

    assert models.answers([1, 2], [flaky], models.Calls(tries=3, wait=0)) == [(1, None, 3), (2, None, 3)]
    assert [models.Calls(wait=2).pause(t) for t in (1, 2, 3)] == [2, 4, 6] and [models.Calls(wait=2, factor=3).pause(t) for t in (1, 2, 3)] == [2, 6, 18]


def test_model_calls_over_a_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["a a b", None, "", "z" * 50, "the the the", "ok"] * 4)], "doc_id long, text string, error string")
    out = models.called(df, "text", [models.doubled_words(20)], "long", models.Calls(size=4, tries=1))
    assert out.columns == ["doc_id", "text", "result", "error", "calls"]
    want = {"a a b": (1, None), None: (0, None), "": (0, None), "z" * 50: (None, "text too long"), "the the the": (2, None), "ok": (0, None)}
    rows = out.collect()
    assert len(rows) == 24 and all((r.result, r.error) == want[r.text] for r in rows)
    ok = models.accepted(df, "text", [lambda texts: [None if t is None else len(t) < 9 if t != "ok" else 1 / 0 for t in texts]]).collect()
    assert all(r.accepted == (r.text in ("a a b", "")) for r in ok) and models.called(df.where("false"), "text", [], "long").count() == 0
