"""Streams over several batches and restarts: states with timers, runs of failures, known contents."""

import datetime
import random

from pyspark.sql import functions as F

from foliant.operators import state
from foliant.streaming import jobs, materials

START = datetime.datetime(2024, 5, 1)
HOUR = datetime.timedelta(hours=1)
EVENT = "log_id long, material_id long, stage string, level string, created_at timestamp"


def write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, schema, folder):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def run_states(spark, folder, sink, checkpoint, **settings):
    restore = materials.configured(spark)
    try:
        states = materials.material_states(
            stream(spark, EVENT, folder), ["convert", "upload"], 5 * HOUR, "1 hour", **settings)
        jobs.upsert_batches(states, sink, checkpoint).awaitTermination()
    finally:
        restore()
    return materials.newest_states(spark.read.parquet(sink))


def test_states_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    stages = ["convert", "upload", "ready", "indexed"]
    events = [(i, rng.randrange(40), rng.choice(stages), rng.choice(["info", "error"]), START + i * HOUR / 4) for i in range(200)]
    events.append((500, None, "convert", "info", START))
    seen = []
    for part in range(5):
        seen += events[part * 40:part * 40 + 40] + (events[200:] if part == 0 else [])
        write(spark, events[part * 40:part * 40 + 40] + (events[200:] if part == 0 else []), EVENT, folder, f"f{part}")
        if part in (1, 2, 4):
            # Stopped and started again from its checkpoint each time.
            got = {tuple(r) for r in run_states(spark, folder, sink, checkpoint).collect()}
            batch = spark.createDataFrame(seen, EVENT).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
            end = max(e[4] for e in seen) - HOUR
            want = state.status_at(batch, ["convert", "upload"], F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 5 HOURS"))
            assert got == {tuple(r) for r in want.collect()}
            assert any(r[-1] for r in got)


def test_an_event_after_the_timer_clears_the_warning(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write(spark, [(1, 1, "convert", "info", START), (2, 2, "ready", "info", START + 10 * HOUR)], EVENT, folder, "a")
    got = {r.material_id: r for r in run_states(spark, folder, sink, checkpoint).collect()}
    assert got[1].interrupted and not got[2].interrupted
    write(spark, [(3, 1, "ready", "error", START + 11 * HOUR)], EVENT, folder, "b")
    got = {r.material_id: r for r in run_states(spark, folder, sink, checkpoint).collect()}
    assert (got[1].interrupted, got[1].events, got[1].failures, got[1].stage) == (False, 2, 1, "ready")


def test_quiet_materials_leave_the_state(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    keep = datetime.timedelta(hours=20)
    write(spark, [(1, 1, "ready", "info", START), (2, 2, "convert", "info", START)], EVENT, folder, "a")
    write(spark, [(3, 3, "ready", "info", START + 10 * HOUR)], EVENT, folder, "b")
    run_states(spark, folder, sink, checkpoint, keep=keep)
    write(spark, [(4, 4, "ready", "info", START + 50 * HOUR)], EVENT, folder, "c")
    got = {r.material_id: r.interrupted for r in run_states(spark, folder, sink, checkpoint, keep=keep).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}
    # All but the last are forgotten: one that comes back begins anew.
    write(spark, [(5, 1, "convert", "info", START + 51 * HOUR), (6, 4, "ready", "info", START + 51 * HOUR)], EVENT, folder, "d")
    got = {r.material_id: r.events for r in run_states(spark, folder, sink, checkpoint, keep=keep).collect()}
    assert (got[1], got[4]) == (1, 2)


FAILURE = "event_id long, material_id long, failed_at timestamp_ntz, detail string"


def test_failures_of_a_year_ago_end_no_retries(spark):
    old = START - datetime.timedelta(days=365)
    rows = [(i, 1, old + i * HOUR / 60, "503") for i in range(6)] + [(10, 1, START, "503"), (11, 1, START + HOUR / 2, "503")]
    rows += [(20, None, START, "503"), (21, None, START + 3 * HOUR, "503")]
    df = spark.createDataFrame(rows, FAILURE)
    plan = {r.event_id: (r.attempt, r.action) for r in state.retry_plan(df, run=3600).collect()}
    assert plan == {**{i: (i + 1, "retry" if i < 5 else "give_up") for i in range(6)},
                    10: (1, "retry"), 11: (2, "retry"), 20: (1, "retry"), 21: (1, "retry")}
    assert {r.event_id: r.action for r in state.retry_plan(df).collect()}[10] == "give_up"
    named = df.withColumn("run_no", F.col("event_id") % 2)
    assert {r.event_id: r.attempt for r in state.retry_plan(named, run="run_no").collect()}[11] == 4


def test_runs_of_one_material_with_most_failures(spark):
    """Runs against gaps and islands, with failures at the very edges of gaps and slots."""
    rng, at, rows, want = random.Random(7), START, [], []
    run = 0
    for i in range(600):
        step = rng.choice([0, 1, 599, 600, 601, 3000])
        at += datetime.timedelta(seconds=step)
        # A failure just a gap after the last one still belongs to its session.
        run += step > 600
        rows.append((i, 1, at, "503"))
        want.append(run)
    got = {r.event_id: (r.run_started_at, r.attempt) for r in state.retry_plan(spark.createDataFrame(rows, FAILURE), run=600).collect()}
    assert len(got) == 600
    starts = {}
    for (i, _, at, _), run in zip(rows, want):
        starts.setdefault(run, at)
    count = {}
    for (i, _, _, _), run in zip(rows, want):
        count[run] = count.get(run, 0) + 1
        assert got[i] == (starts[run], count[run])


MATERIAL = "material_id long, topic_id long, file_hash string, created_at timestamp"


def test_what_the_catalog_has_is_refused_and_the_state_shrinks(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    catalog = spark.createDataFrame([(1, "known"), (2, "other"), (1, None)], "topic_id long, file_hash string")
    for day in range(6):
        at = START + datetime.timedelta(days=day)
        rows = [(100 * day + i, 1, f"h{day}-{i // 2}", at + i * HOUR / 60) for i in range(20)]
        rows += [(100 * day + 50, 1, "known", at), (100 * day + 51, 2, "known", at), (100 * day + 52, 1, None, at)]
        write(spark, rows, MATERIAL, folder, f"d{day}")
    kept = jobs.accept_new(stream(spark, MATERIAL, folder), catalog, within="12 hours")
    query = jobs.to_parquet(kept, sink, checkpoint)
    query.awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert not [r for r in rows if (r.topic_id, r.file_hash) == (1, "known")]
    assert sum(r.file_hash is None for r in rows) == 6
    assert sorted(r.file_hash for r in rows if r.file_hash and r.file_hash[0] == "h") == sorted(
        f"h{day}-{i}" for day in range(6) for i in range(10))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Twelve contents a day, of which no more than two days are remembered.
    assert max(sizes) <= 24 and sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"]) >= 48
