"""The stream of upload jobs: late and unordered events, stuck jobs, and a restart from the checkpoint."""

import datetime as dt
import random

import pytest

from cadenza.streaming import jobs

BASE = dt.datetime(2024, 1, 1)
EVENT = "job_id string, ts timestamp, status string, error string"


@pytest.fixture(scope="module")
def rocks(spark):
    name, old = "spark.sql.streaming.stateStore.providerClass", None
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, **how):
    """Batches of (job, second, status[, error]), each a run of its own from the same checkpoint."""
    how = {"late": "10 seconds", "stuck_seconds": 100, "keep_seconds": 200} | how
    for k, batch in enumerate(batches):
        rows = [(x[0], at(x[1]), x[2], x[3] if len(x) > 3 else None) for x in batch]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        q = jobs.job_changes(stream, **how).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(240), k
    return spark.read.parquet(f"{tmp_path}/out")


def told(df):
    seconds = lambda t: None if t is None else (t - BASE).total_seconds()
    return sorted((r["job_id"], seconds(r["at"]), r["status"], seconds(r["started_at"]), seconds(r["finished_at"]), r["error"]) for r in jobs.accepted(df).collect())


def test_jobs_over_restarts(rocks, tmp_path):
    batches = [
        [("a", 5, "running"), ("a", 1, "queued"), ("b", 2, "queued"), ("c", 3, "running"), (None, 3, "queued")],
        [("a", 9, "done"), ("b", 4, "running"), ("d", 30, "queued")],  # each batch is a restart
        [("b", 1, "done"), ("d", 31, "queued"), ("tick", 150, "queued")],  # b's is too late and dropped
        [("d", 160, "running"), ("tick", 161, "running"), ("tick", 900, "error", "broken")],
        [("a", 905, "queued"), ("tick", 1000, "queued")],
        [("tick", 1100, "queued")],
        [("tick", 1101, "queued")],
    ]
    df = run(rocks, tmp_path, batches)
    got = told(df)
    assert [x for x in got if x[0] == "a"] == [("a", 1, "queued", None, None, None), ("a", 5, "running", 5, None, None), ("a", 9, "done", 5, 9, None), ("a", 905, "queued", None, None, None)]  # forgotten, then new
    assert [x for x in got if x[0] == "b"] == [("b", 2, "queued", None, None, None), ("b", 4, "running", 4, None, None), ("b", 104, "error", 4, 104, "timed out")]
    assert [x for x in got if x[0] == "d"] == [("d", 30, "queued", None, None, None), ("d", 160, "running", 160, None, None), ("d", 260, "error", 160, 260, "timed out")]
    assert not [x for x in got if x[0] == "c"]
    refused = {(r["job_id"], (r["at"] - BASE).total_seconds(), r["status"], r["rejected"]) for r in jobs.refused(df).collect()}
    assert {("c", 3, None, "unknown to running"), ("d", 31, "queued", "queued to queued")} <= refused
    assert ("tick", 900, "error", "error to error") in refused  # it had timed out at 261


def test_order_of_arrival_doesnt_matter(rocks, tmp_path):
    rng = random.Random(8)
    events = [(f"j{k}", 10 * k + s, status) for k in range(12) for s, status in ((0, "queued"), (3, "running"), (8, rng.choice(["done", "error"])))]
    end = [("end", 500, "queued")], [("end", 900, "queued")]
    mixed = events[:]
    rng.shuffle(mixed)
    one = told(run(rocks, tmp_path / "one", [events, *end], late="300 seconds"))
    two = told(run(rocks, tmp_path / "two", [mixed[:11], mixed[11:20], mixed[20:], *end], late="300 seconds"))
    assert one == two and len([x for x in one if x[0] != "end"]) == 36
