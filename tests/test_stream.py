"""The bounded stream: restarts change nothing, and its state stays within its caps."""

from __future__ import annotations

import random
import time

import pytest

from loomlight.operators import cache as C
from loomlight.streaming.bounded import OUT, PROVIDER, replay_bounded

SCHEMA = "seq long, action string, path string, hash string"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def run(spark, tmp_path, **o):
    """Take in what has come since the last run; the number of entries that the state then has."""
    d = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay_bounded(d, **o).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return max((p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]), default=0)


def come(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def trace(seed, n, paths, hashes=("a", "a", "b", None)):
    chance = random.Random(seed)
    return [(i, chance.choice(["store", "check", "check", "check"]), chance.choice(paths), chance.choice(hashes)) for i in range(n)]


def test_restarts_change_nothing(rocks, tmp_path):
    rows = trace(1, 240, [f"p{i}" for i in range(9)])
    for a in range(0, 240, 80):
        come(rocks, tmp_path, rows[a : a + 80])
        run(rocks, tmp_path, groups=2)
    columns = ["path", "seq", "action", "status", "hits"]
    got = rocks.read.parquet(str(tmp_path / "out")).select(columns).orderBy("seq").collect()
    assert got == C.replay(rocks.createDataFrame(rows, SCHEMA)).select(columns).orderBy("seq").collect()


def test_state_stays_within_its_caps(rocks, tmp_path):
    entries = []
    for a in range(3):
        come(rocks, tmp_path, [(1000 * a + i, "store" if i < 50 else "check", f"p{a}-{i % 50}", "a") for i in range(60)] + [(1000 * a + 900, "check", f"never{a}", "a")])
        entries.append(run(rocks, tmp_path, rows=10, groups=2))
    assert 0 < max(entries) <= 10
    come(rocks, tmp_path, [(5000, "check", "p0-3", "a"), (5001, "check", "p2-9", "a")])
    run(rocks, tmp_path, rows=10, groups=2)
    last = {r.seq: r.status for r in rocks.read.parquet(str(tmp_path / "out")).where("seq >= 5000").collect()}
    assert last == {5000: "miss", 5001: "hit"}


def test_entries_expire(rocks, tmp_path):
    """With a time to live the query runs on by itself, so it is stopped when its rows are there."""
    out = tmp_path / "out"

    def wait(seq):
        for _ in range(120):
            if (out / "_spark_metadata").exists() and (found := rocks.read.schema(OUT).parquet(str(out)).where(f"seq = {seq}").collect()):
                return found[0].status
            time.sleep(0.5)
        raise TimeoutError

    come(rocks, tmp_path, [(1, "store", "p", "a")])
    d = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay_bounded(d, groups=1, ttl_ms=500).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        assert wait(1) == "stored"
        time.sleep(1)
        come(rocks, tmp_path, [(2, "check", "p", "a")])
        assert wait(2) == "miss"
    finally:
        q.stop()


def test_it_asks_for_its_state_store(spark):
    spark.conf.unset(PROVIDER)
    with pytest.raises(ValueError, match="RocksDB"):
        replay_bounded(spark.createDataFrame([], SCHEMA))
