"""The keyed store: what a change rewrites, caps, concurrent writers, and what a dead writer leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomlight.operators import cache as C
from loomlight.operators import compress as Z
from loomlight.operators.keyed import MEMORY, Conflict, KeptCache, KeptMemory
from loomlight.plans import kept
from loomlight.sources import shared


def memory(spark, rows):
    return spark.createDataFrame(rows, MEMORY)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = KeptMemory(spark, f"file://{tmp_path}", buckets=16)
    store.upsert(memory(spark, [(f"k{i}", f"v{i}", i) for i in range(400)]))
    before = dict(store.version.held)
    assert len(before) == 16 and store.version.rows == 400 and store.version.chars == sum(len(f"v{i}") for i in range(400))
    store.upsert(memory(spark, [("k7", "new", 1000), ("k8", "older", 2)]))
    changed = {b for b, v in store.version.held.items() if v != before[b]}
    one = store.touched(memory(spark, [("k7", "", 0), ("k8", "", 0)]))
    assert changed == set(one) and len(list(tmp_path.glob("data/d-000000000002-*/bucket=*"))) == len(one)
    assert store.get("k7").first().value == "new" and store.get("k8").first().value == "v8"
    store.delete(memory(spark, [("k9", "", 0), ("none", "", 0)]))
    assert store.version.rows == 399 and store.get("k9").isEmpty()
    assert store.lookup(memory(spark, [("k1", "", 0), ("k9", "", 0)])).count() == 1
    assert store.clear() == 399 and store.frame().count() == 0
    store.upsert(memory(spark, [("again", "x", 1)]))
    assert KeptMemory(spark, f"file://{tmp_path}").frame().count() == 1


def test_rows_without_key_repeats_and_nothing(spark, tmp_path):
    store = KeptMemory(spark, f"file://{tmp_path}", buckets=4)
    assert store.upsert(memory(spark, [])).number == 0 and store.frame().count() == 0
    store.write(memory(spark, [(None, "x", 1), ("a", "", 1), ("b", "old", 1), ("b", "new", 2), ("ü", "日本", 3), ("", "empty key", 4)]))
    assert {(r.mem_key, r.value) for r in store.frame().collect()} == {("b", "new"), ("ü", "日本"), ("", "empty key")}


def test_caps_agree_with_the_frames(spark, tmp_path):
    rows = memory(spark, [(f"k{i:03}", "x" * (i % 7 + 1), i % 50) for i in range(300)])
    store = KeptMemory(spark, f"file://{tmp_path}", buckets=8)
    store.put(rows, 200, 500, batch=20)
    frame = rows.withColumnRenamed("value", "content")
    want = C.keep_chars(C.keep_newest(frame, 200, "mem_key"), 500, "mem_key", 20)
    assert {r.mem_key for r in store.frame().collect()} == {r.mem_key for r in want.collect()}
    assert 0 < store.version.rows < 200


def test_of_two_writers_the_second_fails(spark, tmp_path):
    at = f"file://{tmp_path}"
    a, b = KeptMemory(spark, at, 4), KeptMemory(spark, at, 4)
    a.upsert(memory(spark, [("a", "1", 1)]))
    with pytest.raises(Conflict):
        b.upsert(memory(spark, [("b", "1", 1)]))
    assert b.refresh().number == 1 and len(list(tmp_path.glob("data/*"))) == 1
    b.upsert(memory(spark, [("b", "1", 1)]))
    assert {r.mem_key for r in b.frame().collect()} == {"a", "b"}


def test_readers_keep_their_version_and_dead_writers_are_skipped(spark, tmp_path):
    store = KeptMemory(spark, f"file://{tmp_path}", buckets=2)
    store.upsert(memory(spark, [("a", "1", 1), ("b", "1", 1)]))
    opened = store.frame()
    store.upsert(memory(spark, [("a", "2", 2), ("b", "2", 2)]))
    assert {r.value for r in opened.collect()} == {"1"}
    (tmp_path / "manifests" / "m-000000000003").write_text('{"number": 3, "buc')
    again = KeptMemory(spark, f"file://{tmp_path}")
    assert again.version.number == 2 and again.version.buckets == 2
    again.upsert(memory(spark, [("c", "3", 3)]))
    assert again.version.number == 4 and again.version.rows == 3
    for i in range(4):
        again.upsert(memory(spark, [(k, "x", 10 + i) for k in "abc"]))
    assert len(list(tmp_path.glob("manifests/m-*"))) == 2 and len(list(tmp_path.glob("data/*"))) <= 3


def test_views_are_stored_after_a_miss(spark, tmp_path):
    store = KeptCache(spark, f"file://{tmp_path}", buckets=8)
    sources = spark.createDataFrame([(f"/a/{i}.ts", f"export function f{i}() {{ return {i}; }}\n" * 3) for i in range(6)] + [("/a/none.ts", None)], "path string, content string")
    first = Z.served(store, sources, "signature", 10)
    assert first.where("language = 'cached'").count() == 0
    changed = sources.withColumn("content", F.when(F.col("path") == "/a/0.ts", F.lit("export const z = 1;")).otherwise(F.col("content")))
    second = {r.path: r for r in Z.served(store, changed, "signature", 20).collect()}
    assert second["/a/0.ts"].language != "cached" and all(second[f"/a/{i}.ts"].language == "cached" for i in range(1, 6))
    views = {r.path: r.view for r in first.collect()}
    assert all(second[f"/a/{i}.ts"].view == views[f"/a/{i}.ts"] for i in range(1, 6))
    kept = {r.file_path: r for r in store.frame().collect()}
    assert kept["/a/0.ts"].hit_count == 0 and kept["/a/1.ts"].hit_count == 1 and kept["/a/1.ts"].updated_at == 20


def test_a_cap_on_characters_holds_whatever_the_cap_on_rows(spark, tmp_path):
    store = KeptCache(spark, f"file://{tmp_path}", buckets=4, rows=1 << 40, chars=100)
    store.store(spark.range(300).selectExpr("concat('f', id) AS file_path", "'h' AS hash", "IF(id < 295, 'xx', 'x') AS content", "1L AS tokens", "1L AS original_tokens", "'t' AS type", "0L AS hit_count", "id AS updated_at"))
    # two batches of 200 rows would go for the characters of the first, but 300 rows are all there are
    assert store.version.rows == 0
    store.store(spark.range(230).selectExpr("concat('g', id) AS file_path", "'h' AS hash", "'x' AS content", "1L AS tokens", "1L AS original_tokens", "'t' AS type", "0L AS hit_count", "id AS updated_at"))
    assert {r.file_path for r in store.frame().collect()} == {f"g{i}" for i in range(200, 230)}


def test_every_file_is_served_again_beyond_the_caps_of_a_cache(spark, monkeypatch):
    """More characters than a cache of the usual caps holds, and no table of files that the driver would hold."""
    defaults = KeptCache.__init__.__defaults__
    monkeypatch.setattr(KeptCache.__init__, "__defaults__", (*defaults[:-1], 1000))
    monkeypatch.setattr(shared, "SENT", 0, raising=False)  # no table counts as few rows
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def run() -> dict[int, str]:
        bus.waitUntilEmpty()
        return {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}

    before, folder = run(), "/root/testdata/sf0.001"
    got = kept.served_views(spark, folder).groupBy("came", "hit_count").count().collect()
    n = spark.read.parquet(f"{folder}/part.parquet").selectExpr("p_partkey % 3 = 0 AS changed").groupBy("changed").count().collect()
    n = {r.changed: r["count"] for r in n}
    assert {(r.came, r.hit_count): r["count"] for r in got} == {("made", 0): n[True], ("cached", 1): n[False]}
    assert not [p for i, p in run().items() if i not in before and "BroadcastExchange" in p]
