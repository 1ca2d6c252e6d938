"""Replay by segments and caps by ranges, against what one process would do row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomlight.operators import cache as C
from loomlight.operators import scores as V
from loomlight.plans import catalogue


def by_hand(trace):
    """{(path, seq): (epoch, status, hits)}"""
    state, out = {}, {}
    for seq, action, path, h in sorted(trace, key=lambda r: (r[2], r[0])):
        epoch, stored, dead, hits = state.get(path, (0, None, True, 0))
        if action == "store":
            epoch, stored, dead, hits, status = epoch + 1, h, False, 0, "stored"
        elif dead:
            status = "miss"
        elif h is not None and stored is not None and h != stored:
            dead, status = True, "update"
        else:
            hits, status = hits + 1, "hit"
        state[path] = (epoch, stored, dead, hits)
        out[path, seq] = (epoch, status, hits)
    return out


def random_trace(seed, n, paths, stores, hashes):
    chance = random.Random(seed)
    return [(i, "store" if chance.random() < stores else "check", chance.choice(paths), chance.choice(hashes)) for i in range(n)]


TRACES = {
    "one path": random_trace(1, 900, ["p"], 0.02, ["a", "a", "a", "a", "b", None]),
    "one path, few stores": [(i, "store" if i in (100, 700) else "check", "p", "b" if i in (400, 401) else "a") for i in range(1000)],
    "one path, hits only": [(i, "store" if i == 3 else "check", "p", None if i % 5 else "a") for i in range(800)],
    "null stored": [(i, "store" if i % 300 == 50 else "check", "p", None if i % 300 == 50 else "ab"[i % 2]) for i in range(800)],
    "a hot path": random_trace(2, 1200, ["hot"] * 30 + [f"p{i}" for i in range(60)], 0.01, ["a"] * 20 + ["b"]),
    "never stored": random_trace(3, 300, ["p", "q"], 0, ["a", "b"]),
}


@pytest.mark.parametrize("name", TRACES)
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_replay_by_segments(spark, name, parts):
    df = spark.createDataFrame(TRACES[name], "seq long, action string, path string, hash string").repartition(3)
    got = {(r.path, r.seq): (r.epoch, r.status, r.hits) for r in C.replay(df, parts=parts).collect()}
    assert got == by_hand(TRACES[name])


def test_a_hot_path_is_spread(spark):
    """A third of all rows are of one path: no range, thus no task, holds more than some of them."""
    rows = random_trace(4, 6000, ["hot"] * 50 + [f"p{i}" for i in range(100)], 0.01, ["a", "b"])
    df = spark.createDataFrame(rows, "seq long, action string, path string, hash string")
    plan = C.replay(df, parts=30)
    assert {(r.path, r.seq): (r.epoch, r.status, r.hits) for r in plan.collect()} == by_hand(rows)
    assert not [line for line in plan._jdf.queryExecution().toString().splitlines() if "hashpartitioning(path#" in line and "part#" not in line and "Exchange" in line]


@pytest.mark.parametrize("batch, batches, chars", [(1, None, 300), (7, None, 300), (7, 3, 300), (5, None, 0), (300, None, 10), (1, None, 10**6), (4, 0, 5)])
def test_caps_by_ranges(spark, batch, batches, chars):
    chance = random.Random(5)
    rows = [(f"f{i}", chance.choice([None, "", "x" * chance.randint(1, 9)]), chance.choice([None, 1, 2, 3, i])) for i in range(200)]
    order = sorted(sorted(rows, key=lambda r: r[0], reverse=True), key=lambda r: -1 if r[2] is None else r[2])
    total, gone, step = sum(len(r[1] or "") for r in rows), 0, 0
    while total > chars and gone < len(order) and (batches is None or step < batches):
        total -= sum(len(r[1] or "") for r in order[gone : gone + batch])
        gone, step = gone + batch, step + 1
    df = spark.createDataFrame(rows, "file_path string, content string, updated_at long").repartition(6)
    got = {r.file_path for r in C.keep_chars(df, chars, batch=batch, batches=batches).collect()}
    assert got == {r[0] for r in order[gone:]}
    for n in (0, 1, 57, 200, 300):
        assert {r.file_path for r in C.keep_newest(df, n).collect()} == {r[0] for r in order[max(0, 200 - n) :]}
    assert C.keep_chars(df.limit(0), chars).count() == 0


@pytest.mark.parametrize("top", [0, C.CACHE_ROWS])
def test_newest_rows_by_ranges(spark, monkeypatch, top):
    """Whatever the cap, also one beyond a limit's numbers, the rows are those of the top-k."""
    monkeypatch.setattr(C, "TOP", top, raising=False)
    rows = [(f"f{i}", "x", None if i % 11 == 0 else i % 7) for i in range(100)]
    order = sorted(sorted(rows, key=lambda r: r[0], reverse=True), key=lambda r: -1 if r[2] is None else r[2])
    df = spark.createDataFrame(rows, "file_path string, content string, updated_at long").repartition(5)
    for n in (0, 1, 42, 99, 100, 1 << 40):
        assert {r.file_path for r in C.keep_newest(df, n).collect()} == {r[0] for r in order[max(0, 100 - n) :]}
    assert C.keep_newest(df.limit(0), 1 << 40).count() == 0


def test_caps_are_filters(spark):
    """Contents take part in no shuffle: the plan of what stays is the scan with a filter."""
    df = spark.createDataFrame([(f"f{i}", "x" * i, i) for i in range(50)], "file_path string, content string, updated_at long")
    kept = C.keep_chars(C.keep_newest(df, 40), 500)
    assert kept.count() == 11 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_words_have_ascii_boundaries(spark):
    cases = [("x café y", "caf", True), ("cafe", "caf", False), ("a.b", "a.b", True), ("$x", "$x", False), ("a$x", "$x", True), ("é_a", "a", False), ("a", "a", True), ("éa", "a", True), ("", "a", False)]
    df = spark.createDataFrame(cases, "answer string, symbol string, want boolean")
    assert df.select(V.named(df.answer, df.symbol).alias("got"), "want").where("got <> want OR got IS NULL").count() == 0


def test_recall_by_runs(spark):
    """Runs of word characters find what a search of the whole answer finds."""
    chance = random.Random(6)
    letters = ["a", "B", "_", "$", "1", " ", "-", ".", "é", "\n", "\u212a", "K"]
    rows = [("".join(chance.choices(letters, k=chance.randint(0, 40))), ["".join(chance.choices(letters, k=chance.randint(1, 3))) for _ in range(chance.randint(0, 6))]) for _ in range(300)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, truth array<string>").select("i", V.recall(F.col("answer"), F.col("truth")).alias("r")).collect()
    for r in got:
        answer, truth = rows[r.i]
        assert r.r == (sum(t.lower() in answer.lower() for t in truth) / len(truth) if truth else 1.0)
    assert spark.sql("SELECT CAST(NULL AS STRING) AS a, array('x') AS t").select(V.recall(F.col("a"), F.col("t"))).first()[0] == 0


def test_names_are_registered_once():
    assert catalogue.gathered([{"a": 1}, {"b": 2}]) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="registered twice"):
        catalogue.gathered([{"a": 1}, {"a": 2}])
