"""The stored graph follows its corpus: same rows as a full build, few files read, no shuffle of links."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomlight.operators import graph as G
from loomlight.operators import stored
from loomlight.operators.stored import StoredGraph
from loomlight.plans import code

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def corpus(spark, state):
    data = [(p, f"import {{ x{t} }} from './{t}.js';\nexport function f{n}() {{}}\nclass K{n} {{", n, 10) for p, (t, n) in state.items()]
    return spark.createDataFrame(data, "path string, content string, mtime_ms long, size long")


def same(graph, files):
    nodes, edges = G.build(files)
    assert rows(graph.nodes.select(*nodes.columns)) == rows(nodes) and rows(graph.edges.select(*edges.columns)) == rows(edges)


def test_a_changing_corpus(spark, tmp_path):
    chance, graph = random.Random(8), StoredGraph(spark, f"file://{tmp_path}", digits=1)
    state = {f"/s/{i}.ts": (i + 1, 1) for i in range(24)}
    assert graph.refresh(corpus(spark, state)).scanned == 24
    same(graph, corpus(spark, state))
    for step in range(1, 3):
        gone, changed = chance.sample(sorted(state), 2), chance.sample(sorted(state), 3)
        new = {f"/s/{100 * step + i}.ts": (i, 1) for i in range(41, 43)}
        before = dict(state)
        state |= {p: (state[p][0], state[p][1] + 1) for p in changed} | new
        state = {p: v for p, v in state.items() if p not in gone}
        done = graph.refresh(corpus(spark, state))
        assert done.scanned == sum(before.get(p) != v for p, v in state.items()) and done.parts < 16
        same(graph, corpus(spark, state))
    assert graph.refresh(corpus(spark, state)).parts == 0
    assert graph.refresh(corpus(spark, {})).scanned == 0 and graph.nodes.count() == graph.edges.count() == 0


def test_a_target_that_comes_or_goes_relinks_others(spark, tmp_path):
    graph = StoredGraph(spark, f"file://{tmp_path}", digits=2)
    state = {f"/s/{i}.ts": (500, 1) for i in range(30)}
    graph.refresh(corpus(spark, state))
    assert graph.edges.where("kind = 'imports'").count() == 0
    done = graph.refresh(corpus(spark, state | {"/s/500.ts": (0, 1)}))
    assert (done.parts, done.scanned) == (1, 1) and done.relinked > 10
    assert graph.edges.where("kind = 'imports'").count() == 31
    done = graph.refresh(corpus(spark, state))
    assert done.scanned == 0 and graph.edges.where("kind = 'imports'").count() == 0
    same(graph, corpus(spark, state))


def test_a_refresh_that_dies_is_made_up_for(spark, tmp_path, monkeypatch):
    graph = StoredGraph(spark, f"file://{tmp_path}", digits=1)
    state = {f"/s/{i}.ts": (i + 1, 1) for i in range(20)}
    graph.refresh(corpus(spark, state))
    after = {p: v for p, v in state.items() if p != "/s/5.ts"} | {"/s/3.ts": (9, 2), "/s/99.ts": (2, 1)}
    replace = StoredGraph._replace
    for dies in ("edges", "sources"):

        def fails(self, name, *a, dies=dies):
            if name == dies:
                raise RuntimeError("gone")
            replace(self, name, *a)

        monkeypatch.setattr(StoredGraph, "_replace", fails)
        with pytest.raises(RuntimeError):
            graph.refresh(corpus(spark, after))
    monkeypatch.setattr(StoredGraph, "_replace", replace)
    graph.refresh(corpus(spark, after))
    same(graph, corpus(spark, after))


def test_few_files_are_read_of_a_corpus_that_changes_little(spark, tmp_path):
    before, after = code.changing(spark, SF)
    graph = StoredGraph(spark, f"file://{tmp_path}", code.DIGITS)
    assert graph.refresh(before).scanned == before.count()
    done = graph.refresh(after)
    assert done.scanned == 4 and after.count() == 198  # of 200 files two are new and two are changed


def test_hops_do_not_shuffle_links(spark):
    graph = code.stored(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for incoming in (False, True):
            links, seeds = graph.links(incoming), graph.nodes.where("kind = 'module'").select(F.col("key").alias("at"))
            plan = links.join(seeds, "at", "left_semi")._jdf.queryExecution().executedPlan().toString()
            by_links = plan[: plan.index("loomlight_")].splitlines()[-2:]
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and not any("Exchange" in line for line in by_links)
        found = graph.traverse(graph.nodes.where("kind = 'module'").limit(3).select("key"), incoming=True)
        assert found.count() >= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_by_grams(spark):
    graph = code.stored(spark, SF)
    nodes = graph.nodes.collect()
    chance, queries = random.Random(9), ["", "f", "FN", "zzz", "mod:/src/m1/", "né", "İab"]
    for n in chance.sample(nodes, 6):
        a = chance.randrange(len(n.key) - 3)
        queries += [n.key[a : a + chance.randint(3, 9)].upper(), n.name[:3]]
    for q in queries:
        want = sorted(n.key for n in nodes if q.lower() in n.name.lower() or q.lower() in n.key.lower())
        assert sorted(r.key for r in graph.search(q).collect()) == want
    assert graph.candidates("fn1").count() < len(nodes) / 2


def test_postings_grow_with_blocks_not_with_nodes(spark):
    nodes = spark.range(3000).selectExpr("'p0' AS part", "'/a.ts' AS file", "concat('fn', id) AS name", "concat('fn:/a.ts:fn', id) AS key")
    texts = [r.key for r in nodes.collect()]
    got = [(r.part, r.block, r.gram) for r in stored.postings(nodes).collect()]
    assert len(got) == len(set(got)) and {g[2] for g in got} == {t[i : i + 3] for t in texts for i in range(len(t) - 2)}
    assert len({g[:2] for g in got}) == 1


def test_postings_hold_names_that_keys_do_not(spark):
    nodes = spark.createDataFrame([("p0", "/a.ts", "N (from /Q.ts)", "imp:/a.ts:N"), ("p0", "/b.ts", "é", "k")], "part string, file string, name string, key string")
    grams = {r.gram for r in stored.postings(nodes).collect()}
    assert {"n (", "/q.", "imp", "s:n"} <= grams and all(len(g) == 3 for g in grams)


def test_searches_neither_sort_nor_shuffle_what_they_find(spark):
    plan = code.graph_searches(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_a_first_build_makes_contents_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(n):
        made.add(1)
        return f"export function f{n}() {{}}"

    d = spark.range(40).select(F.concat(F.lit("/s/"), "id", F.lit(".ts")).alias("path"), content.asNondeterministic()("id").alias("content"))
    graph = StoredGraph(spark, f"file://{tmp_path}", digits=1)
    assert graph.refresh(d.withColumns({"mtime_ms": F.xxhash64("content"), "size": F.length("content")})).scanned == 40
    assert made.value == 40


def test_what_is_declared_twice(spark, tmp_path):
    twice = "import { n } from './1.js';\nimport { n } from './2.js';\nfunction f() {}\nfunction f() {}\nclass f {\n}"
    files = spark.createDataFrame([("/s/0.ts", twice, 1, 1), ("/s/1.ts", "", 1, 1), ("/s/2.ts", "", 1, 1)], "path string, content string, mtime_ms long, size long")
    graph = StoredGraph(spark, f"file://{tmp_path}", digits=1)
    graph.refresh(files)
    got = {(r.key, r.name, r.kind, *r.ord) for r in graph.nodes.where("file = '/s/0.ts'").collect()}
    assert got == {("mod:/s/0.ts", "/s/0.ts", "module", -1, 0), ("fn:/s/0.ts:f", "f", "function", 0, 0), ("cls:/s/0.ts:f", "f", "class", 1, 0), ("imp:/s/0.ts:n", "n (from /s/2.ts)", "import", 2, 0)}
    edges = sorted((r.dst, r.ord.pos) for r in graph.edges.where("src = 'mod:/s/0.ts'").collect())
    assert edges == [("cls:/s/0.ts:f", 0), ("fn:/s/0.ts:f", 0), ("fn:/s/0.ts:f", 1), ("mod:/s/1.ts", 0), ("mod:/s/2.ts", 1)]


def test_links_are_dealt_out_by_one_shuffle(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert G.links(edges, True, 32)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_imports_are_parsed_once(spark):
    sigs = spark.createDataFrame([], f"path string, language string, sig {stored._SIG}")
    plan = G.wanted(sigs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line] and plan.count("aggregate(") == 1
