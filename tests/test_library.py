"""Scanners, sources, stores, reports and the streaming cache on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomlight.functions import bpe
from loomlight.functions import jsontable as J
from loomlight.functions import metrics as M
from loomlight.functions import scanners as X
from loomlight.functions import text as T
from loomlight.functions.signatures import by_lines
from loomlight.operators import ask as A
from loomlight.operators import cache as C
from loomlight.operators import catalog as L
from loomlight.operators import graph as G
from loomlight.operators import images as I
from loomlight.operators import scores as V
from loomlight.sources import files as R
from loomlight.sources import report as P
from loomlight.sources import sinks as K
from loomlight.sources import store as O
from loomlight.operators.stored import open_graph
from loomlight.streaming.dedup import replay_stream


def one(spark, **columns):
    return spark.createDataFrame([(1,)], "i int").select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scanners_read_their_languages():
    py = X.scan("import os\nfrom a import b as c\nclass A(B):\n  def m(self, x: int=1, s=')'): pass\nasync def f(*a): ...\n", "python")
    assert py == {"imports": ["import os", "from a import b as c"], "exports": [], "functions": ["def m(self, x: int=1, s=')')", "def f(*a)"], "classes": ["class A"]}
    js = X.scan("import {a} from './a';\n// function no() {}\nconst s = 'class No {';\nexport function f(a, b): T {\n}\nclass K {\n  run(x) {\n if (x) { call(y) }\n }\n}\nconst g = async (y) => y;\nexports.q = 1;\nmodule.exports = f;\n", "typescript")
    assert js["imports"] == ["import {a} from './a';"] and js["functions"] == ["function f(a, b): T", "function run(x)", "function g(y)"] and js["classes"] == ["class K"]
    assert js["exports"] == ["export function f(a, b): T {", "exports.q = ...", "module.exports = ..."]
    more = X.scan("export type T = {\n  a: string;\n};\nexport const add = (a: number,\n  b = 'x(') => a;\nexport { p,\n  q as r } from './z';\nabstract class No {}\nexport default class Yes {}\nconst o = function inner() {};\nfunction* gen() {}\n", "typescript")
    assert more["exports"] == ["export type T = { a: string; };", "export const add = (a: number, b = 'x(') => a;", "export { p, q as r } from './z';", "export default class Yes {}"]
    assert more["functions"] == ["function add(a: number,\n  b = 'x(')"] and more["classes"] == ["class Yes"]
    cases = {
        "java": ("import a.b;\npublic class A {\n  A(String s) {}\n  public int f(int x) throws E {\n if (x) { g(x); } return new B(x);\n } }\ninterface I { void h(); }", ["import a.b;"], ["A(String s)", "f(int x)", "h()"], ["class A", "interface I"]),
        "csharp": ("using A.B;\nnamespace N {\nclass A {\n  public int F(int x) => G(x);\n}\nrecord R(int a);\n}", ["using A.B;"], ["F(int x)"], ["class A", "record R"]),
        "go": ('import "fmt"\nimport (\n\t"os"\n)\nfunc (s *S) Run(a int) (int, error) {\n}\ntype S struct {\n}\ntype X = int', ['import "fmt"', '"fmt"', "import (", '"os"'], ["func Run(a int) (int, error)"], ["type S struct {"]),
        "rust": ("use a::b;\npub fn f(x: u8) -> u8 { x }\nstruct S;\nimpl T for S {}", ["use a::b;"], ["fn f(x: u8) u8"], ["struct S", "impl S"]),
        "php": ("<?php\nuse A\\B;\nclass S {\n function m($x) {} }\nfunction g($y) {}", ["use A\\B;"], ["function m($x)", "function g()"], ["class S"]),
        "ruby": ('require "json"\nmodule M\nclass S\ndef t(x)\nend\ndef self.no(y)\nend', ['require "json"'], ["def t(x)"], ["module M", "class S"]),
        "kotlin": ("import a.b\nclass S { fun k(x: Int) = x }", ["import a.b"], ["fun k(x: Int)"], ["class S"]),
        "swift": ("import Foundation\npublic class S: B { func m(a: Int) -> Int {} }\nprotocol P { func req() }", ["import Foundation"], ["func m(a: Int) -> Int"], ["public class S: B", "protocol P"]),
        "bash": ("source ./h.sh\nrun() {\n}\nfunction go {\n}", ["source ./h.sh"], ["run()", "function go"], []),
        "cpp": ("#include <a>\nint f(int x) {\n return g(x); }\nchar* d(int);\nstruct S { S() : n(1) {} int n; };", ["#include <a>"], ["f(int x)", "f", "d", "S()", "S"], ["struct S"]),
        "css": ("@import 'a.css';\n.a, .b > c { color: red }\n#d{}", ["@import 'a.css';"], [".a, .b > c", "#d"], []),
        "html": ("<script src='x'>go()\n</script><div id=\"main\"><p id='q'></p><br id='no'/></div>", ["<script src='x'>go()"], [], ['<div id="main">', '<p id="q">']),
    }
    for lang, (source, imports, functions, classes) in cases.items():
        got = X.scan(source, lang)
        assert (got["imports"], got["functions"], got["classes"]) == (imports, functions, classes), lang
    assert X.scan("def broken(", "python") is None and X.scan("a: 1", "yaml") is None and X.scan("{}", "json") == X._empty()


def test_scanner_falls_back_to_lines(spark):
    rows = [("def f(:\n", "python"), ("key: 1\n  sub: 2", "yaml"), ("def f(x): pass", "python"), (None, "python"), ("# A\ntext\n## B", "markdown")]
    got = spark.createDataFrame(rows, "content string, lang string").select(X.signature(F.col("content"), F.col("lang")).alias("s")).collect()
    assert got[0].s.functions == ["def f(:"] and got[1].s.classes == ["key: 1", "sub: 2"] and got[2].s.functions == ["def f(x)"] and got[4].s.classes == ["# A", "## B"]


def test_sources(spark, tmp_path):
    for name, text in {"a.py": "import os", "sub/b.ts": 'import {x} from "../c.js"', "c.ts": "export function x() {}", "node_modules/d.js": "no", ".h/e.js": "no", "f.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    d = R.read_files(spark, str(tmp_path))
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in d.collect()) == ["/a.py", "/c.ts", "/sub/b.ts"]
    few = R.read_files(spark, str(tmp_path), most=2).collect()
    assert len(few) == 2 and all(r.truncated for r in few)
    nodes, edges = G.build(d)
    assert {(r.src.rsplit("/", 1)[1], r.dst.rsplit("/", 1)[1]) for r in edges.where("kind = 'imports'").collect()} == {("b.ts", "c.ts")}
    assert nodes.where("kind = 'import'").first().name.startswith("x (from ")
    assert R.resolve("a.py", str(tmp_path)).name == "a.py"
    for bad, error in (("", ValueError), ("../x", PermissionError), ("none.py", FileNotFoundError), ("/etc/passwd", PermissionError)):
        with pytest.raises(error):
            R.resolve(bad, str(tmp_path))
    (tmp_path / "r.md").write_text("x")
    assert R.find_report(str(tmp_path / "sub"), ("r.md",)) == tmp_path / "r.md"
    (tmp_path / "p.json").write_text(json.dumps({"servers": {"s": {"command": "c", "args": [1], "disabled": True}}}))
    assert R.read_catalog(spark, str(tmp_path / "p.json")).first().args == ["1"]
    for text, error in (("{", "not valid JSON"), ("[]", "JSON object"), ('{"servers": []}', "object `servers`"), ('{"servers": {"s": 1}}', "must be an object"), ('{"servers": {"s": {}}}', "needs a `command`"), ('{"servers": {"s": {"command": ""}}}', "needs a `command`")):
        (tmp_path / "q.json").write_text(text)
        with pytest.raises(ValueError, match=error):
            R.read_catalog(spark, str(tmp_path / "q.json"))
    assert R.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError, match="can't be read"):
        R.read_catalog(spark, str(tmp_path / "sub"))
    report = tmp_path / "out" / "r.md"
    report.parent.mkdir()
    report.write_text("x")
    assert R.find_report("/", (), named=str(report)) == report and R.find_report(str(tmp_path / "sub"), ("none.md",), named=str(tmp_path / "gone")) is None
    assert R.workspace_root(str(report)) == tmp_path and R.code_root(None, str(tmp_path)) == R.code_root(str(tmp_path), "/") == tmp_path


def test_walkers(spark, tmp_path):
    for name in ("a.ts", "tests/b.ts", ".h/c.js", "d.py", "node_modules/e.js", "pkg/__init__.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("let x = 1")
    (tmp_path / "big.ts").write_text("x" * 100)
    got = R.read_files(spark, str(tmp_path), max_bytes=50, script=True).collect()
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in got) == ["/.h/c.js", "/a.ts"] and not any(r.truncated for r in got)
    names = lambda d: sorted(r.path.removeprefix(str(tmp_path)) for r in d.collect())
    assert names(R.read_files(spark, str(tmp_path))) == ["/a.ts", "/big.ts", "/d.py", "/pkg/__init__.py", "/tests/b.ts"]
    table = spark.createDataFrame([(p, "x") for p in ("/c.ts", "/a.ts", "/b.ts")], "path string, content string")
    assert sorted((r.path, r.truncated) for r in R.capped(table, 2).collect()) == [("/a.ts", True), ("/b.ts", True)]
    assert not any(r.truncated for r in R.capped(table, 3).collect())


def test_stores(spark, tmp_path):
    at, old = f"file://{tmp_path}/store", tmp_path / "memory.json"
    empty = O.open_store(spark, at, O.MEMORY)
    assert empty.count() == 0
    old.write_text('{"legacy": "value", "b": "c"}')
    first = O.migrate(empty, f"file://{old}", 5)
    assert sorted(map(tuple, first.collect())) == [("b", "c", 5), ("legacy", "value", 5)] and not old.exists() and (tmp_path / "memory.json.migrated").exists()
    for now in (1, 2, 3):
        O.save_store(first.withColumn("updated_at", F.lit(now).cast("long")), at, now)
    again = O.open_store(spark, at, O.MEMORY)
    assert {r.updated_at for r in again.collect()} == {3} and len(list((tmp_path / "store").iterdir())) == 2
    old.write_text('{"x": "y"}')
    assert O.migrate(again, f"file://{old}", 9).count() == 2 and old.exists()  # only into an empty store
    O.write_json(again, str(tmp_path / "out"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))) == {"legacy": "value", "b": "c"}


def test_sinks(spark, tmp_path, capsys):
    measured = spark.createDataFrame([("a.ts", "typescript", 1000, 100), ("b.py", "python", 500, 500)], "path string, language string, original_tokens long, optimized_tokens long")
    text = K.benchmark_report(measured, "/src", 2.0)
    assert "| 1.5k | 600 | 60% |" in text and "| typescript | 1 | 1.0k | 100 | 90% |" in text and "Wall time: 2000 ms (1 files a second)" in text and "| a.ts | typescript |" in text
    K.write_report(text, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == text
    K.write_report("shown")
    assert capsys.readouterr().out == "shown"
    assert K.envelope(lambda: spark.range(1))["content"] == '[{"id": 0}]' and not K.envelope(lambda: "x")["is_error"]
    failed = K.envelope(lambda: 1 / 0)
    assert failed["is_error"] and json.loads(failed["content"]) == {"error": "division by zero"}
    K.logger("warn").info("no")
    K.logger("info").info("yes")
    K.logger("info", quiet=True).error("no")
    assert capsys.readouterr().err == "[loomlight] INFO yes\n"


def test_tokens_by_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello world", "", " \n", "née 日本 <|endoftext|>", "a" * 1000, None]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) if x and x.strip() else 0 for x in texts]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    with M.counting(bpe.counter(path)):
        counted = df.select(M.tokens(F.col("text")).alias("n")).collect()
    assert [r.n for r in counted] == want
    assert [r.n for r in df.select(M.tokens(F.col("text")).alias("n")).collect()] == [3, 0, 0, 5, 250, 0]


def test_tokens_by_distinct_pieces_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    odd = ["", " ", None, " \n\t ", "a  b\n\n c   ", "it's we'll I'd they've 'S", "née\u00a0x\u3000 日本語 12³ ½ ", "x\u200by \x1c\x1d \x85 \u2028z", "😀👩‍👩‍👧 <|endoftext|>", "a" * 3000 + " " * 5000 + "1" * 2000, "Ünïcödé ẞ ǅ", "----====>>>> \r\n\r\n  end"]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(4, "twice"), (None, "no id")], "id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("id"), "text")
    both = texts.unionByName(docs).cache()
    want: dict = {}
    for r in both.collect():
        n = len(t.encode(r.text, add_special_tokens=False).ids) if r.text and not r.text.isspace() else 0
        want[r.id] = want.get(r.id, 0) + n
    assert {r.id: r.tokens for r in bpe.token_counts(both, path).collect()} == want
    assert bpe.token_counts(both.limit(0), path).count() == 0


def test_graph_is_kept_by_its_manifest(spark, tmp_path):
    rows = [(f"/s/{i}.ts", f"import {{ x }} from './{i + 1}.js';\nexport function f{i}() {{}}", 1, 10) for i in range(4)]
    files = spark.createDataFrame(rows, "path string, content string, mtime_ms long, size long")
    nodes, edges = (graph := open_graph(files, f"file://{tmp_path}", digits=1)).nodes, graph.edges
    assert nodes.count() == 4 * 3 + 3 and edges.where("kind = 'imports'").count() == 3
    assert graph.refresh(files).scanned == 0 and graph.refresh(files, rebuild=True).scanned == 4
    assert graph.refresh(files.withColumn("mtime_ms", F.lit(2).cast("long"))).scanned == 4
    nodes, edges = graph.nodes, graph.edges
    got = A.ask(nodes, edges, "f0", "depends_on").first()
    assert got.nodes_traversed == 2 and 'Dependencies of "f0"' in got.result
    got = A.ask(nodes, edges, "/s/0.ts", "dependents").first()
    assert got.nodes_traversed >= 2
    assert "Modules" in A.ask(nodes, edges, "", "stats").first().result or "Files: 4" in A.ask(nodes, edges, "", "stats").first().result
    none = A.ask(nodes, edges, "zzz", "search").first()
    assert none.nodes_traversed == 0 and none.result == 'No symbols matching "zzz".' and none.source == "symbol"
    assert A.ask(nodes, edges, "zzz", "file_symbols").first().result == 'No files matching "zzz".'
    assert A.ask(nodes, edges, "", "report_map").first().result == "No report."
    with pytest.raises(ValueError, match="unknown kind"):
        A.ask(nodes, edges, "", "other")


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (12).to_bytes(2, "little") + (34).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + b"\0" * 8
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    df = spark.createDataFrame([(bytearray(x),) for x in (png, gif, jpeg, webp, b"nope", b"\xff\xd8\xff")] + [(None,)], "content binary")
    got = [(r.s.width, r.s.height) for r in df.select(I.image_size("content").alias("s")).collect()]
    assert got == [(640, 480), (12, 34), (400, 300), (100, 50), (None, None), (None, None), (None, None)]


def test_validation_modes(spark):
    truth = spark.createDataFrame([("src/m.ts", ["alpha", "beta"])], "path string, symbols array<string>")
    assert V.validate(truth, "prompts").count() == 4
    text, status = V.report(V.validate(truth, "run"))
    assert status == 0 and "score: " in text
    assert V.report(V.validate(truth, "run", by="faulty"))[1] == 1
    for call, error in ((lambda: V.validate(truth, "score"), "answers are needed"), (lambda: V.validate(truth, "x"), "unknown mode"), (lambda: V.validate(truth, by="x"), "unknown provider")):
        with pytest.raises(ValueError, match=error):
            call()


def test_catalog_status_and_refresh(spark):
    open_ = spark.createDataFrame([("s", 1000, 3), ("t", 4600, None)], "server string, connected_at long, tools long")
    assert sorted(map(tuple, L.status(open_, 6000).collect())) == [("s", 5, 3), ("t", 1, 0)]
    tool = lambda *rows: spark.createDataFrame(rows, "server string, name string")
    got = L.refresh(tool(("s", "old"), ("t", "kept")), tool(("s", "new"), ("u", "not asked")), spark.createDataFrame([("s",)], "server string"))
    assert sorted(map(tuple, got.collect())) == [("s", "new"), ("t", "kept")]


def test_caps_of_the_cache(spark):
    store = spark.createDataFrame([(f"f{i}", "x" * 10, i) for i in range(20)], "file_path string, content string, updated_at long")
    kept = lambda **o: {int(r.file_path[1:]) for r in C.keep_chars(store, 50, **o).collect()}
    assert kept(batch=1) == set(range(15, 20)) and kept(batch=4) == set(range(16, 20))
    assert kept(batch=2, batches=3) == set(range(6, 20))  # three batches go, whatever is left
    assert {r.updated_at for r in C.keep_newest(store, 3).collect()} == {17, 18, 19}
    assert kept(batch=7, batches=9) == set() and C.keep_newest(store, 0).count() == 0 and C.keep_newest(store, 99).count() == 20


def test_cache_traces(spark):
    steps = [("store", "a"), ("check", "a"), ("check", "a"), ("check", "b"), ("check", "a"), ("store", "b"), ("check", "b")]
    trace = spark.createDataFrame([(i, s, "p", h) for i, (s, h) in enumerate(steps)] + [(9, "check", "q", "a")], "seq long, action string, path string, hash string")
    got = {r.seq: (r.status, r.hits) for r in C.replay(trace).collect()}
    assert got == {0: ("stored", 0), 1: ("hit", 1), 2: ("hit", 2), 3: ("update", 2), 4: ("miss", 2), 5: ("stored", 0), 6: ("hit", 1), 9: ("miss", 0)}
    store = spark.createDataFrame([(f"f{i}", "x" * i, i, 10, 20, 1) for i in range(1, 8)], "file_path string, content string, updated_at long, tokens long, original_tokens long, hit_count long")
    assert {r.file_path for r in C.keep_chars(store, 13).collect()} == {"f7", "f6"}
    assert {r.file_path for r in C.keep_chars(store, 17, batch=3).collect()} == {"f7"}
    assert C.statistics(store).first().asDict() == {"entries": 7, "total_hits": 7, "tokens_saved": 70}
    assert C.statistics(store.limit(0)).first().asDict() == {"entries": 0, "total_hits": 0, "tokens_saved": 0}


def test_streaming_cache(spark, tmp_path):
    rows = [(0, "store", "p", "a"), (1, "check", "p", "a"), (2, "check", "p", "b"), (3, "check", "p", "b"), (4, "check", "q", "a")]
    schema = "seq long, action string, path string, hash string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = replay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.status for r in spark.table("replayed").collect()} == {0: "stored", 1: "hit", 2: "update", 3: "miss", 4: "miss"}


def test_json_tables(spark):
    text = '{"status":"ok","users":[{"id":1,"tags":["a","b"]},{"id":2,"tags":null}],"meta":{"page":1},"mixed":[1,2,3,4]}'
    r = one(spark, a=J.toon(F.lit(text)), b=J.toon(F.lit("[1, 2]")), c=J.toon(F.lit("nope")), d=J.parameters(F.lit('{"properties":{"a":{"type":"array","items":{"type":"array","items":{"type":"number"}}},"e":{"enum":[1,2,3,4,5,6]}},"required":["e"]}')))
    assert r.a == "status: ok\n[users]\nid|tags\n1|a,b\n2|\n\n[meta]\npage: 1\n\nmixed: [4 items]"
    assert (r.b, r.c, r.d) == ("[1,2]", "nope", "[a:num[][]], e:1|2|3|4|5|…")


def test_text_functions(spark):
    py, js = F.lit("python"), F.lit("typescript")
    r = one(spark, a=T.parse_import(F.lit("from a.b import c as d, e"), py), b=T.parse_import(F.lit('import D, { x as y, z } from "./m"'), js), c=T.parse_import(F.lit('import * as N from "n"'), js), d=T.parse_import(F.lit("nothing"), js), e=T.import_candidates(F.lit("../c.js"), F.lit("/a/b/f.ts")), f=T.truth_symbols(F.lit("export { a, b as c };\n// export const no = 1\nexport const k = 1")), g=T.canonical_exports(by_lines(F.lit("export { a, b as c }\nexport const k = 1\nfunction f() {}"), js)), h=M.savings(F.lit(100), F.lit(200)), i=T.language(F.lit("/x/.js")), j=T.language(F.lit("/x/A.TSX")), k=I.resized(F.lit(1024), F.lit(300)), l=T.grammar(F.lit("a.js"), F.lit("// @flow\nx")))
    assert (r.a.source, r.a.names, r.b.names, r.c.names, r.d) == ("a.b", ["c", "e"], ["D", "x", "z"], ["N"], None)
    assert r.e[:4] == ["/a/c.js", "/a/c.ts", "/a/c.tsx", "/a/c.js.ts"] and r.f == ["a", "c", "k"] and r.g == ["export", "f", "k"]
    assert r.h.expanded and r.h.savings_percent == 0 and (r.i, r.j, r.l) == ("unknown", "tsx", "tsx") and (r.k.width, r.k.height) == (512, 150)


def test_report(spark):
    text = "# Graph Report - fixture (2026-05-17)\n## Community Hubs\n- Community A\n## God Nodes\n1. `Hub` - 26 edges\n## Summary\n- 10 nodes\n## End"
    r = one(spark, p=P.parsed(F.lit(text)), a=P.found(F.lit(text), "hub"), b=P.found(F.lit(text), "nodes"), c=P.found(F.lit(text), "zzz"))
    assert r.p.title == "fixture" and [(h.name, h.edges) for h in r.p.hubs] == [("Hub", 26)] and len(r.p.community_lines) == 2
    assert r.a == ["Hub (26 edges)", "## Community Hubs"] and r.b == ["- 10 nodes"] and r.c == []


def test_control_and_missing_answers(spark):
    from loomlight.operators import control, scores
    from loomlight.plans import catalogue

    assert {r.component for r in control.health(spark).collect()} >= {"spark", "shared folder", "pyarrow"}
    assert control.topics(spark, catalogue.QUERIES).count() == len(catalogue.QUERIES)
    assert control.help_on(spark).count() == len(control.HELP) and "No such topic" in control.help_on(spark, "nope").first().summary and control.help_on(spark, "Graph").first().summary == control.HELP["graph"]
    truth = spark.createDataFrame([("src/m.ts", ["alpha", "beta"]), ("src/n.ts", [])], "path string, symbols array<string>")
    none = spark.createDataFrame([], "path string, prompt_id string, text string")
    got = {r.path: (r.recall, r.usage, r.specificity, r.score, r.verdict) for r in scores.score_answers(none, truth).collect()}
    assert got == {"src/m.ts": (0.0, 0.0, 0.0, 0, "broken"), "src/n.ts": (1.0, 0.0, 0.0, 40, "lossy")}
    r = one(spark, a=scores.usage(F.lit('import { alpha } from "./m";\nalpha()'), F.array(F.lit("alpha"), F.lit("beta")), F.lit("src/m.ts")), b=scores.usage(F.lit("alpha beta"), F.array(F.lit("alpha"), F.lit("beta")), F.lit("src/m.ts")))
    assert (round(r.a, 6), round(r.b, 6)) == (0.333333, 0.333333)


def test_empty_tables(spark):
    assert C.replay(spark.createDataFrame([], "seq long, action string, path string, hash string")).count() == 0
    nodes, edges = G.build(spark.createDataFrame([], "path string, content string"))
    assert nodes.count() == edges.count() == 0
    assert G.statistics(nodes, edges).first().nodes == 0
    assert G.traverse(edges, spark.createDataFrame([], "key string")).count() == 0
