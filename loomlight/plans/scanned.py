"""A query per scanner: a source of each language, made of a part's key, against what its declarations must read as.

The check engine has no parser, so its side states the expected entries; `§` stands for the key in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scanners import SECTIONS, signature
from ..sources.shared import settled
from .code import parts

#: Language: (source, imports, exports, functions, classes).
SOURCES: dict[str, tuple[str, list[str], list[str], list[str], list[str]]] = {
    "javascript": (
        'import { a§ } from "./x§.js";\n// function no§(x) {}\nconst s = "class No§ {";\nfunction f§(a, b = "q(") {\n  if (a) { call§(b); }\n}\nclass C§ extends B {\n  constructor(x) { super(x); }\n  run§(y) { return y; }\n}\nconst g§ = async (z) => z;\nexports.e§ = 1;\nmodule.exports = f§;',
        ['import { a§ } from "./x§.js";'],
        ["exports.e§ = ...", "module.exports = ..."],
        ['function f§(a, b = "q(")', "function constructor(x)", "function run§(y)", "function g§(z)"],
        ["class C§"],
    ),
    "typescript": (
        'import type { T } from "./t§";\nexport async function load§<T>(id: string): Promise<T> {\n  return get(id);\n}\nexport interface Opts§ { n: number }\nexport type U§ =\n  | "a"\n  | "b";\nexport const add§ = (a: number): number => a + §;\nexport class K§ implements Opts§ {\n  private go§(s: string): void { }\n}\nabstract class No§ { abstract x(): void; }\nexport { add§ as plus };',
        ['import type { T } from "./t§";'],
        ["export async function load§<T>(id: string): Promise<T> {", "export interface Opts§ { n: number }", 'export type U§ = | "a" | "b";', "export const add§ = (a: number): number => a + §;", "export class K§ implements Opts§ {", "export { add§ as plus };"],
        ["function load§(id: string): Promise<T>", "function add§(a: number): number", "function go§(s: string): void"],
        ["interface Opts§", "class K§"],
    ),
    "python": (
        'import os\nfrom p§ import (a,\n    b)\nclass K§(Base):\n    """def no§(): pass"""\n    async def m§(self, x: int = 1, s=")") -> str:\n        def inner§(): pass\n@dec\ndef f§(*a, **k): ...',
        ["import os", "from p§ import (a,\n    b)"],
        [],
        ['def m§(self, x: int = 1, s=")")', "def inner§()", "def f§(*a, **k)"],
        ["class K§"],
    ),
    "java": (
        "package p;\nimport java.util.List;\npublic class C§ extends B {\n  private int n = f(1);\n  public C§(int a) { super(a); }\n  @Override\n  public List<String> get§(String s, int k) throws E {\n    if (s == null) { return call(s); }\n    return new Thing§(k);\n  }\n}\ninterface I§ { int h§(int x); }\nenum E§ { A }",
        ["import java.util.List;"],
        [],
        ["C§(int a)", "get§(String s, int k)", "h§(int x)"],
        ["class C§", "interface I§", "enum E§"],
    ),
    "csharp": (
        "using System;\nnamespace N§ {\n  public class C§ : B {\n    public C§(int a) : base(a) { }\n    public async Task<int> Go§(string s) { await z(s); return 1; }\n    int Twice§(int x) => x * 2;\n  }\n  interface I§ { void M§(int a); }\n  struct S§ { }\n  enum E§ { A }\n  record R§(int X);\n}",
        ["using System;"],
        [],
        ["C§(int a)", "Go§(string s)", "Twice§(int x)", "M§(int a)"],
        ["class C§", "interface I§", "struct S§", "enum E§", "record R§"],
    ),
    "cpp": (
        '#include <v§>\nclass C§ : public B {\npublic:\n  C§(int a) : n(a) {}\n  int get§() const { return f(n); }\n  virtual void draw§(int x) = 0;\n};\nstruct P§ { int x; };\nint add§(int a, int b) {\n  return g(a);\n}\nchar* dup§(const char* s);',
        ["#include <v§>"],
        [],
        ["C§(int a)", "C§", "get§() const", "get§", "draw§", "add§(int a, int b)", "add§", "dup§"],
        ["class C§", "struct P§"],
    ),
    "go": (
        'package p\nimport "fmt"\nimport (\n\t"os"\n\ts "strings"\n)\ntype S§ struct {\n\ta int\n}\ntype A§ = int\nfunc Add§(a, b int) (int, error) {\n\treturn f(a), nil\n}\nfunc (s *S§) Get§(k string) string { return k }',
        ['import "fmt"', '"fmt"', "import (", '"os"', 's "strings"'],
        [],
        ["func Add§(a, b int) (int, error)", "func Get§(k string) string"],
        ["type S§ struct {"],
    ),
    "rust": (
        "use std::io;\npub use a::{b, c§};\npub struct P§<T> { x: T }\nenum E§ { A }\ntrait T§ { fn req§(&self); }\nimpl<T> T§ for P§<T> { fn req§(&self) -> u8 { 1 } }\nfn main§(a: &'static str) { let s = \"fn no()\"; }",
        ["use std::io;", "pub use a::{b, c§};"],
        [],
        ["fn req§(&self) u8", "fn main§(a: &'static str)"],
        ["struct P§", "enum E§", "trait T§", "impl P§<T>"],
    ),
    "php": (
        "<?php\nuse A\\B§;\nfunction top§($a) { return 1; }\nclass C§ extends D { public function m§(int $x): int { return f($x); } }\ninterface I§ { public function n§($y); }",
        ["use A\\B§;"],
        [],
        ["function top§()", "function m§(int $x)", "function n§($y)"],
        ["class C§", "interface I§"],
    ),
    "ruby": (
        'require "j§"\nmodule M§\n  class A§ < B\n    # def no§(x)\n    def go§(a, b = 1)\n    end\n    def ok§?\n    end\n    def self.no§(x)\n    end\n  end\nend',
        ['require "j§"'],
        [],
        ["def go§(a, b = 1)", "def ok§?"],
        ["module M§", "class A§"],
    ),
    "kotlin": ("import a.b.C§\nclass K§(val x: Int) : B() {\n  fun go§(a: Int): Int = a\n}\nfun String.ext§(n: Int) = n", ["import a.b.C§"], [], ["fun go§(a: Int)", "fun ext§(n: Int)"], ["class K§"]),
    "swift": (
        "import Foundation\npublic class A§: B {\n  func go§(a: Int) -> Int { return a }\n}\nprotocol P§ { func req§() }\nextension A§ { static func ex§() { } }",
        ["import Foundation"],
        [],
        ["func go§(a: Int) -> Int", "static func ex§()"],
        ["public class A§: B", "protocol P§", "extension A§"],
    ),
    "bash": ('#!/bin/bash\nsource ./a§.sh\n. b§.sh\ngreet§() {\n  echo "no() {"\n}\nfunction other§ {\n  true\n}', ["source ./a§.sh", ". b§.sh"], [], ["greet§()", "function other§"], []),
    "css": ('@import "a§.css";\n/* .no§ { } */\n.a§ > b, p { color: red }\n@media (x) { .in§ { a: b } }', ['@import "a§.css";'], [], [".a§ > b, p", ".in§"], []),
    "html": ('<html><head><script src="a§.js">go()\n</script><style>p§{}</style></head><body id="b§"><div class="x" id=\'d§\'>t</div></body></html>', ['<script src="a§.js">go()', "<style>p§{}</style>"], [], [], ['<body id="b§">', '<div id="d§">']),
    "json": ('{"a": "function f§() {}", "class": §}', [], [], [], []),
    # no scanner, and a source that its scanner can't read: the line patterns answer
    "sql": ("create table t§ (id int);\nselect 1;", [], [], ["create table t§"], []),
    "python-broken": ("import os\ndef f§(x):\nclass C§:", ["import os"], [], ["def f§(x):"], ["class C§:"]),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _column(template: str) -> Column:
    key, pieces = F.col("p_partkey").cast("string"), template.split("§")
    return F.concat(*[c for i, p in enumerate(pieces) for c in ([key] if i else []) + [F.lit(p)]])


def _sql(template: str) -> str:
    return " || CAST(p_partkey AS VARCHAR) || ".join("'" + p.replace("'", "''") + "'" for p in template.split("§"))


def _register(name: str, source: str, sections: list[list[str]]) -> None:
    lang = name.split("-")[0]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = settled(parts(spark, sf).select("p_partkey"), source=_column(source))
        d = settled(d, s=signature(F.col("source"), F.lit(lang)))
        return d.select("p_partkey", *[F.array_join(f"s.{n}", " ;; ").alias(n) for n in SECTIONS])

    run.__doc__ = f"Declarations of {name} sources."
    key = f"scan_{name.replace('-', '_')}"
    QUERIES[key] = run
    ORACLE_SQL[key] = f"SELECT p_partkey, {', '.join(f'{_sql(' ;; '.join(entries))} AS {n}' for n, entries in zip(SECTIONS, sections, strict=True))} FROM part"


for _name, (_source, *_sections) in SOURCES.items():
    _register(_name, _source, _sections)
