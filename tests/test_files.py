"""Discovery and scanning: nothing is lost, and the time grows with the text."""

from __future__ import annotations

import ast
import os
import time

from loomlight.functions import scanners as X
from loomlight.sources import files as R


def tree(root, names):
    for name, text in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_big_files_take_no_place_under_the_cap(spark, tmp_path):
    tree(tmp_path, {"a.py": "x" * 5000, **{f"{c}.py": "y" for c in "bcde"}})
    got = R.read_files(spark, str(tmp_path), most=2, max_bytes=1000).collect()
    assert sorted(os.path.basename(r.path) for r in got) == ["b.py", "c.py"] and all(r.truncated for r in got)
    got = R.read_files(spark, str(tmp_path), most=4, max_bytes=1000).collect()
    assert len(got) == 4 and not any(r.truncated for r in got)


def test_discovery_finds_what_a_walk_finds(spark, tmp_path):
    names = {f"{'d' * (i % 7 + 1)}/{'e' * (i % 3)}/f{i}{s}": "x" for i, s in enumerate([".py", ".ts", ".bin", ".MD", ""] * 40)}
    tree(tmp_path, names | {"node_modules/a.js": "", ".hid/b.py": "", "deep/" * 15 + "c.go": "", "d/__init__.py": "", "x/.dot.py": ""})
    os.symlink(tmp_path, tmp_path / "loop")
    (tmp_path / "locked.py").write_text("")
    want = set()
    for folder, folders, files in os.walk(tmp_path):
        folders[:] = [f for f in folders if f not in R.IGNORED and not f.startswith(".")]
        want |= {os.path.join(folder, f) for f in files if os.path.splitext(f)[1].lower() in R.SUFFIXES}
    assert {r.path for r in R.discover(spark, str(tmp_path)).collect()} == want
    assert R.read_files(spark, str(tmp_path), most=None).count() == len(want)
    assert R.discover(spark, str(tmp_path / "none")).count() == 0


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    tree(tmp_path, {"a.py": "x", "b.py": "y"})
    d = R.read_files(spark, str(tmp_path))
    (tmp_path / "b.py").unlink()
    assert sorted((os.path.basename(r.path), r.content) for r in d.collect()) == [("a.py", "x"), ("b.py", None)]


def test_scanning_python_is_linear():
    source = "import os, sys\n" + "".join(f"class C{i}:\n    '''née'''; é = 1\n    def f{i}(self, a=')', *, b: int = {i}) -> int:\n        return a\n" for i in range(11_000))
    assert len(source) > 1_000_000
    began = time.process_time()
    found = X.python(source)
    assert time.process_time() - began < 10  # seconds of this processor; a scan that is quadratic takes minutes
    assert found["functions"][7] == "def f7(self, a=')', *, b: int = 7)" and len(found["functions"]) == len(found["classes"]) == 11_000


def test_places_are_those_of_the_parser():
    source = "import a\nx = 'é'; import b as ü\r\ndef f(p, é='née'): pass\rclass K:\n  é = 1; \n  async def g(self, z=(1,\n 2)): import c\n"
    places = X._Places(source)
    for n in ast.walk(ast.parse(source)):
        if hasattr(n, "end_lineno"):
            assert source[places.at(n.lineno, n.col_offset) : places.at(n.end_lineno, n.end_col_offset)].replace("\r\n", "\n").replace("\r", "\n") == ast.get_source_segment(source, n).replace("\r\n", "\n").replace("\r", "\n")
    assert X.python(source)["functions"] == ["def f(p, é='née')", "def g(self, z=(1,\n 2))"]


def test_statements_end_where_nothing_goes_on():
    t = X.Text("export const a =\n  1\nexport const b = {\n x: 1 }\nlet c = x =>\n  y\nconst d = 1\n  + 2;\nlet e")
    assert [t.source[at : t.statement(at)] for at in (0, 20, 47, 64)][0] == "export const a =\n  1"
    assert t.source[t.source.index("let c") : t.statement(t.source.index("let c"))] == "let c = x =>\n  y"
    assert t.source[t.source.index("const d") : t.statement(t.source.index("const d"))] == "const d = 1\n  + 2;"
