"""Signature scanners that read a language's own syntax; where one can't, the line patterns are the answer.

Python is parsed by its own parser and HTML by an event parser; other languages go through one scanner that blanks
strings and comments first, so that a keyword within them isn't taken for a declaration, and that knows for every place
whether it lies in the body of a type, in other braces or in none. All run in one Arrow function over batches of files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .signatures import KIND, by_lines

Found = dict[str, list[str]]
# The most characters of an entry of each sort.
LINE, EXPORT, SELECTOR, ASSET, DECLARATOR = 400, 4096, 200, 120, 200
SECTIONS = ["imports", "exports", "functions", "classes"]


def _empty() -> Found:
    return {s: [] for s in SECTIONS}


# ---- Python and HTML
class _Places:
    """Places in a source by line and column as its parser counts them: columns are bytes of UTF-8."""

    def __init__(self, source: str):
        self.source, self.lines = source, [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", source))]

    def at(self, line: int, column: int) -> int:
        start = self.lines[line - 1]
        part = self.source[start : start + column]
        return start + (column if part.isascii() else len(part.encode()[:column].decode()))


#: What a Python source declares, and the parts of a statement that hold statements; an expression holds none.
_IMPORTS = (ast.Import, ast.ImportFrom)
_DECLARED = frozenset((*_IMPORTS, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
_NESTED = ("body", "orelse", "finalbody", "handlers", "cases")


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Every statement, whatever it is nested in. Expressions, most of a tree, aren't visited."""
    stack = [tree]
    while stack:
        n = stack.pop()
        yield n
        for part in _NESTED:
            if part in n._fields:
                stack += getattr(n, part)


def python(source: str) -> Found:
    """Imports, `def name(params)` and `class Name` in the order of the source, as they are written."""
    out, places = _empty(), _Places(source)
    found = [n for n in _statements(ast.parse(source)) if type(n) in _DECLARED]
    text = None
    for n in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(n, _IMPORTS):
            out["imports"].append(source[places.at(n.lineno, n.col_offset) : places.at(n.end_lineno, n.end_col_offset)])
        elif isinstance(n, ast.ClassDef):
            out["classes"].append(f"class {n.name}")
        else:
            text = text or Text(source, PYTHON_NOISE)
            out["functions"].append(f"def {n.name}{text.brackets(places.at(n.lineno, n.col_offset))}")
    return out


class _Html(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__()
        self.found, self.source = _empty(), source
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            line, column = self.getpos()
            at = self.lines[line - 1] + column
            close = re.compile(rf"</{tag}\s*>", re.I).search(self.source, at)
            self.found["imports"].append(self.source[at : close.end() if close else None].split("\n")[0][:ASSET])
            return
        for k, v in attrs:
            if k == "id" and v:
                self.found["classes"].append(f'<{tag} id="{v}">')

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Self-closing elements have no start tag of their own."""


def html(source: str) -> Found:
    p = _Html(source)
    p.feed(source)
    p.close()
    return p.found


# ---- the scanner of the rest
_STRINGS = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
NOISE = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|`(?:\\[\s\S]|[^`\\])*`")
RUST_NOISE = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:\\[\s\S]|[^"\\])*"|'(?:\\.|[^'\\\n])'""")
HASH_NOISE = re.compile(rf"(?<!\S)\#[^\n]*|{_STRINGS}")
PHP_NOISE = re.compile(rf"(?<!\S)\#(?!\[)[^\n]*|{NOISE.pattern}")
CSS_NOISE = re.compile(rf"/\*[\s\S]*?\*/|{_STRINGS}")
PYTHON_NOISE = re.compile(rf"""\#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{_STRINGS}""")
#: Words before a brace that make it the body of a type.
TYPE_HEAD = re.compile(r"\b(?:class|interface|enum|struct|record|trait|protocol|object|extension)\b[^(){};]*(?:\([^()]*\)[^(){};]*)?$")
SPACE_HEAD = re.compile(r"\bnamespace\b[^(){};]*$")


class Text:
    """A source, and the same with comments and the insides of strings as spaces; every place stays where it was."""

    def __init__(self, source: str, noise: re.Pattern = NOISE):
        def blank(m: re.Match) -> str:
            s = m[0]
            inner = re.sub(r"[^\n]", " ", s)
            return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else inner

        self.source, self.blanked = source, noise.sub(blank, source)
        self._edges: tuple[list[int], list[str]] | None = None

    def brackets(self, at: int) -> str:
        """The bracketed text that begins at or after `at`, as it is written."""
        start, depth = self.blanked.find("(", at), 0
        for i in range(start, len(self.blanked)) if start >= 0 else ():
            depth += (self.blanked[i] == "(") - (self.blanked[i] == ")")
            if not depth:
                return self.source[start : i + 1]
        return "()"

    def head(self, at: int, ends: str = "{") -> str:
        """From `at` to the first of the ends, in one line."""
        stop = re.compile(f"[{re.escape(ends)}]").search(self.blanked, at)
        return " ".join(self.source[at : stop.start() if stop else None].split())

    def line(self, at: int) -> str:
        end = self.source.find("\n", at)
        return self.source[at : end if end >= 0 else None].strip()

    def inside(self, at: int) -> str:
        """What the innermost braces around a place are: `type`, `code`, or nothing."""
        if self._edges is None:
            places, kinds, stack = [0], [""], [""]
            for m in re.finditer(r"[{}]", self.blanked):
                if m[0] == "{":
                    before = self.blanked[max(0, m.start() - 400) : m.start()]
                    before = re.split(r"[;{}]", before)[-1]
                    stack.append("type" if TYPE_HEAD.search(before) else stack[-1] if SPACE_HEAD.search(before) else "code")
                elif len(stack) > 1:
                    stack.pop()
                places.append(m.end())
                kinds.append(stack[-1])
            self._edges = places, kinds
        places, kinds = self._edges
        return kinds[bisect_right(places, at) - 1]

    def statement(self, at: int) -> int:
        """Where the statement that begins at `at` ends: its semicolon, or the line's end where nothing goes on."""
        depth, i, b = 0, at, self.blanked
        while i < len(b):
            c = b[i]
            depth += (c in "([{") - (c in ")]}")
            if depth < 0:
                return i
            if not depth and c == ";":
                return i + 1
            if not depth and c == "\n" and not _GOES_ON.match(b, i):
                last = i - 1
                while last >= at and b[last].isspace():
                    last -= 1
                if last < at or (b[last] not in "=,(+-*/%&|<?:." and not b.startswith("=>", last - 1)):
                    return i
            i += 1
        return len(b)


_GOES_ON = re.compile(r"\s*[.,?:=&|+*/]")
_ACCESS = r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|partial|synchronized|native|default|extern|readonly|new|unsafe)\s+)*"
_NOT_CALL = r"(?!(?:if|for|foreach|while|switch|catch|return|new|else|throw|sizeof|using|lock|function)\b)"
_EXPRESSION = re.compile(r"(?:[=(,:?&|!+]|=>|\b(?:return|new|typeof|yield|await|case))\s*$")


def _each(pattern: str, t: Text):  # noqa: ANN202
    return re.finditer(pattern, t.blanked, re.M)


def _declares(t: Text, at: int) -> bool:
    """Whether a keyword at `at` begins a declaration and not an expression."""
    return not _EXPRESSION.search(t.blanked[max(0, at - 80) : at])


def _returns(t: Text, after: int, ends: str) -> str:
    """`: type` after a parameter list, up to one of the ends."""
    m = re.compile(rf"\s*:\s*([^{re.escape(ends)}\n]+)").match(t.blanked, after)
    return f": {t.source[m.start(1) : m.end(1)].removesuffix('=').strip()}" if m else ""


def _script(t: Text) -> Found:
    out, hits = _empty(), []
    for m in _each(r"^[ \t]*import\b(?!\s*\()[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?", t):
        out["imports"].append(t.source[m.start() : m.end()].strip())
    for m in _each(r"^[ \t]*(export)\b", t):
        at = m.start(1)
        head = re.compile(r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|interface)\b").match(t.blanked, at)
        out["exports"].append(t.line(at)[:LINE] if head else " ".join(t.source[at : t.statement(at)].split())[:EXPORT])
    for m in _each(r"\bfunction\s+([A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>\s*)?(?=\()", t):
        if _declares(t, re.compile(r"(?:async\s+)?function").search(t.blanked, m.start() - 6 if t.blanked[max(0, m.start() - 6) : m.start()] == "async " else m.start()).start()):
            hits.append((m.start(1), m[1], m.end(), "{;"))
    for m in _each(rf"(?:^|[{{}};,])[ \t\n]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|return|function|with|super)\b)(\#?[A-Za-z_$][\w$]*)\s*(?:<[^(){{}}]*>\s*)?(?=\()", t):
        params = t.brackets(m.end())
        body = re.compile(r"\s*(?::\s*[^={};\n]+)?\{").match(t.blanked, m.end() + len(params))
        if body and t.inside(m.start(1)):
            hits.append((m.start(1), m[1], m.end(), "{;"))
    for m in _each(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^(){}]*>\s*)?(?=\()", t):
        params = t.brackets(m.end())
        if re.compile(r"\s*(?::[^=\n;]+)?=>").match(t.blanked, m.end() + len(params)):
            hits.append((m.start(1), m[1], m.end(), "{=;"))
    for m in _each(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?[A-Za-z_$][\w$]*\s*=>", t):
        hits.append((m.start(1), m[1], None, ""))
    seen: set[int] = set()
    for at, name, params, ends in sorted(hits, key=lambda h: h[0]):
        if at in seen:
            continue
        seen.add(at)
        listed = t.brackets(params) if params is not None else "()"
        out["functions"].append(f"function {name}({listed[1:-1].strip()}){_returns(t, params + len(listed), ends) if params is not None else ''}")
    for m in _each(r"(?<!abstract )\b(class|interface)\s+([A-Za-z_$][\w$]*)", t):
        if _declares(t, m.start()) and not t.blanked[m.start() - 1 : m.start()] == ".":
            out["classes"].append(f"{m[1]} {m[2]}")
    out["exports"] += [f"exports.{n} = ..." for n in re.findall(r"^[ \t]*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=", t.source, re.M)]
    out["exports"] += ["module.exports = ..."] if re.search(r"^[ \t]*module\.exports\s*=", t.source, re.M) else []
    return out


def _members(t: Text, imports: str, kinds: str) -> Found:
    """Java and C#: what is declared in the bodies of types."""
    out = _empty()
    out["imports"] = [m[0].strip() for m in re.finditer(imports, t.source, re.M)]
    for m in _each(rf"(?:^|[{{}};\]])\s*{_ACCESS}(?:<[^(){{}}]*>\s*)?(?:[\w.<>\[\],?]+(?:\s*<[^(){{}};]*>)?\s+)?{_NOT_CALL}(\w+)\s*(?:<[\w, ]+>\s*)?(?=\()", t):
        params = t.brackets(m.end())
        record = re.search(r"\brecord\s+(?:class\s+|struct\s+)?$", t.blanked[m.start() : m.start(1)])
        if t.inside(m.start(1)) == "type" and not record and re.compile(r"\s*(?:throws\s[\w., ]+|:\s*(?:this|base)\s*\([^)]*\)|where\s[^{]+)?\s*(?:\{|;|=>)").match(t.blanked, m.end() + len(params)):
            out["functions"].append(f"{m[1]}{params}")
    out["classes"] = [f"{m[1]} {m[2]}" for m in _each(rf"(?<![.@\w])({kinds})\s+(?!class\b|struct\b)(\w+)", t) if t.inside(m.start()) != "code"]
    return out


def _java(t: Text) -> Found:
    return _members(t, r"^[ \t]*import\s[^;\n]+;", "class|interface|enum")


def _csharp(t: Text) -> Found:
    return _members(t, r"^[ \t]*(?:global\s+)?using\s[^;(\n]+;", "class|interface|struct|enum|record")


def _cpp(t: Text) -> Found:
    """A definition is listed by its declarator and by its name, a declaration by its name."""
    out = _empty()
    out["imports"] = [m[0].strip() for m in re.finditer(r"^[ \t]*#[ \t]*include[^\n]+", t.source, re.M)]
    for m in _each(rf"(?:^|[{{}};]|(?:public|private|protected)\s*:)[ \t\n]*(?:template\s*<[^>]*>\s*)?(?:(?:[\w:]+(?:<[^<>(){{}};]*>)?|[*&])[ \t*&]+)*?([*&]*\s*)({_NOT_CALL}~?[A-Za-z_][\w:~]*)\s*(?=\()", t):
        if re.match(r"(?:case|return|public|private|protected)\b", m[2]) or t.inside(m.start(2)) == "code":
            continue
        params = t.brackets(m.end())
        rest = re.compile(r"\s*((?:const|noexcept|override|final)(?:\s+(?:const|noexcept|override|final))*)?\s*(?::[^{;]*)?([{;]|=\s*(?:0|default|delete)\s*;)").match(t.blanked, m.end() + len(params))
        typed = re.search(r"[\w>*&]\s*$", re.sub(r"^(?:[{};]|\w+\s*:(?!:))", "", t.blanked[m.start() : m.start(1)])) or "::" in m[2] or t.inside(m.start(2)) == "type"
        if not rest or not typed:
            continue
        if rest[2] == "{":
            shown = f"{m[1].strip()}{' ' if m[1].strip() else ''}{m[2]}{params}{' ' + rest[1] if rest[1] else ''}"
            out["functions"] += [shown] if len(shown) < DECLARATOR else []
        out["functions"].append(m[2])
    out["classes"] = [f"{m[1]} {m[2]}" for m in _each(r"(?<!enum )\b(class|struct)\s+(\w+)(?=\s*(?:final\s*)?[:{;])", t)]
    return out


def _go(t: Text) -> Found:
    out = _empty()
    for m in _each(r"^import\s+(\([^)]*\)|[^\n]+)", t):
        out["imports"].append(t.line(m.start()))
        inner = t.source[m.start(1) : m.end(1)]
        out["imports"] += [x.strip() for x in inner.strip("()").split("\n") if x.strip()]
    for m in _each(r"^func\s+(?:\([^)]*\)\s*)?(\w+)(?:\[[^\]]*\])?(?=\()", t):
        params = t.brackets(m.end())
        after = m.end() + len(params)
        result = t.source[after : re.compile(r"\{|\n|\Z").search(t.blanked, after).start()].strip()
        out["functions"].append(f"func {m[1]}{params}{' ' + result if result else ''}")
    out["classes"] = [x for m in _each(r"^type\s", t) if "struct" in (x := t.line(m.start())) or "interface" in x]
    return out


def _rust(t: Text) -> Found:
    out = _empty()
    out["imports"] = [t.source[m.start() : m.end()].strip() for m in _each(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]+;", t)]
    for m in _each(r"\bfn\s+(\w+)\s*(?:<[^({]*>\s*)?(?=\()", t):
        params = t.brackets(m.end())
        back = re.compile(r"\s*->\s*([^{;]+?)\s*(?:\bwhere\b[^{;]*)?(?=[{;])").match(t.blanked, m.end() + len(params))
        # a function without a body is an item of its own sort
        if re.compile(r"[^{;]*\{").match(t.blanked, m.end() + len(params)):
            out["functions"].append(f"fn {m[1]}{params}{' ' + t.source[back.start(1) : back.end(1)] if back else ''}")
    for m in _each(r"(?<![\w:])(struct|enum|trait)\s+(\w+)|^[ \t]*(?:unsafe\s+)?(impl)\b\s*(?:<[^{]*?>\s*)?(?:[\w:<>, ]+?\s+for\s+)?([\w:]+(?:<[^{]*?>)?)\s*(?=\{|where\b)", t):
        out["classes"].append(f"{m[1] or m[3]} {m[2] or m[4]}")
    return out


def _php(t: Text) -> Found:
    """Functions outside of types are listed without their parameters."""
    out = _empty()
    out["imports"] = [t.line(m.start(1))[:LINE] for m in _each(r"^[ \t]*(use)\s[^;(]+;", t) if t.inside(m.start(1)) != "type"]
    for m in _each(r"\bfunction\s+&?\s*(\w+)\s*(?=\()", t):
        out["functions"].append(f"function {m[1]}{t.brackets(m.end()) if t.inside(m.start(1)) == 'type' else '()'}")
    out["classes"] = [f"{m[1]} {m[2]}" for m in _each(r"(?<![\w$>:])(class|interface)\s+(\w+)", t)]
    return out


def _ruby(t: Text) -> Found:
    out = _empty()
    out["imports"] = [t.line(m.start(1))[:LINE] for m in _each(r"^[ \t]*((?:require|require_relative|load)[ \t(][^\n]+)", t)]
    out["classes"] = [f"{m[1]} {m[2]}" for m in _each(r"^[ \t]*(module|class)[ \t]+([A-Z]\w*)(?!\w|::)", t)]
    for m in _each(r"^[ \t]*def[ \t]+([a-z_]\w*[?!]?)(?![\w.=])(\()?", t):
        out["functions"].append(f"def {m[1]}{t.brackets(m.end(1)) if m[2] else ''}")
    return out


def _kotlin(t: Text) -> Found:
    out = _empty()
    out["imports"] = [t.line(m.start(1))[:LINE] for m in _each(r"^[ \t]*(import\s[^\n]+)", t)]
    out["functions"] = [f"fun {m[1]}{t.brackets(m.end())}" for m in _each(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(\w+)\s*(?=\()", t)]
    out["classes"] = [f"class {m[1]}" for m in _each(r"(?<![.:\w])(?:class|interface)\s+(\w+)", t)]
    return out


def _swift(t: Text) -> Found:
    out = _empty()
    out["imports"] = [" ".join(t.line(m.start(1)).split())[:LINE] for m in _each(r"^[ \t]*(import\s[^\n]+)", t)]
    words = r"(?:(?:public|private|internal|open|fileprivate|static|final|override|mutating|async|indirect|@\w+)\s+)*"
    for section, kinds in (("functions", "func"), ("classes", "class|struct|protocol|enum|extension|actor")):
        heads = [t.head(m.start(1)) for m in _each(rf"(?:^|[{{}};])[ \t]*({words}(?:{kinds})\s+[\w.]+)", t) if re.compile(r"[^\n{]*\{|[^{}]*?\n\s*(?:where[^{]*)?\{").match(t.blanked, m.end())]
        out[section] = [h for h in heads if 0 < len(h) < LINE]
    return out


def _bash(t: Text) -> Found:
    out = _empty()
    out["imports"] = [t.line(m.start(1))[:LINE] for m in _each(r"(?:^|[;&|])[ \t]*((?:source|\.)[ \t][^\n]+)", t)]
    heads = [t.head(m.start(1)) for m in _each(r"^[ \t]*((?:function\s+[\w:.-]+(?:\s*\(\s*\))?|[\w:.-]+\s*\(\s*\))\s*)(?=\{)", t)]
    out["functions"] = [h for h in heads if 0 < len(h) < LINE]
    return out


def _css(t: Text) -> Found:
    out = _empty()
    out["imports"] = [t.source[m.start() : m.end()].strip() for m in _each(r"@import\s[^;\n]+;?", t)]
    out["functions"] = [t.source[m.start(1) : m.end(1)].strip()[:SELECTOR] for m in _each(r"(?:^|[{};])\s*([^{}@;\s][^{};]*?)\s*(?=\{)", t)]
    return out


SCANNERS = {
    "javascript": (_script, NOISE),
    "typescript": (_script, NOISE),
    "tsx": (_script, NOISE),
    "java": (_java, NOISE),
    "csharp": (_csharp, NOISE),
    "cpp": (_cpp, NOISE),
    "c": (_cpp, NOISE),
    "go": (_go, NOISE),
    "rust": (_rust, RUST_NOISE),
    "php": (_php, PHP_NOISE),
    "ruby": (_ruby, HASH_NOISE),
    "kotlin": (_kotlin, NOISE),
    "swift": (_swift, NOISE),
    "bash": (_bash, HASH_NOISE),
    "css": (_css, CSS_NOISE),
}
#: Languages that are read by their syntax; the others by line patterns only.
SCANNED = sorted({*SCANNERS, "python", "html", "json"})


def scan(source: str | None, lang: str) -> Found | None:
    """The signature of a source, or null where the line patterns must answer."""
    try:
        if source is None or lang not in SCANNED:
            return None
        if lang == "json":
            return _empty()
        if lang in ("python", "html"):
            return python(source) if lang == "python" else html(source)
        scanner, noise = SCANNERS[lang]
        return scanner(Text(source, noise))
    except (SyntaxError, ValueError, RecursionError):
        return None


@F.pandas_udf(KIND)
def _scanned(sources: pd.Series, languages: pd.Series) -> pd.DataFrame:
    rows = [scan(s, x) for s, x in zip(sources, languages, strict=True)]
    return pd.DataFrame([r or dict.fromkeys(SECTIONS) for r in rows], columns=SECTIONS)


def signature(content: Column, lang: Column) -> Column:
    """The scanner's signature, or that of the line patterns where there is no scanner or it can't read the source."""
    found = _scanned(content, lang)
    return F.when(found["imports"].isNotNull(), found).otherwise(by_lines(content, lang))
