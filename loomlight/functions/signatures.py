"""Signatures of source text by line patterns, and their views, as Column expressions inside one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Patterns of signature lines (trimmed).
IMPORTS = [r"^import\s", r"^from\s.+\simport\s", r"^require\s*\(", r"^use\s+", r"^using\s+", r"^#include\s", r"^@import\s"]
EXPORTS = [r"^export\s", r"^module\.exports"]
COMMON_JS = r"^exports\.([A-Za-z_$][\w$]*)\s*="
FUNCTIONS = [
    r"^(export\s+)?(async\s+)?function\s+\w+",
    r"^def\s+\w+",
    r"^func\s+\w+",
    r"^fn\s+\w+",
    r"^sub\s+\w+",
    r"^(public|private|protected|internal|static)\s+(static\s+)?[\w<>\[\]]+\s+\w+\s*\(",
]
CLASSES = [
    r"^(export\s+)?(public\s+)?(abstract\s+)?class\s+\w+",
    r"^(public\s+)?(abstract\s+)?interface\s+\w+",
    r"^(public\s+)?(abstract\s+)?struct\s+\w+",
    r"^(pub\s+)?trait\s+\w+",
    r"^(pub\s+)?enum\s+\w+",
    r"^type\s+\w+\s+(struct|interface)",
]
SQL_OBJECT = r"(?i)^(create|drop|alter)\s+(table|view|index|procedure|function)\s+\w+"
YAML_KEY = r"^\w[\w-]*:"
BASH_FUNCTION = r"^(function\s+)?\w+\s*\(\s*\)"
HEADING = r"^#{1,3}\s+\S"
LINE_CAP = 200
# Headings and order of the sections of a rendered signature, and the line caps of the views.
SECTIONS = [("imports", "// ─── Imports ───"), ("classes", "// ─── Classes / Types ───"), ("functions", "// ─── Functions ───"), ("exports", "// ─── Exports ───")]
NOTHING = "// No structural signatures detected."
HEAD_LINES, TAIL_LINES, STRUCTURE_CAP, STRUCTURE_SHORT = 50, 20, 120, 40
KIND = StructType([StructField(n, ArrayType(StringType())) for n in ("imports", "exports", "functions", "classes")])


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _upto(line: Column, *marks: str) -> Column:
    for m in marks:
        line = F.substring_index(line, m, 1)
    return F.trim(line)


def by_lines(content: Column, lang: Column) -> Column:
    """struct(imports, exports, functions, classes) of arrays in the order of the lines; works for every language."""
    return once(F.filter(F.transform(F.split(content, "\n"), trimmed), lambda x: x != ""), lambda lines: _of_lines(lines, lang))


def _of_lines(lines: Column, lang: Column) -> Column:
    def found(*cases) -> Column:  # noqa: ANN002
        return F.flatten(F.transform(lines, lambda x: F.array_compact(F.array(*[F.when(test(x), value(x)) for test, value in cases]))))

    short = lambda x: F.substring(x, 1, LINE_CAP)
    imports = found((lambda x: x.rlike(any_of(IMPORTS)), short))
    exports = found((lambda x: x.rlike(any_of(EXPORTS)), lambda x: short(_upto(x, "{"))), (lambda x: x.rlike(COMMON_JS), lambda x: F.concat(F.lit("exports."), F.regexp_extract(x, COMMON_JS, 1), F.lit(" = ..."))))
    functions = found((lambda x: x.rlike(any_of(FUNCTIONS)), lambda x: short(_upto(x, "{", ":="))), (lambda x: (lang == "sql") & x.rlike(SQL_OBJECT), lambda x: short(_upto(x, "("))), (lambda x: (lang == "bash") & x.rlike(BASH_FUNCTION), lambda x: _upto(x, "{")))
    classes = found((lambda x: x.rlike(any_of(CLASSES)), lambda x: short(_upto(x, "{", "("))), (lambda x: (lang == "yaml") & x.rlike(YAML_KEY), short), (lambda x: (lang == "markdown") & x.rlike(HEADING), short))
    return F.struct(imports.alias("imports"), exports.alias("exports"), functions.alias("functions"), classes.alias("classes"))


def common_js_exports(content: Column) -> Column:
    """`exports.x = ...` and `module.exports = ...` of a script, in that order."""
    named = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*="), F.lit(1)), lambda n: F.concat(F.lit("exports."), n, F.lit(" = ...")))
    whole = F.when(content.rlike(r"(?m)^\s*module\.exports\s*="), F.array(F.lit("module.exports = ..."))).otherwise(F.array().cast("array<string>"))
    return F.concat(named, whole)


def rendered(signature: Column, lang: Column) -> Column:
    """The signature as text: a header, the sections that aren't empty, or a note that there are none."""

    def shown(sig: Column) -> Column:
        parts = [F.array(F.concat(F.lit("// Language: "), lang), F.lit("// Extracted signature"), F.lit(""))]
        empty = F.lit(True)
        for name, title in SECTIONS:
            lines = sig[name]
            empty = empty & (F.size(lines) == 0)
            parts.append(F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>")))
        parts.append(F.when(empty, F.array(F.lit(NOTHING))).otherwise(F.array().cast("array<string>")))
        return F.array_join(F.concat(*parts), "\n")

    return once(signature, shown)


def head_and_tail(content: Column) -> Column:
    """The first and last lines of a long text, with a line that says how many were left out."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    cut = F.concat(F.slice(lines, 1, HEAD_LINES), F.array(F.concat(F.lit("... "), (n - HEAD_LINES - TAIL_LINES).cast("string"), F.lit(" lines omitted ..."))), F.slice(lines, -TAIL_LINES, TAIL_LINES))
    return F.when(n > HEAD_LINES + TAIL_LINES, F.array_join(cut, "\n")).otherwise(content)


def first_lines(content: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, n), "\n")


def structure_view(content: Column, lang: Column, signature: Column | None = None) -> Column:
    """The rendered signature cut to STRUCTURE_CAP lines; to STRUCTURE_SHORT if it is still longer than the source.

    signature: a column that holds it, such as the scanners'; by line patterns where none is given.
    """
    view = rendered(by_lines(content, lang) if signature is None else signature, lang)

    def capped(lines: Column, n: int) -> Column:
        more = F.array(F.concat(F.lit("... "), (F.size(lines) - n).cast("string"), F.lit(" more lines")))
        return F.array_join(F.when(F.size(lines) > n, F.concat(F.slice(lines, 1, n), more)).otherwise(lines), "\n")

    def chosen(lines: Column) -> Column:
        return once(capped(lines, STRUCTURE_CAP), lambda long: F.when(F.length(long) > F.length(content), capped(lines, STRUCTURE_SHORT)).otherwise(long))

    return once(F.split(view, "\n"), chosen)


def view(content: Column, lang: Column, depth: str, signature: Column | None = None) -> Column:
    """A source at one of the depths full, signature, structure and summary."""
    if depth == "full":
        return content
    if depth == "structure":
        return structure_view(content, lang, signature)
    if depth not in ("summary", "signature"):
        raise ValueError(f"unknown depth {depth}")
    sig = by_lines(content, lang) if signature is None else signature
    body = head_and_tail(content) if depth == "summary" else rendered(sig, lang)
    return F.when(lang.isin("yaml", "markdown", "json", "unknown"), structure_view(content, lang, sig)).otherwise(body)
