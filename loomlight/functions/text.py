"""Languages of paths, symbol names, imports, exported names and short descriptions, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signatures import once

# Languages and their file suffixes.
LANGUAGES = {
    "javascript": ".js .jsx .mjs .cjs",
    "typescript": ".ts .mts .cts",
    "tsx": ".tsx",
    "python": ".py .pyi",
    "java": ".java",
    "csharp": ".cs",
    "cpp": ".cpp .cc .cxx .hpp .hxx .h",
    "c": ".c",
    "go": ".go",
    "rust": ".rs",
    "ruby": ".rb",
    "php": ".php",
    "kotlin": ".kt .kts",
    "swift": ".swift",
    "scala": ".scala .sc",
    "html": ".html .htm",
    "css": ".css .scss .sass .less",
    "json": ".json .jsonc",
    "yaml": ".yaml .yml",
    "sql": ".sql",
    "bash": ".sh .bash .zsh",
    "vue": ".vue",
    "svelte": ".svelte",
    "markdown": ".md .markdown .mdx",
}
SUFFIXES = {s: lang for lang, all_ in LANGUAGES.items() for s in all_.split()}
# Languages that only have a structure view, and the two pragmas that change a grammar.
STRUCTURE_ONLY = ["yaml", "markdown", "json", "unknown"]
PRAGMA = r"@(no)?flow(?![A-Za-z0-9_])"
# Patterns of names in signature lines, in order of priority.
NAME_PATTERNS = {
    "function": [r"(?:function|def|async\s+function)\s+(\w+)"],
    "class": [r"class\s+(\w+)"],
    "export": [r"export\s+(?:async\s+)?function\s+(\w+)", r"export\s+(?:const|let|var)\s+(\w+)", r"export\s+(?:default\s+)?class\s+(\w+)", r"export\s+default\s+(\w+)"],
}
# Patterns of exported names in JavaScript source.
IDENTIFIER = r"[A-Za-z_$][\w$]*"
TRUTH_PATTERNS = [
    rf"(?m)^\s*export\s+(?:async\s+)?function\s*\*?\s*({IDENTIFIER})",
    rf"(?m)^\s*export\s+(?:abstract\s+)?class\s+({IDENTIFIER})",
    rf"(?m)^\s*export\s+(?:const|let|var)\s+({IDENTIFIER})",
    rf"(?m)^\s*export\s+interface\s+({IDENTIFIER})",
    rf"(?m)^\s*export\s+type\s+({IDENTIFIER})",
    rf"(?m)^\s*export\s+enum\s+({IDENTIFIER})",
    rf"(?m)^\s*export\s+default\s+(?:async\s+)?(?:function\s*\*?\s+)?({IDENTIFIER})",
    rf"(?m)^\s*module\.exports\.({IDENTIFIER})\s*=",
    rf"(?m)^\s*exports\.({IDENTIFIER})\s*=",
]


def language(path: Column) -> Column:
    """By the last suffix, lower case; files that are all suffix have none."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))), F.lit("unknown"))


def grammar(path: Column, content: Column) -> Column:
    """The grammar for a file: script with a type pragma in its first 4096 characters is read as tsx."""
    lang = language(path)
    return F.when(lang.isin("javascript") & F.substring(content, 1, 4096).rlike(PRAGMA), F.lit("tsx")).otherwise(lang)


def structure_only(lang: Column, depth: Column) -> Column:
    return (depth == "structure") | (lang.isin(STRUCTURE_ONLY) & (depth != "full"))


def symbol_name(line: Column, kind: str) -> Column:
    """The name that a signature line declares, or null."""
    return F.coalesce(*[F.get(F.regexp_extract_all(line, F.lit(p), F.lit(1)), F.lit(0)) for p in NAME_PATTERNS[kind]])


def _names(listed: Column) -> Column:
    """Names of a comma list; of `x as y` the x."""
    return F.transform(F.split(listed, ","), lambda n: F.trim(F.substring_index(F.trim(n), " as ", 1)))


def parse_import(line: Column, lang: Column) -> Column:
    """struct(source, names) of an import line, or null."""
    py_from, py_import = r"from\s+(\S+)\s+import\s+(.+)", r"import\s+(\S+)"
    js = r"""import\s+(?:(?:\{([^}]+)\}|(\*\s+as\s+\w+)|(\w+))(?:\s*,\s*(?:\{([^}]+)\}|(\w+)))?\s+from\s+)?['"](\.?[^'"]+)['"]"""

    def python(m: Column) -> Column:
        source, module = m["source"], m["module"]
        return F.when(source != "", F.struct(source.alias("source"), _names(F.regexp_extract(line, py_from, 2)).alias("names"))).when(module != "", F.struct(module.alias("source"), F.array(module).alias("names")))

    def script(m: Column) -> Column:
        g = [m[f"g{i}"] for i in range(7)]
        some = lambda i, names: F.when(g[i] != "", names).otherwise(F.array().cast("array<string>"))
        names = F.concat(some(1, _names(g[1])), some(2, F.array(F.trim(F.regexp_replace(g[2], r"\*\s+as\s+", "")))), some(3, F.array(g[3])), some(4, _names(g[4])), some(5, F.array(g[5])))
        return F.when(g[6] != "", F.struct(g[6].alias("source"), names.alias("names")))

    in_python = F.struct(F.regexp_extract(line, py_from, 1).alias("source"), F.regexp_extract(line, py_import, 1).alias("module"))
    in_script = F.struct(*[F.regexp_extract(line, js, i).alias(f"g{i}") for i in range(7)])
    return F.when(lang == "python", once(in_python, python)).otherwise(once(in_script, script))


def normal_path(path: Column) -> Column:
    """An absolute path without `.`, `..` and empty parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def import_candidates(source: Column, path: Column) -> Column:
    """Paths that a relative or absolute import may mean, in order; null for packages."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    whole = normal_path(F.when(source.startswith("/"), source).otherwise(F.concat(folder, F.lit("/"), source)))

    def meant(base: Column) -> Column:
        bare = F.regexp_replace(base, r"\.(js|jsx)$", "")
        typed = F.when(base.rlike(r"\.(js|jsx)$"), F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.array().cast("array<string>"))
        rest = [F.concat(base, F.lit(s)) for s in (".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js")]
        return F.concat(F.array(base), typed, F.array(*rest))

    return F.when(source.startswith(".") | source.startswith("/"), once(whole, meant))


def abbreviate(description: Column) -> Column:
    """One line, up to the first sentence's end within 200 characters, at most 140 characters."""
    one = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    stop = F.regexp_instr(one, F.lit(r"\.(\s|$)"))
    first = F.when((stop > 0) & (stop <= 200), F.substring(one, F.lit(1), stop)).otherwise(one)
    return F.when(F.length(first) > 140, F.concat(F.substring(first, 1, 137), F.lit("..."))).otherwise(first)


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def without_comments(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, r"//[^\n]*", ""), r"/\*[\s\S]*?\*/", "")


def truth_symbols(source: Column) -> Column:
    """Exported names of script source; of `export { a as b }` the b."""

    def named(bare: Column) -> Column:
        listed = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*export\s*\{([^}]+)\}"), F.lit(1)), lambda b: F.split(b, ",")))
        alias = F.filter(F.transform(listed, lambda p: F.regexp_extract(p, r"^\s*(?:\S+\s+as\s+)?(\S+)\s*$", 1)), lambda n: n.rlike(rf"^{IDENTIFIER}$"))
        return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(bare, F.lit(p), F.lit(1)) for p in TRUTH_PATTERNS], alias)))

    return once(without_comments(source), named)


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1)))


def canonical_exports(signature: Column) -> Column:
    """Sorted bare names of a signature's exports, functions and classes; of `{ a as b }` the a."""
    def head(lines: Column, *cuts: str) -> Column:
        bare = reduce(lambda c, p: F.transform(c, lambda x: F.regexp_replace(x, p, "")), cuts, lines)
        return F.transform(bare, lambda x: F.regexp_extract(x, rf"^({IDENTIFIER})", 1))

    exports = head(signature["exports"], r"^export\s+(default\s+)?(async\s+)?", r"^(type|interface|const|let|var|function|class|enum|namespace)\s+")
    groups = F.flatten(F.transform(signature["exports"], lambda x: F.split(F.regexp_extract(x, r"export\s*\{\s*([^}]+)\}", 1), ",")))
    functions = F.transform(signature["functions"], lambda x: F.regexp_extract(x, rf"^(?:async\s+)?function\s+({IDENTIFIER})", 1))
    classes = F.transform(signature["classes"], lambda x: F.regexp_extract(x, rf"^(?:abstract\s+)?class\s+({IDENTIFIER})", 1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(exports, head(groups, r"^\s+", r"\s+as\s+\w+"), functions, classes), lambda x: x != "")))


def looks_like_json(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))


def commits_match(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return x.startswith(y) | y.startswith(x)
