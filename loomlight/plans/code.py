"""Queries over source text: signatures, views, symbols and the symbol graph.

The driver's tables hold prose, so source text is composed from part's columns by one SQL expression that Spark and
the check engine share.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import signatures as S
from ..functions import text as T
from ..functions.scanners import signature
from ..operators import graph as G
from ..operators import stored as ST
from ..sources import files as R
from ..sources.shared import folder, settled, spread

PATH = "'/src/m' || CAST(p_partkey % 50 AS STRING) || '/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.sql' WHEN 3 THEN '.yaml' WHEN 4 THEN '.sh' ELSE '.md' END"
_K = "CAST(p_partkey AS STRING)"
_V = "CAST(k AS VARCHAR)"
LINES = [
    f"""'import {{ a' || {_K} || ', b as c }} from "./f' || CAST(p_partkey + 150 AS STRING) || '"'""",
    "'import os'",
    f"'export async function fn' || {_K} || '(x) {{ return x }}'",
    f"'  def py' || {_K} || '(self):'",
    f"'export class C' || {_K} || ' extends B {{'",
    f"'exports.e' || {_K} || ' = 1;'",
    "'module.exports = { x }'",
    f"'create table t' || {_K} || ' (id int)'",
    f"'key' || {_K} || ': ' || CAST(p_size AS STRING)",
    f"'run' || {_K} || '() {{ echo }}'",
    "'## ' || p_name",
    f"'type T' || {_K} || ' struct {{'",
    f"'public static int calc' || {_K} || '(int a) {{'",
    "''",
    "p_type",
]
CONTENT = f"concat_ws(chr(10), {', '.join(LINES)})"
FILES = f"SELECT p_partkey AS k, {PATH} AS path, {CONTENT} AS content FROM part"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """The table that sources are composed from, spread before they are: its rows are narrow, what is done with them isn't."""
    return spread(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return settled(parts(spark, sf), content=F.expr(CONTENT)).selectExpr("p_partkey AS k", f"{PATH} AS path", "content")


# ---- SQL of the same definitions
def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
LANGUAGE = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in T.SUFFIXES.items()) + " ELSE 'unknown' END"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _any(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {_quoted(S.any_of(patterns))})"


def _upto(x: str, *marks: str) -> str:
    for m in marks:
        x = f"split_part({x}, '{m}', 1)"
    return f"trim({x})"


def _cases(*cases: tuple[str, str]) -> str:
    inner = ", ".join(f"CASE WHEN {test} THEN {value} END" for test, value in cases)
    return f"list_filter(flatten(list_transform(l, lambda x: [{inner}])), lambda x: x IS NOT NULL)"


LINE_SIGNATURES = f"""
files AS ({FILES.replace("STRING", "VARCHAR")}),
lined AS (SELECT *, {LANGUAGE} AS language, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_trim("x")}), lambda x: x <> '') AS l FROM files),
line_sigs AS (SELECT k, path, content, language,
  {_cases((_any("x", S.IMPORTS), "left(x, 200)"))} AS imports,
  {_cases((_any("x", S.EXPORTS), f"left({_upto('x', '{')}, 200)"), (_any("x", [S.COMMON_JS]), f"'exports.' || regexp_extract(x, {_quoted(S.COMMON_JS)}, 1) || ' = ...'"))} AS exports,
  {_cases((_any("x", S.FUNCTIONS), f"left({_upto('x', '{', ':=')}, 200)"), (f"language = 'sql' AND {_any('x', [S.SQL_OBJECT])}", f"left({_upto('x', '(')}, 200)"), (f"language = 'bash' AND {_any('x', [S.BASH_FUNCTION])}", _upto("x", "{")))} AS functions,
  {_cases((_any("x", S.CLASSES), f"left({_upto('x', '{', '(')}, 200)"), (f"language = 'yaml' AND {_any('x', [S.YAML_KEY])}", "left(x, 200)"), (f"language = 'markdown' AND {_any('x', [S.HEADING])}", "left(x, 200)"))} AS classes
  FROM lined)"""
# what the scanners read in a composed source; it is no Python, so that the line patterns answer there as well
_IN_SCRIPT = {
    "imports": f"[{LINES[0].replace('STRING', 'VARCHAR')}, 'import os']",
    "exports": f"['export async function fn' || {_V} || '(x) {{ return x }}', 'export class C' || {_V} || ' extends B {{', 'exports.e' || {_V} || ' = ...', 'module.exports = ...']",
    "functions": f"['function fn' || {_V} || '(x)', 'function run' || {_V} || '()']",
    "classes": f"['class C' || {_V}]",
}
_IN_SHELL = {"imports": "[]", "exports": "[]", "functions": f"['run' || {_V} || '()']", "classes": "[]"}
_PARSED = ", ".join(f"CASE language WHEN 'typescript' THEN {_IN_SCRIPT[n].replace('p_partkey', 'k')} WHEN 'bash' THEN {_IN_SHELL[n].replace('p_partkey', 'k')} ELSE {n} END AS {n}" for n in _IN_SCRIPT)
SIGNATURES = f"{LINE_SIGNATURES}, sigs AS (SELECT k, path, content, language, {_PARSED} FROM line_sigs)"
_RENDER = " || ".join([f"'// Language: ' || language || chr(10) || '// Extracted signature' || chr(10)", *(f"CASE WHEN len({n}) > 0 THEN chr(10) || '{t}' || chr(10) || array_to_string({n}, chr(10)) || chr(10) ELSE '' END" for n, t in S.SECTIONS), f"CASE WHEN len(imports) + len(exports) + len(functions) + len(classes) = 0 THEN chr(10) || '{S.NOTHING}' ELSE '' END"])
RENDERED = f"{SIGNATURES}, rendered AS (SELECT *, {_RENDER} AS view FROM sigs)"
_TOKENS = "CAST(CASE WHEN NOT regexp_matches({0}, '\\S') THEN 0 ELSE ceil(length({0}) / 4.0) END AS BIGINT)"


@query(f"SELECT path, {LANGUAGE} AS language FROM ({FILES.replace('STRING', 'VARCHAR')})")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", T.language(F.col("path")).alias("language"))


_LISTED = "path, language, array_to_string(imports, ';') AS imports, array_to_string(exports, ';') AS exports, array_to_string(functions, ';') AS functions, array_to_string(classes, ';') AS classes"


@query(f"WITH {LINE_SIGNATURES} SELECT {_LISTED} FROM line_sigs")
def line_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """By line patterns alone, for every language."""
    lang = T.language(F.col("path"))
    d = files(spark, sf).select("path", lang.alias("language"), S.by_lines(F.col("content"), lang).alias("sig"))
    return d.select("path", "language", *[F.array_join(f"sig.{n}", ";").alias(n) for n in ("imports", "exports", "functions", "classes")])


@query(f"WITH {SIGNATURES} SELECT {_LISTED} FROM sigs")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """By scanners, and by line patterns where there is none or it can't read the source."""
    d = G.signatures(files(spark, sf))
    return d.select("path", "language", *[F.array_join(f"sig.{n}", ";").alias(n) for n in ("imports", "exports", "functions", "classes")])


@query(f"WITH {RENDERED} SELECT path, view FROM rendered")
def rendered_signatures(spark: SparkSession, sf: str) -> DataFrame:
    d = G.signatures(files(spark, sf))
    return d.select("path", S.rendered(F.col("sig"), F.col("language")).alias("view"))


@query(f"WITH {RENDERED}, m AS (SELECT path, language, {_TOKENS.format('content')} AS o, {_TOKENS.format('view')} AS p FROM rendered) SELECT path, language, o AS original_tokens, p AS optimized_tokens, CAST(CASE WHEN p > o OR o = 0 THEN 0 ELSE greatest(0, floor((o - p) / o * 100 + 0.5)) END AS BIGINT) AS savings_percent, p > o AS expanded FROM m")
def compressed_files(spark: SparkSession, sf: str) -> DataFrame:
    d = G.signatures(files(spark, sf), "content")
    d = d.select("path", "language", M.tokens(F.col("content")).alias("o"), M.tokens(S.rendered(F.col("sig"), F.col("language"))).alias("p"))
    return d.select("path", "language", M.savings(F.col("o"), F.col("p")).alias("m")).select("path", "language", "m.*")


@query(f"WITH {RENDERED}, m AS (SELECT language, {_TOKENS.format('content')} AS o, {_TOKENS.format('view')} AS p FROM rendered) SELECT language, count(*) AS files, CAST(sum(o) AS BIGINT) AS original_tokens, CAST(sum(p) AS BIGINT) AS optimized_tokens, CAST(floor((sum(o) - sum(p)) / sum(o) * 100 + 0.5) AS BIGINT) AS savings_percent FROM m GROUP BY language")
def language_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scores import rollup

    return rollup(compressed_files(spark, sf))


@query(f"WITH {SIGNATURES} SELECT path, array_to_string(list_concat(list_transform(regexp_extract_all(content, '(?m)^\\s*(?:module\\.)?exports\\.([A-Za-z_$][\\w$]*)\\s*=', 1), lambda x: 'exports.' || x || ' = ...'), CASE WHEN regexp_matches(content, '(?m)^\\s*module\\.exports\\s*=') THEN ['module.exports = ...'] ELSE [] END), ';') AS exports FROM sigs")
def common_js_exports(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", F.array_join(S.common_js_exports(F.col("content")), ";").alias("exports"))


_NAME = {k: "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {_quoted(p)}, 1), '')" for p in ps) + ")" for k, ps in T.NAME_PATTERNS.items()}
_NAMED = f"""{SIGNATURES}, named AS (
  SELECT path, 0 AS section, {_NAME["function"]} AS name, 'function' AS kind, 'fn' AS prefix, 'contains' AS edge FROM (SELECT path, unnest(functions) AS line FROM sigs)
  UNION ALL SELECT path, 1, {_NAME["class"]}, 'class', 'cls', 'contains' FROM (SELECT path, unnest(classes) AS line FROM sigs)
  UNION ALL SELECT path, 3, {_NAME["export"]}, 'export', 'exp', 'exports' FROM (SELECT path, unnest(exports) AS line FROM sigs)),
symbols AS (SELECT * FROM named WHERE name IS NOT NULL),
target AS (SELECT a.path, b.path AS target, 'a' || CAST(a.k AS VARCHAR) AS n1, 'b' AS n2 FROM files a JOIN files b ON b.k = a.k + 150 AND a.k % 50 = b.k % 50 WHERE a.path LIKE '%.ts'),
nodes AS (SELECT DISTINCT 'mod:' || path AS key, path AS name, 'module' AS kind, path AS file FROM files
  UNION SELECT DISTINCT prefix || ':' || path || ':' || name, name, kind, path FROM symbols
  UNION SELECT 'imp:' || path || ':' || n, n || ' (from ' || target || ')', 'import', path FROM (SELECT path, target, unnest([n1, n2]) AS n FROM target)),
edges AS (SELECT 'mod:' || path AS src, prefix || ':' || path || ':' || name AS dst, edge AS kind FROM symbols
  UNION ALL SELECT 'mod:' || path, 'mod:' || target, 'imports' FROM target)"""


#: Hexadecimal digits of a part's number: 16 parts for corpora of some thousand files. A part is a file of each table,
#: and what changed within it is found by its files' times and sizes.
DIGITS = 1


def _timed(d: DataFrame) -> DataFrame:
    """Composed files have no time of their own; a hash of the content stands for it."""
    return d.select("path", "content", F.xxhash64("content").alias("mtime_ms"), F.length("content").cast("long").alias("size"))


def stored(spark: SparkSession, sf: str, tag: str = "graph") -> ST.StoredGraph:
    """The graph of the composed files, kept for as long as the application runs: built by the first query that opens it."""
    at = f"{folder(spark)}/{tag}-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode()):08x}"
    return ST.open_graph(_timed(files(spark, sf)), at, digits=DIGITS)


@query(f"WITH {_NAMED} SELECT key, name, kind, file FROM nodes")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.build(files(spark, sf))[0].drop("ord")


@query(f"WITH {_NAMED} SELECT src, dst, kind FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.build(files(spark, sf))[1].drop("ord")


@query(f"WITH {_NAMED} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'module') AS files, (SELECT count(*) FROM nodes WHERE kind = 'function') AS functions, (SELECT count(*) FROM nodes WHERE kind = 'class') AS classes, (SELECT count(*) FROM nodes WHERE kind = 'export') AS exports, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE kind = 'imports') AS import_edges, (SELECT count(*) * 800 FROM nodes WHERE kind = 'module') AS naive_tokens")
def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(*G.build(files(spark, sf)))


@query(f"WITH {_NAMED} SELECT key, name, kind FROM nodes WHERE contains(lower(name), 'fn1') OR contains(lower(key), 'fn1')")
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).search("FN1").select("key", "name", "kind")


@query(f"WITH {_NAMED}, q(q) AS (VALUES ('c11'), ('/M7/F'), ('fn20'), ('py5'), ('.TS:'), ('zzz'), ('a1 (FROM'), ('7')) SELECT q, key FROM q JOIN nodes ON contains(lower(name), lower(q)) OR contains(lower(key), lower(q))")
def graph_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Several searches by posting lists; the last one is too short for them and scans."""
    graph, out = stored(spark, sf), None
    for q in ("c11", "/M7/F", "fn20", "py5", ".TS:", "zzz", "a1 (FROM", "7"):
        hits = graph.found(q).select(F.lit(q).alias("q"), "key")
        out = hits if out is None else out.unionAll(hits)
    return out


def _reach(src: str, dst: str) -> str:
    return f"""WITH RECURSIVE {_NAMED}, walk AS (SELECT 'mod:' || path AS key, 0 AS depth FROM files WHERE k % 50 = 0
  UNION SELECT e.{dst}, w.depth + 1 FROM walk w JOIN edges e ON e.{src} = w.key WHERE w.depth < 3)
SELECT key, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY key"""


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of the traversals: modules whose key is divisible by 50, against all edges."""
    return spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 50 = 0").selectExpr(f"'mod:' || {PATH} AS key")


@query(_reach("src", "dst"))
def graph_depends_on(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).traverse(_seeds(spark, sf)).select("key", F.col("depth").cast("long").alias("depth"))


@query(_reach("dst", "src"))
def graph_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).traverse(_seeds(spark, sf), incoming=True).select("key", F.col("depth").cast("long").alias("depth"))


# ---- a corpus that changes: of a hundred files one goes, one comes, and one gets other contents
_CHANGED = "(CASE WHEN p_partkey % 100 = 57 THEN p_partkey + 1000000 ELSE p_partkey END)"
_AFTER = f"SELECT p_partkey AS id, {_CHANGED} AS k, {PATH} AS path, {CONTENT.replace('p_partkey', _CHANGED)} AS content FROM part WHERE p_partkey % 100 <> 7"
_NAMED_AFTER = _NAMED.replace(FILES.replace("STRING", "VARCHAR"), _AFTER.replace("STRING", "VARCHAR")).replace("b.k = a.k + 150 AND a.k % 50 = b.k % 50", "b.id = a.k + 150 AND a.id % 50 = b.id % 50")


def changing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The composed files before and after."""
    part = parts(spark, sf)
    before = part.where("p_partkey % 100 <> 21").selectExpr(f"{PATH} AS path", f"{CONTENT} AS content")
    after = part.where("p_partkey % 100 <> 7").selectExpr(f"{PATH} AS path", f"{CONTENT.replace('p_partkey', _CHANGED)} AS content")
    return _timed(before), _timed(after)


def _followed(spark: SparkSession, sf: str) -> ST.StoredGraph:
    before, after = changing(spark, sf)
    graph = ST.StoredGraph(spark, f"{folder(spark)}/changing-{uuid.uuid4().hex}", DIGITS)
    graph.refresh(before)
    graph.refresh(after)
    return graph


@query(f"WITH {_NAMED_AFTER} SELECT 'node' AS of, key, name AS at, kind FROM nodes UNION ALL SELECT 'edge', src, dst, kind FROM edges")
def graph_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A stored graph that has followed its corpus holds what a full build would."""
    graph = _followed(spark, sf)
    nodes = graph.nodes.select(F.lit("node").alias("of"), "key", F.col("name").alias("at"), "kind")
    return nodes.unionAll(graph.edges.select(F.lit("edge"), "src", "dst", "kind"))


_STAR = """edges AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
  UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders),
walk AS (SELECT 'r0' AS key, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.key WHERE w.depth < 3)"""


@query(f"WITH RECURSIVE {_STAR} SELECT key, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY key")
def reachable_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    pair = lambda d, a, x, b, y: d.selectExpr(f"'{a}' || CAST({x} AS STRING) AS src", f"'{b}' || CAST({y} AS STRING) AS dst")
    edges = pair(t("nation"), "r", "n_regionkey", "n", "n_nationkey").unionAll(pair(t("customer"), "n", "c_nationkey", "c", "c_custkey")).unionAll(pair(t("orders"), "c", "o_custkey", "o", "o_orderkey"))
    found = G.traverse(edges, spark.createDataFrame([("r0",)], "key string"))
    return found.select("key", F.col("depth").cast("long").alias("depth"))


_GRAPHED = f"""WITH RECURSIVE {_NAMED}, walk AS (SELECT 'mod:' || path AS key, 0 AS depth FROM files WHERE k % 50 = 0
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.key WHERE w.depth < 3),
found AS (SELECT key, min(depth) AS depth FROM walk GROUP BY key),
ranked AS (SELECT depth, kind || ' ' || name AS line, row_number() OVER (PARTITION BY depth ORDER BY key) AS rank FROM found JOIN nodes USING (key))
SELECT CAST(f.depth AS BIGINT) AS depth, f.n, r.listed, r.more FROM (SELECT depth, count(*) AS n FROM found GROUP BY depth) f LEFT JOIN
(SELECT depth, coalesce(string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 20), '') AS listed, greatest(0, count(*) - 20) AS more FROM ranked GROUP BY depth) r ON r.depth = f.depth"""


@query(_GRAPHED)
def graph_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    graph = stored(spark, sf)
    d = G.by_depth(graph.traverse(_seeds(spark, sf)), graph.nodes)
    return d.select(F.col("depth").cast("long").alias("depth"), "n", "listed", F.col("more").cast("long").alias("more"))


@query(f"SELECT substr(sha256(string_agg(line, chr(10) ORDER BY part)), 1, 16) AS manifest FROM (SELECT part, sha256(string_agg(line, chr(10) ORDER BY path)) AS line FROM (SELECT path, path || '|' || CAST(k * 1000 AS VARCHAR) || '|' || CAST(length(content) AS VARCHAR) AS line, substr(sha256(path), 1, {G.MANIFEST_DIGITS}) AS part FROM ({FILES.replace('STRING', 'VARCHAR')})) GROUP BY part)")
def manifest_hash(spark: SparkSession, sf: str) -> DataFrame:
    return G.manifest(files(spark, sf).select("path", (F.col("k") * 1000).alias("mtime_ms"), F.length("content").alias("size")))


@query(f"SELECT path FROM (SELECT CASE WHEN k % 7 = 0 THEN '/node_modules' WHEN k % 7 = 1 THEN '/.hidden' ELSE '' END || path || CASE WHEN k % 11 = 0 THEN '.bin' ELSE '' END AS path FROM ({FILES.replace('STRING', 'VARCHAR')}) WHERE k % 7 > 1 AND k % 11 > 0)")
def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    d = files(spark, sf).selectExpr("CASE WHEN k % 7 = 0 THEN '/node_modules' WHEN k % 7 = 1 THEN '/.hidden' ELSE '' END || path || CASE WHEN k % 11 = 0 THEN '.bin' ELSE '' END AS path")
    return d.where(R.is_source(F.col("path")))


@query("SELECT path, NOT (path LIKE '%/.ssh/%' OR path LIKE '%/etc/passwd') AND path LIKE '/src/%' AS allowed FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '/src/a' WHEN 1 THEN '/src/.ssh/id' WHEN 2 THEN '/other/b' ELSE '/src/etc/passwd' END || CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS path FROM part)")
def guarded_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").selectExpr("CASE p_partkey % 4 WHEN 0 THEN '/src/a' WHEN 1 THEN '/src/.ssh/id' WHEN 2 THEN '/other/b' ELSE '/src/etc/passwd' END || CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey AS STRING) ELSE '' END AS path")
    return d.select("path", R.allowed(F.col("path"), "/src").alias("allowed"))


_TRUTH = [_quoted(p) for p in T.TRUTH_PATTERNS]
FIDELITY = f"""{RENDERED}, facts AS (SELECT path, list_distinct(flatten([{", ".join(f"regexp_extract_all(content, {p}, 1)" for p in _TRUTH)}])) AS truth, list_distinct(regexp_extract_all(view, '([A-Za-z_$][\\w$]*)', 1)) AS ids FROM rendered),
fidelity AS (SELECT path, len(truth) AS symbols, len(list_intersect(truth, ids)) AS found, len(truth) - len(list_intersect(truth, ids)) AS missed, len(list_intersect(truth, ids)) / len(truth) AS recall, len(list_intersect(truth, ids)) / len(ids) AS precision FROM facts WHERE len(truth) > 0)"""


#: The same for views that are cut to their first lines, which lose names.
SHORT = 13
CUT_FIDELITY = FIDELITY.replace("regexp_extract_all(view,", f"regexp_extract_all(array_to_string(list_slice(string_split(view, chr(10)), 1, {SHORT}), chr(10)),")


def _fidelity(spark: SparkSession, sf: str, lines: int | None = None) -> DataFrame:
    from ..operators.scores import fidelity

    d = G.signatures(files(spark, sf), "content")
    view = S.rendered(F.col("sig"), F.col("language"))
    return fidelity(d.select("path", "content", (S.first_lines(view, lines) if lines else view).alias("compressed")))


@query(f"WITH {FIDELITY} SELECT path, CAST(symbols AS BIGINT) AS symbols, CAST(found AS BIGINT) AS found, CAST(missed AS BIGINT) AS missed, recall, precision FROM fidelity")
def symbol_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    return _fidelity(spark, sf)


@query(f"WITH {CUT_FIDELITY}, b AS (SELECT CASE WHEN recall >= 1 THEN '100%' WHEN recall >= 0.95 THEN '95-99%' WHEN recall >= 0.9 THEN '90-94%' WHEN recall >= 0.75 THEN '75-89%' WHEN recall >= 0.5 THEN '50-74%' ELSE '<50%' END AS bucket FROM fidelity) SELECT v.bucket, count(b.bucket) AS files FROM (VALUES ('100%'), ('95-99%'), ('90-94%'), ('75-89%'), ('50-74%'), ('<50%')) v(bucket) LEFT JOIN b ON b.bucket = v.bucket GROUP BY v.bucket")
def recall_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scores import histogram

    return histogram(spark, _fidelity(spark, sf, SHORT))


@query(f"WITH {SIGNATURES} SELECT path, {_NAME['function']} AS name FROM (SELECT path, unnest(functions) AS line FROM sigs)")
def function_names(spark: SparkSession, sf: str) -> DataFrame:
    return G.signatures(files(spark, sf)).select("path", F.explode("sig.functions").alias("line")).select("path", T.symbol_name(F.col("line"), "function").alias("name"))


@query(f"WITH {SIGNATURES} SELECT path, CASE WHEN path LIKE '%.sh' THEN NULL WHEN path LIKE '%.py' THEN '{{' ELSE './f' || CAST(k + 150 AS VARCHAR) END AS source, CASE WHEN path LIKE '%.sh' THEN NULL WHEN path LIKE '%.py' THEN '{{' ELSE 'a' || CAST(k AS VARCHAR) || ',b' END AS names FROM sigs")
def parsed_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's first import; Python reads a word after `import`, whatever it is."""
    d = G.signatures(files(spark, sf)).select("path", T.parse_import(F.get(F.col("sig.imports"), 0), F.col("language")).alias("p"))
    return d.select("path", "p.source", F.array_join("p.names", ",").alias("names"))


@query(f"WITH {RENDERED} SELECT path, md5(view) AS digest FROM rendered")
def structure_views(spark: SparkSession, sf: str) -> DataFrame:
    d = G.signatures(files(spark, sf), "content")
    return d.select("path", F.md5(S.structure_view(F.col("content"), F.col("language"), F.col("sig"))).alias("digest"))


#: Long sources: 125 keys of YAML, whose view exceeds the source, and as many functions of Python, whose view doesn't.
_N = 125
_LONG = f"""SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN array_to_string(list_transform(range(0, {_N}), lambda i: 'k' || i || ': 1'), chr(10)) ELSE array_to_string(list_transform(range(0, {_N}), lambda i: 'x = 1' || chr(10) || 'def f' || i || '(): return 1'), chr(10)) END AS content FROM part"""


def _capped(n: int) -> str:
    shown = f"list_transform(range(0, {n - 4}), lambda i: CASE p_partkey % 2 WHEN 0 THEN 'k' || i || ': 1' ELSE 'def f' || i || '()' END)"
    head = "CASE p_partkey % 2 WHEN 0 THEN '// Language: yaml' ELSE '// Language: python' END || chr(10) || '// Extracted signature' || chr(10) || chr(10) || CASE p_partkey % 2 WHEN 0 THEN '// ─── Classes / Types ───' ELSE '// ─── Functions ───' END || chr(10)"
    return f"{head} || array_to_string({shown}, chr(10)) || chr(10) || '... {_N + 5 - n} more lines'"


@query(f"SELECT p_partkey, CASE WHEN length(long) > length(content) THEN short ELSE long END AS view FROM (SELECT *, {_capped(S.STRUCTURE_CAP)} AS long, {_capped(S.STRUCTURE_SHORT)} AS short FROM ({_LONG}))")
def long_structure_views(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of many declarations: the view is cut, and cut shorter where it still exceeds the source."""
    many = lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_N - 1)), f), "\n")
    named = lambda i, before, after: F.concat(F.lit(before), i.cast("string"), F.lit(after))
    yaml = F.col("p_partkey") % 2 == 0
    content = F.when(yaml, many(lambda i: named(i, "k", ": 1"))).otherwise(many(lambda i: named(i, "x = 1\ndef f", "(): return 1")))
    d = settled(parts(spark, sf).select("p_partkey", F.when(yaml, "yaml").otherwise("python").alias("language")), content=content)
    d = settled(d, sig=signature(F.col("content"), F.col("language")))
    return d.select("p_partkey", S.structure_view(F.col("content"), F.col("language"), F.col("sig")).alias("view"))


_MOST = "SELECT path, recall FROM fidelity WHERE recall < 1 ORDER BY recall, path LIMIT 10"


@query(f"WITH {CUT_FIDELITY} {_MOST}")
def worst_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the ten files that lose most."""
    return _fidelity(spark, sf, SHORT).where("recall < 1").select("path", "recall").orderBy("recall", "path").limit(10)


@query(f"WITH {FIDELITY} SELECT CAST(sum(found) AS DOUBLE) / sum(symbols) AS by_symbol, avg(recall) AS by_file, CAST(sum(found) AS DOUBLE) / sum(symbols) >= 0.95 AS passed FROM fidelity")
def fidelity_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _fidelity(spark, sf).agg((F.sum("found") / F.sum("symbols")).alias("by_symbol"), F.avg("recall").alias("by_file"), (F.sum("found") / F.sum("symbols") >= 0.95).alias("passed"))
