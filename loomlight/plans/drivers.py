"""Queries over the drivers: answers of the graph and of reports, cleaned texts, cache checks, catalogs, memory, images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import metrics as M
from ..functions import signatures as S
from ..operators import ask as A
from ..operators import cache as C
from ..operators import catalog as K
from ..operators import compress as Z
from ..operators import graph as G
from ..operators import images as I
from ..operators import memory as E
from ..operators import scores as V
from ..sources import files as R
from ..sources import report as P
from ..sources.shared import settled
from . import code, tables
from .code import _NAMED, FILES, RENDERED
from .tables import pct, tok

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _savings(o: str, p: str) -> str:
    return f"CAST(CASE WHEN {p} > {o} OR {o} = 0 THEN 0 ELSE greatest(0, floor(({o} - {p}) / {o} * 100 + 0.5)) END AS BIGINT)"


# ---- the graph: the place of a symbol in its file is that of its first line
_ORD = """placed AS (SELECT n.*, CASE kind WHEN 'module' THEN -1 WHEN 'function' THEN 0 WHEN 'class' THEN 1 WHEN 'import' THEN 2 ELSE 3 END AS section FROM nodes n)"""
_MATCH = "(contains(lower(name), '{0}') OR contains(lower(key), '{0}'))"


@query(f"WITH {_NAMED} SELECT file, count(*) AS symbols FROM nodes WHERE contains(lower(file), '/m7/') GROUP BY file")
def graph_file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of every file whose path matches, counted."""
    nodes = code.stored(spark, sf).nodes
    return G.file_symbols(nodes, "/M7/").groupBy("file").agg(F.max("symbols").alias("symbols"))


@query(f"WITH {_NAMED}, m AS (SELECT * FROM nodes WHERE contains(lower(file), '/m7/')) SELECT (SELECT count(*) FROM m) AS nodes_traversed, 'symbol' AS source, (SELECT string_agg('// ' || file, chr(10) ORDER BY file) FROM (SELECT DISTINCT file FROM m ORDER BY file LIMIT 5)) AS headings")
def ask_file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The first five files of the answer, and what all of them hold."""
    nodes, edges = (g := code.stored(spark, sf)).nodes, g.edges
    headings = F.array_join(F.filter(F.split("result", "\n"), lambda x: x.startswith("// ")), "\n")
    return A.ask(nodes, edges, "/m7/", "file_symbols").select("nodes_traversed", "source", headings.alias("headings"))


@query(f"WITH {_NAMED}, {_ORD}, m AS (SELECT *, row_number() OVER (ORDER BY file, section, key) AS r, count(*) OVER () AS n FROM placed WHERE {_MATCH.format('c1')}) SELECT '// Search results for \"c1\" (' || max(n) || ' matches)' || chr(10) || chr(10) || string_agg(kind || ': ' || name || ' — ' || file, chr(10) ORDER BY r) FILTER (r <= 25) || CASE WHEN max(n) > 25 THEN chr(10) || '... and ' || (max(n) - 25) || ' more results' ELSE '' END AS result, max(n) AS nodes_traversed FROM m")
def ask_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = (g := code.stored(spark, sf)).nodes, g.edges
    return A.ask(nodes, edges, "c1", "search").select("result", "nodes_traversed")


_FIRST = f"{_ORD}, seed AS (SELECT key FROM placed WHERE {_MATCH.format('.ts')} ORDER BY file, section, key LIMIT 3)"
_DEEP = f"""WITH RECURSIVE {_NAMED}, {_FIRST}, walk AS (SELECT key, 0 AS depth FROM seed UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.key WHERE w.depth < 3)
SELECT count(DISTINCT key) AS nodes_traversed, 'depends_on' AS kind FROM walk"""


@query(_DEEP)
def ask_depends_on(spark: SparkSession, sf: str) -> DataFrame:
    """From the first three matches."""
    nodes, edges = (g := code.stored(spark, sf)).nodes, g.edges
    return A.ask(nodes, edges, ".ts", "depends_on").select("nodes_traversed", "kind")


_TEXT = "# Graph Report - demo (2026-05-17)\nBuilt from commit: `abcdef0123`\n## Community Hubs\n- Community core\n## God Nodes\n1. `Hub` - 26 edges\n## Summary\n- ten nodes\n## End"


@query("SELECT 'No symbols matching \"hub\".' || chr(10) || chr(10) || '--- from the report ---' || chr(10) || '// report search: \"hub\"' || chr(10) || chr(10) || '  Hub (26 edges)' || chr(10) || '  ## Community Hubs' AS result, CAST(1 AS BIGINT) AS nodes_traversed, 'symbol+report' AS source, true AS warned")
def ask_falls_back(spark: SparkSession, sf: str) -> DataFrame:
    """A search that no symbol matches is answered by the report, with a warning that it is stale."""
    nodes, edges = (g := code.stored(spark, sf)).nodes, g.edges
    return A.ask(nodes, edges, "hub", "search", report=_TEXT, head="9999999aaaa").select("result", "nodes_traversed", "source", F.contains("note", F.lit("stale (built abcdef0, head 9999999)")).alias("warned"))


@query(f"WITH {_NAMED} SELECT DISTINCT coalesce(n.kind, 'none') AS kind, count(*) AS n FROM nodes n GROUP BY n.kind")
def kept_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A graph kept by its files' manifest: opened twice, built once."""
    code.stored(spark, sf)
    return code.stored(spark, sf).nodes.groupBy("kind").agg(F.count("*").alias("n"))


# ---- reports
_REPORTED = "SELECT n_nationkey, 'Hub' || n_name AS hub, n_nationkey + 2 AS edges, n_name AS name FROM nation"


@query(f"SELECT n_nationkey, '// report: ' || name || chr(10) || chr(10) || '## Hubs (most connected)' || chr(10) || '1. ' || hub || ' (' || edges || ' edges)' || chr(10) || '2. Other (1 edges)' AS hubs, '// report: ' || name || chr(10) || '## Summary' || chr(10) || '- ten nodes' || chr(10) || '## Community hubs (first ones)' || chr(10) || '## Community Hubs' || chr(10) || '- Community ' || name AS map, CASE WHEN n_nationkey <> 7 THEN 'The report may be stale (built abcdef0, head ABCDEF0).' END AS warning, {tok(tables._REPORT)} AS tokens FROM ({_REPORTED}) JOIN nation USING (n_nationkey)")
def report_views(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return tables.reports(spark, sf).select("n_nationkey", P.hubs_view(t).alias("hubs"), P.map_view(t).alias("map"), P.stale_warning(t, F.lit("ABCDEF00712")).alias("warning"), P.report_tokens(t).alias("tokens"))


# ---- views of files, from a cache or made
@query(f"WITH {RENDERED}, c AS (SELECT *, k % 3 = 0 AS kept FROM rendered), m AS (SELECT path, CASE WHEN kept THEN 'cached' ELSE language END AS language, CASE WHEN kept THEN 'kept view' ELSE view END AS view, CASE WHEN kept THEN 1000 ELSE {tok('content')} END AS o, CASE WHEN kept THEN 5 ELSE {tok('view')} END AS p FROM c) SELECT path, language, md5(view) AS digest, CAST(o AS BIGINT) AS original_tokens, CAST(p AS BIGINT) AS optimized_tokens, {_savings('o', 'p')} AS savings_percent FROM m WHERE language IN ('cached', 'typescript', 'python', 'sql', 'bash')")
def compressed_or_cached(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the files is in the cache; the views of the rest are made."""
    d = code.files(spark, sf)
    cache = d.where("k % 3 = 0").select(F.col("path").alias("file_path"), M.content_hash(F.col("content")).alias("hash"), F.lit("kept view").alias("content"), F.lit(5).cast("long").alias("tokens"), F.lit(1000).cast("long").alias("original_tokens"), F.lit(2).cast("long").alias("hit_count"))
    out = Z.files(d.select("path", "content"), "signature", cache)
    return out.where("language IN ('cached', 'typescript', 'python', 'sql', 'bash')").select("path", "language", F.md5("view").alias("digest"), "original_tokens", "optimized_tokens", "savings_percent")


# ---- JSON texts
_DATA = """CASE p_partkey % 3 WHEN 0 THEN '[{"id": ' || CAST(p_partkey AS VARCHAR) || ', "name": "' || p_type || '"}, {"id": 0, "name": null}]' WHEN 1 THEN '{ "a": ' || CAST(p_size AS VARCHAR) || ', "b": "x" }' ELSE 'not json ' || p_type END"""
_TOON = """CASE p_partkey % 3 WHEN 0 THEN 'id|name' || chr(10) || CAST(p_partkey AS VARCHAR) || '|' || p_type || chr(10) || '0|' WHEN 1 THEN 'a: ' || CAST(p_size AS VARCHAR) || chr(10) || 'b: x' ELSE data END"""
_COMPACT = """CASE p_partkey % 3 WHEN 0 THEN '[{"id":' || CAST(p_partkey AS VARCHAR) || ',"name":"' || p_type || '"},{"id":0,"name":null}]' WHEN 1 THEN '{"a":' || CAST(p_size AS VARCHAR) || ',"b":"x"}' ELSE data END"""
_LISTED = """CASE p_partkey % 3 WHEN 0 THEN 'id' || chr(10) || CAST(p_partkey AS VARCHAR) || chr(10) || '0' WHEN 1 THEN '{}' ELSE data END"""


def _cleaned(form: str, made: str) -> None:
    o, p = tok("data"), tok("cleaned")
    note = f"CASE WHEN id % 3 = 2 THEN 'Not valid JSON, returned as it is.' ELSE 'JSON in the {form} form. ' || o || ' → ' || p || ' tokens (' || {pct('o', 'p')} || '% saved).' END"
    sql = f"SELECT id, cleaned, format, o AS original_tokens, p AS optimized_tokens, {pct('o', 'p')} AS savings_percent, {note} AS note FROM (SELECT *, {o} AS o, {p} AS p FROM (SELECT p_partkey AS id, data, {made} AS cleaned, CASE WHEN p_partkey % 3 = 2 THEN 'passthrough' ELSE '{form}' END AS format FROM (SELECT *, {_DATA} AS data FROM part)))"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = settled(code.parts(spark, sf), data=F.expr(_DATA.replace("VARCHAR", "STRING"))).select(F.col("p_partkey").alias("id"), "data")
        return Z.cleaned(d, form, ["id"]).drop("original")

    run.__name__, run.__doc__ = f"cleaned_{form}", f"JSON texts in the {form} form, other texts as they are."
    query(sql)(run)


for _form, _made in (("toon", _TOON), ("compact", _COMPACT), ("whitelist", _LISTED)):
    _cleaned(_form, _made)


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, printf('%.1f%%', (doc_id % 1000) / 10.0) AS share FROM documents")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", M.preview(F.col("text")).alias("preview"), M.percent_text((F.col("doc_id") % 1000) / 1000.0).alias("share"))


# ---- the cache
_CACHED = "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS file_path, 'h' || CAST(c_custkey % 10 AS VARCHAR) AS hash, c_name AS content, CAST(c_custkey % 40 AS BIGINT) AS tokens, CAST(c_custkey % 90 AS BIGINT) AS original_tokens, 'file' AS type, CAST(c_custkey % 4 AS BIGINT) AS hit_count, CAST(c_custkey AS BIGINT) AS updated_at FROM customer WHERE c_nationkey < 15"
_SEEN = "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS file_path, 'h' || CAST(c_custkey % 10 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS hash FROM customer WHERE c_nationkey > 5"


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("driver_customer")
    return tuple(spark.sql(q.replace("VARCHAR", "STRING").replace("FROM customer", "FROM driver_customer")) for q in (_CACHED, _SEEN))


_STUB = tok("'[cached] ' || e.file_path || ' unchanged. ' || e.tokens || ' tokens.'")


@query(f"SELECT s.file_path, CASE WHEN e.hash IS NULL THEN 'miss' WHEN e.hash = s.hash THEN 'hit' ELSE 'update' END AS status, CASE WHEN e.hash = s.hash THEN e.hit_count + 1 END AS hit_count, CASE WHEN e.hash = s.hash THEN {_STUB} END AS stub_tokens, CASE WHEN e.hash = s.hash THEN CAST(floor((e.original_tokens - {_STUB}) / greatest(e.original_tokens, 1) * 100 + 0.5) AS BIGINT) END AS savings_percent, CASE WHEN e.hash IS NULL THEN 'Not in the cache.' WHEN e.hash <> s.hash THEN 'Changed (was ' || e.hash || ', is ' || s.hash || '); the entry is dropped.' ELSE 'Cache hit #' || (e.hit_count + 1) || ', unchanged (hash ' || s.hash || '). ' || CASE WHEN e.original_tokens > e.tokens THEN 'Saved ~' || (e.original_tokens - e.tokens) || ' tokens.' ELSE 'The kept view is not smaller than the file.' END END AS note FROM ({_SEEN}) s LEFT JOIN ({_CACHED}) e USING (file_path)")
def cache_checks(spark: SparkSession, sf: str) -> DataFrame:
    return C.checked(*_cache(spark, sf)).drop("hash", "content")


@query(f"SELECT e.hash, content, tokens, original_tokens AS originalTokens, CASE WHEN s.hash = e.hash THEN greatest(updated_at, 7) ELSE updated_at END AS timestamp, CASE WHEN s.hash = e.hash THEN hit_count + 1 ELSE hit_count END AS hitCount, e.file_path AS filePath, type FROM ({_CACHED}) e LEFT JOIN ({_SEEN}) s USING (file_path) WHERE s.hash IS NULL OR s.hash = e.hash")
def cache_after_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Hits are counted, changed files have left; under the names that clients know."""
    return C.as_client_rows(C.after_check(*_cache(spark, sf), now_ms=7))


@query(f"SELECT count(*) AS removed FROM ({_CACHED})")
def cache_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return C.clear(_cache(spark, sf)[0])[1]


@query(f"SELECT *, 'table cache: ' || entries || ' entries, ' || total_hits || ' hits, ' || tokens_saved || ' tokens saved.' AS note FROM (SELECT count(*) AS entries, CAST(sum(hit_count) AS BIGINT) AS total_hits, CAST(sum(hit_count * greatest(0, original_tokens - tokens)) AS BIGINT) AS tokens_saved FROM ({_CACHED}))")
def cache_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.report(_cache(spark, sf)[0])


@query("SELECT 'c1' AS file_path, 'h1' AS hash FROM customer WHERE c_custkey = 1")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("'c' || CAST(c_custkey AS STRING) AS file_path", "'h' || CAST(c_custkey % 10 AS STRING) AS hash")
    return C.lookup(d, "c1")


# ---- memory
@query("SELECT * FROM (VALUES ('write', 'k1', 'one', 26, 'Stored \"k1\" (3 chars).'), ('write', 'k2', NULL, 26, 'Error: a value is required.'), ('read', 'k1', 'one', 26, 'Found \"k1\" (3 chars).'), ('read', 'k9', NULL, 26, 'Key \"k9\" not found.'), ('delete', 'k1', NULL, 25, 'Deleted \"k1\".'), ('delete', 'k1', NULL, 25, 'Key \"k1\" not found. Nothing deleted.'), ('clear', '*', NULL, 0, 'Cleared 25 entries.'), ('fly', 'k1', NULL, 0, 'Unknown action \"fly\". Known are read, write, delete, list, clear.')) v(action, key, value, entries, note)".replace(", 26,", ", CAST(26 AS BIGINT),").replace(", 25,", ", CAST(25 AS BIGINT),").replace(", 0,", ", CAST(0 AS BIGINT),"))
def memory_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A session's actions on a store that begins with a key a nation."""
    store = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("mem_key"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("updated_at"))
    rows = None
    for action, key, value in (("write", "k1", "one"), ("write", "k2", None), ("read", "k1", None), ("read", "k9", None), ("delete", "k1", None), ("delete", "k1", None), ("clear", "", None), ("fly", "k1", None)):
        store, row = E.act(store, action, key, value, 1000)
        rows = row if rows is None else rows.unionAll(row)
    return rows


@query("SELECT 'list' AS action, '*' AS key, string_agg(n_name || ': ' || length(n_name) || ' chars', chr(10) ORDER BY n_nationkey DESC) AS value, count(*) AS entries, count(*) || ' entries.' AS note FROM nation")
def memory_list_action(spark: SparkSession, sf: str) -> DataFrame:
    """The list action on a store of a key a nation."""
    store = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("mem_key"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("updated_at"))
    return E.act(store, "list")[1]


# ---- catalogs
_ASKED = "SELECT 's' || CAST(p_partkey % 20 AS VARCHAR) AS server, CASE WHEN p_partkey % 500 = 0 THEN 'nope' ELSE 't' || CAST(p_partkey AS VARCHAR) END AS tool FROM part"


@query(f"WITH t AS ({tables._TOOLS}), a AS (SELECT server, string_agg(name, ', ' ORDER BY ord) AS names FROM t GROUP BY server) SELECT w.server, w.tool, t.description, t.input_schema, CASE WHEN t.name IS NULL THEN 'tool ' || w.tool || ' not found on ' || w.server || '; available: ' || names END AS error FROM ({_ASKED}) w LEFT JOIN t ON t.server = w.server AND t.name = w.tool LEFT JOIN a ON a.server = w.server")
def described_tools(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of each tool; a name that isn't there has an error that lists those that are."""
    wanted = spark.read.parquet(f"{sf}/part.parquet").selectExpr("'s' || CAST(p_partkey % 20 AS STRING) AS server", "CASE WHEN p_partkey % 500 = 0 THEN 'nope' ELSE 't' || CAST(p_partkey AS STRING) END AS tool")
    return K.described(wanted, tables.tools(spark, sf)).drop("tokens")


_ROW = """'{"server":"' || server || '","name":"' || name || '","summary":"' || summary || '","params":"' || params || '"}'"""


@query(f"WITH {tables._CATALOG} SELECT tools, o AS original_tokens, p AS optimized_tokens, greatest(0, {pct('o', 'p')}) AS savings_percent FROM (SELECT count(*) AS tools, CAST(sum(original_tokens) AS BIGINT) AS o, CAST(sum({tok(_ROW)}) AS BIGINT) AS p FROM catalog)")
def catalog_cost(spark: SparkSession, sf: str) -> DataFrame:
    return K.cost(K.compressed(tables.tools(spark, sf)))


# ---- files validated by their own views
_HEAD = "'^([A-Za-z_$][\\w$]*)'"
_BARE = "regexp_replace(regexp_replace(x, '^export\\s+(default\\s+)?(async\\s+)?', ''), '^(type|interface|const|let|var|function|class|enum|namespace)\\s+', '')"
_SYMBOLS = f"""list_sort(list_distinct(list_filter(flatten([list_transform(exports, lambda x: regexp_extract({_BARE}, {_HEAD}, 1)),
  list_transform(functions, lambda x: regexp_extract(x, '^(?:async\\s+)?function\\s+([A-Za-z_$][\\w$]*)', 1)),
  list_transform(classes, lambda x: regexp_extract(x, '^(?:abstract\\s+)?class\\s+([A-Za-z_$][\\w$]*)', 1))]), lambda x: x <> '')))"""
_VALIDATED = f"{code.RENDERED}, truth AS (SELECT path, language, view, {_SYMBOLS} AS symbols, {tok('content')} AS raw_tokens, {tok('view')} AS view_tokens FROM rendered)"


@query(f"WITH {_VALIDATED} SELECT path, language, array_to_string(symbols, ',') AS symbols, md5(view) AS digest, raw_tokens, view_tokens, {pct('raw_tokens', 'view_tokens')} AS savings_percent FROM truth")
def ground_truths(spark: SparkSession, sf: str) -> DataFrame:
    """What answers about each file are scored by, from the file's view."""
    d = V.ground_truth(code.files(spark, sf))
    return d.withColumn("symbols", F.array_join("symbols", ",")).withColumn("digest", F.md5("view")).drop("view")


@query(f"WITH {_VALIDATED}, n AS (SELECT path, len(symbols) AS n FROM truth) SELECT path, 1.0::DOUBLE AS recall, CASE WHEN n = 0 THEN 0.0 ELSE least(n / 3, 1.0) END AS usage, CASE WHEN n = 0 THEN 0.0 ELSE least(n / 2, 1.0) END AS specificity, CAST(floor(40 + CASE WHEN n = 0 THEN 0 ELSE least(n / 3, 1.0) * 35 + least(n / 2, 1.0) * 25 END + 0.5) AS BIGINT) AS score FROM n")
def validated_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's view, asked of a provider that knows all of its symbols."""
    return V.validate(V.ground_truth(code.files(spark, sf)).select("path", "symbols")).drop("verdict")


def _filled(text: str) -> str:
    return f"replace(replace('{text}', '{{path}}', path), '{{n}}', CAST(len(symbols) AS VARCHAR))"


_ASKED_OF_ALL = " UNION ALL ".join(f"SELECT path, '{p}' AS prompt_id, '{scorer}' AS scorer, {_filled(V.QUESTIONS[p][0])} AS question, {_filled(V.QUESTIONS[p][1])} AS expected FROM truth" for p, scorer in V.PROMPTS)


@query(f"WITH {_VALIDATED} {_ASKED_OF_ALL}")
def file_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The four questions about every file, and what answers should hold."""
    return V.validate(V.ground_truth(code.files(spark, sf)).select("path", "symbols"), "prompts")


# ---- scores of a provider
@query(f"WITH {tables._TRUTH} SELECT path, CASE WHEN len(symbols) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(symbols, lambda s: contains(lower(array_to_string(list_slice(symbols, 1, len(symbols) // 2), chr(10))), lower(s)))) / len(symbols) END AS recall FROM truth")
def faulty_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run with the faulty provider."""
    return V.validate(tables._truth(spark, sf).select("path", "symbols"), "run", by="faulty").select("path", "recall")


# ---- pictures
@query("SELECT o_orderkey AS id, CASE WHEN c > 70 THEN 'text' ELSE 'visual' END AS intent, CASE WHEN c <= 70 THEN CAST(least(w, 512) AS BIGINT) END AS new_width, CASE WHEN c > 70 THEN 'text recognised' WHEN c < 30 THEN 'no text' ELSE 'mixed, kept as a picture' END AS why FROM (SELECT *, o_orderkey % 2000 AS w, o_orderkey % 101 AS c FROM orders)")
def image_answers(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2000).alias("width"), (F.col("o_custkey") % 1500).alias("height"), (F.col("o_orderkey") % 101).alias("confidence"), F.col("o_orderpriority").alias("text"))
    return I.answered(d).select("id", "intent", "new_width", "why")


# ---- walkers, and tokens by a vocabulary
@query(f"SELECT path FROM (SELECT CASE WHEN k % 7 = 0 THEN '/tests' WHEN k % 7 = 1 THEN '/.hidden' ELSE '' END || path AS path FROM ({FILES.replace('STRING', 'VARCHAR')}) WHERE k % 7 <> 0) WHERE path LIKE '%.ts'")
def script_files(spark: SparkSession, sf: str) -> DataFrame:
    """Script files outside of folders of tests; hidden folders are walked."""
    d = code.files(spark, sf).selectExpr("CASE WHEN k % 7 = 0 THEN '/tests' WHEN k % 7 = 1 THEN '/.hidden' ELSE '' END || path AS path")
    return d.where(R.is_script(F.col("path")))


_WALKED = "CASE k % 7 WHEN 0 THEN '/target' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/vendor' ELSE '' END || path || CASE WHEN k % 11 = 0 THEN '.bin' WHEN k % 11 = 1 THEN '.MD' ELSE '' END AS path"


@query(f"SELECT path FROM (SELECT {_WALKED} FROM ({FILES.replace('STRING', 'VARCHAR')}) WHERE k % 7 <> 0) WHERE regexp_matches(path, '\\.(ts|py|sql|yaml|sh|md|MD)$')")
def benchmark_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the benchmark measures: hidden and vendor's folders are walked, those of built files aren't."""
    return code.files(spark, sf).selectExpr(_WALKED).where(R.is_measured(F.col("path")))


@query()
def bpe_savings(spark: SparkSession, sf: str) -> DataFrame:
    """Savings of the summary view by language, in tokens of a byte-pair encoding; SQL has none."""
    import public_tokenizers

    d = tables.read(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("text"), S.head_and_tail(F.col("text")).alias("view"))
    texts = d.select(F.explode(F.array(*[F.struct(F.struct("language", F.lit(of).alias("of")).alias("id"), F.col(of).alias("text")) for of in ("text", "view")])).alias("t")).select("t.*")
    n = bpe.token_counts(texts, public_tokenizers.path("byte_bpe_50k.json")).groupBy("id.language").agg(*[F.sum(F.when(F.col("id.of") == of, F.col("tokens"))).alias(c) for of, c in (("text", "original_tokens"), ("view", "optimized_tokens"))])
    files = d.groupBy("language").agg(F.count("*").alias("files"))
    return files.join(n, files.language.eqNullSafe(n.language)).select(files.language, "files", "original_tokens", "optimized_tokens", M.percent_saved(F.col("original_tokens"), F.col("optimized_tokens")).alias("savings_percent"))


@query()
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of every document by a byte-pair encoding, from its distinct pieces; SQL has none."""
    import public_tokenizers

    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return bpe.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
