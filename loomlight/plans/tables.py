"""Queries over the driver's tables: savings, caches, JSON tables, catalogs, scores, images and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontable as J
from ..functions import metrics as M
from ..functions import signatures as S
from ..functions import text as T
from ..operators import cache as C
from ..operators import catalog as K
from ..operators import images as I
from ..operators import scores as V
from ..sources import report as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tok(x: str) -> str:
    return f"CAST(CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '\\S') THEN 0 ELSE ceil(length({x}) / 4.0) END AS BIGINT)"


def pct(o: str, p: str) -> str:
    return f"CAST(CASE WHEN {o} > 0 THEN floor(({o} - {p}) / {o} * 100 + 0.5) ELSE 0 END AS BIGINT)"


# ---- savings over documents
_VIEW = "CASE WHEN len(string_split(text, chr(10))) > 70 THEN array_to_string(list_concat(list_concat(list_slice(string_split(text, chr(10)), 1, 50), ['... ' || CAST(len(string_split(text, chr(10))) - 70 AS VARCHAR) || ' lines omitted ...']), list_slice(string_split(text, chr(10)), -20, -1)), chr(10)) ELSE text END"
_TWO = "array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10))"


@query(f"SELECT lang AS language, count(*) AS files, CAST(sum({tok('text')}) AS BIGINT) AS original_tokens, CAST(sum({tok(_VIEW)}) AS BIGINT) AS optimized_tokens, {pct(f'sum({tok("text")})', f'sum({tok(_VIEW)})')} AS savings_percent FROM documents GROUP BY lang")
def corpus_savings(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("lang").alias("language"), M.tokens(F.col("text")).alias("original_tokens"), M.tokens(S.head_and_tail(F.col("text"))).alias("optimized_tokens"))
    return V.rollup(d)


@query(f"SELECT doc_id, {tok('text')} AS original_tokens, {tok('v')} AS optimized_tokens, md5(v) AS digest FROM (SELECT *, {_VIEW} AS v FROM documents)")
def head_and_tail(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "text", S.head_and_tail(F.col("text")).alias("v"))
    return d.select("doc_id", M.tokens(F.col("text")).alias("original_tokens"), M.tokens(F.col("v")).alias("optimized_tokens"), F.md5("v").alias("digest"))


@query(f"SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS copies, min(doc_id) AS first_doc, CAST((count(*) - 1) * min({tok('text')}) AS BIGINT) AS repeated_tokens FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", M.content_hash(F.col("text")).alias("hash"), M.tokens(F.col("text")).alias("t"))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), ((F.count("*") - 1) * F.min("t")).alias("repeated_tokens")).where("copies > 1")


@query(f"SELECT doc_id, lang, {tok('text')} AS tokens FROM documents ORDER BY {tok('text')} DESC, doc_id LIMIT 10")
def largest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A report of ten."""
    return read(spark, sf, "documents").select("doc_id", "lang", M.tokens(F.col("text")).alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(10)


@query(f"SELECT files, o AS original_tokens, p AS optimized_tokens, {pct('o', 'p')} AS savings_percent, (o - p) / 1000000 * 2.5 AS saved_low, (o - p) / 1000000 * 3.0 AS saved_standard, (o - p) / 1000000 * 5.0 AS saved_high FROM (SELECT count(*) AS files, CAST(sum({tok('text')}) AS BIGINT) AS o, CAST(sum({tok(_VIEW)}) AS BIGINT) AS p FROM documents)")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(M.tokens(F.col("text")).alias("original_tokens"), M.tokens(S.head_and_tail(F.col("text"))).alias("optimized_tokens"))
    return V.totals(d)


@query(f"SELECT doc_id, {tok('text')} AS tokens, CASE WHEN {tok('text')} >= 1000000 THEN printf('%.2fM', {tok('text')} / 1000000) WHEN {tok('text')} >= 1000 THEN printf('%.1fk', {tok('text')} / 1000) ELSE CAST({tok('text')} AS VARCHAR) END AS shown FROM documents")
def human_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = M.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", t.alias("tokens"), M.human_tokens(t).alias("shown"))


@query("SELECT doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Za-z_$][\\w$]*)', 1))), ',')) AS digest FROM documents")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(T.identifiers(F.col("text"))), ",")).alias("digest"))


# ---- the cache, replayed on events: users read a file of theirs, purchases store it
_TRACE = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'store' ELSE 'check' END AS action, user_id AS path, CAST(user_id % 3 AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END AS hash FROM events"
_REPLAY = f"""trace AS ({_TRACE}),
epochs AS (SELECT *, sum(CASE WHEN action = 'store' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq) AS epoch FROM trace),
stored AS (SELECT *, max(CASE WHEN action = 'store' THEN hash END) OVER (PARTITION BY path, epoch) AS stored FROM epochs),
differing AS (SELECT *, CASE WHEN action = 'check' AND hash <> stored THEN 1 ELSE 0 END AS differs FROM stored),
marked AS (SELECT *, coalesce(max(differs) OVER (PARTITION BY path, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM differing),
judged AS (SELECT *, CASE WHEN action = 'store' THEN 'stored' WHEN epoch = 0 OR dead = 1 THEN 'miss' WHEN differs = 1 THEN 'update' ELSE 'hit' END AS status FROM marked),
replay AS (SELECT *, CAST(sum(CASE WHEN status = 'hit' THEN 1 ELSE 0 END) OVER (PARTITION BY path, epoch ORDER BY seq) AS BIGINT) AS hits FROM judged)"""


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """seq orders an event by time and id; a path's rows are ordered, the whole table never is."""
    e = read(spark, sf, "events")
    return e.select("event_id", F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "signup"), "store").otherwise("check").alias("action"), F.col("user_id").alias("path"), F.concat((F.col("user_id") % 3).cast("string"), F.when(F.col("event_id") % 5 == 0, "x").otherwise("")).alias("hash"))


@query(f"WITH {_REPLAY} SELECT event_id, path, action, status, hits FROM replay")
def cache_replay(spark: SparkSession, sf: str) -> DataFrame:
    return C.replay(trace(spark, sf)).select("event_id", "path", "action", "status", "hits")


@query(f"WITH {_REPLAY} SELECT status, count(*) AS n, count(DISTINCT path) AS paths FROM replay GROUP BY status")
def cache_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return C.replay(trace(spark, sf)).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


_ENTRIES = f"SELECT 'd' || CAST(doc_id AS VARCHAR) AS file_path, substr(sha256(text), 1, 16) AS hash, text AS content, {tok(_TWO)} AS tokens, {tok('text')} AS original_tokens, doc_id % 7 AS hit_count, (doc_id * 7919) % 100003 AS updated_at FROM documents"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), M.content_hash(F.col("text")).alias("hash"), F.col("text").alias("content"), M.tokens(S.first_lines(F.col("text"), 2)).alias("tokens"), M.tokens(F.col("text")).alias("original_tokens"), (F.col("doc_id") % 7).alias("hit_count"), ((F.col("doc_id") * 7919) % 100003).alias("updated_at"))


@query(f"SELECT count(*) AS entries, CAST(sum(hit_count) AS BIGINT) AS total_hits, CAST(sum(hit_count * greatest(0, original_tokens - tokens)) AS BIGINT) AS tokens_saved FROM ({_ENTRIES})")
def cache_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return C.statistics(entries(spark, sf))


@query(f"SELECT file_path, updated_at FROM ({_ENTRIES}) ORDER BY updated_at DESC, file_path LIMIT 200")
def cache_row_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A store capped at 200 rows."""
    return C.keep_newest(entries(spark, sf), 200).select("file_path", "updated_at")


@query(f"SELECT file_path, updated_at FROM (SELECT *, sum(length(content)) OVER (ORDER BY updated_at DESC, file_path) AS s FROM (SELECT * FROM ({_ENTRIES}) ORDER BY updated_at DESC, file_path LIMIT 200)) WHERE s <= 100000")
def cache_char_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A store capped at 200 rows and 100,000 characters."""
    return C.keep_chars(C.keep_newest(entries(spark, sf), 200), 100_000).select("file_path", "updated_at")


def _batched(table: str, key: str, content: str, at: str, half: str, batch: int, batches: int) -> str:
    """SQL of what stays of a table of entries when the oldest go in batches until half of the characters are left."""
    placed = f"SELECT {key} AS file_path, {content} AS content, {at} AS updated_at FROM {table}"
    ranked = f"SELECT *, (row_number() OVER (ORDER BY updated_at, file_path DESC) - 1) // {batch} AS b FROM ({placed})"
    return f"SELECT file_path, updated_at FROM (SELECT *, sum(length(content)) OVER (ORDER BY b DESC RANGE UNBOUNDED PRECEDING) AS s FROM ({ranked})) WHERE s <= {half} OR b >= {batches}"


_ORDER_ENTRIES = ("'o' || CAST(o_orderkey AS VARCHAR)", "o_orderpriority || o_orderstatus", "(o_orderkey * 7919) % 100003")
_LINE_ENTRIES = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)", "l_returnflag || CAST(l_suppkey AS VARCHAR)", "(l_orderkey * 7919) % 100003")


def _entries_of(spark: SparkSession, sf: str, table: str, columns: tuple[str, str, str]) -> DataFrame:
    names = ("file_path", "content", "updated_at")
    return read(spark, sf, table).selectExpr(*[f"{c.replace('VARCHAR', 'STRING')} AS {n}" for c, n in zip(columns, names, strict=True)])


@query(_batched("orders", *_ORDER_ENTRIES, "(SELECT sum(length(o_orderpriority || o_orderstatus)) // 2 FROM orders)", C.CACHE_BATCH, C.MAX_BATCHES))
def cache_batches(spark: SparkSession, sf: str) -> DataFrame:
    """An entry an order, held at half of all characters: batches of 200 go until few enough are left."""
    d = _entries_of(spark, sf, "orders", _ORDER_ENTRIES)
    half = d.agg(F.sum(F.length("content")).alias("n")).first().n // 2
    return C.keep_chars(d, half, batch=C.CACHE_BATCH, batches=C.MAX_BATCHES).select("file_path", "updated_at")


@query(_batched("lineitem", *_LINE_ENTRIES, f"(SELECT sum(length({_LINE_ENTRIES[1]})) // 10 FROM lineitem)", C.CACHE_BATCH, C.MAX_BATCHES))
def cache_batch_limit(spark: SparkSession, sf: str) -> DataFrame:
    """An entry a line of an order, held at a tenth of all characters: a hundred batches go and no more."""
    d = _entries_of(spark, sf, "lineitem", _LINE_ENTRIES)
    tenth = d.agg(F.sum(F.length("content")).alias("n")).first().n // 10
    return C.keep_chars(d, tenth, batch=C.CACHE_BATCH, batches=C.MAX_BATCHES).select("file_path", "updated_at")


@query(f"WITH {_REPLAY.replace('user_id AS path', 'CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS path')} SELECT event_id, path, action, epoch, status, hits FROM replay")
def cache_replay_hot(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all users share one path, whose rows are replayed by many tasks."""
    d = trace(spark, sf).withColumn("path", F.when(F.col("path") % 3 == 0, 0).otherwise(F.col("path")))
    return C.replay(d, parts=32).select("event_id", "path", "action", F.col("epoch"), "status", "hits")


@query(f"SELECT file_path, hit_count, original_tokens, tokens FROM ({_ENTRIES}) ORDER BY updated_at DESC, file_path LIMIT 10")
def session_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the last ten entries."""
    return C.listing(entries(spark, sf), 10).select("file_path", "hit_count", "original_tokens", "tokens")


@query(f"SELECT file_path, hash, CASE WHEN u THEN CAST(0 AS BIGINT) ELSE hit_count END AS hit_count, CASE WHEN u THEN 200000 ELSE updated_at END AS updated_at FROM (SELECT *, hit_count = 3 AS u FROM ({_ENTRIES}))")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = entries(spark, sf)
    new = old.where("hit_count = 3").withColumn("hit_count", F.lit(0).cast("long")).withColumn("updated_at", F.lit(200000).cast("long"))
    return C.upsert(old, new).select("file_path", "hash", "hit_count", "updated_at")


@query(f"SELECT file_path, hit_count + coalesce(n, 0) AS hit_count, greatest(updated_at, coalesce(t, 0)) AS updated_at FROM ({_ENTRIES}) LEFT JOIN (SELECT 'd' || CAST(user_id AS VARCHAR) AS p, count(*) AS n, max(event_id) AS t FROM events GROUP BY 1) ON p = file_path")
def cache_hits_recorded(spark: SparkSession, sf: str) -> DataFrame:
    hits = read(spark, sf, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("file_path"), F.lit(1).alias("n"), F.col("event_id").alias("at"))
    return C.record_hits(entries(spark, sf), hits).select("file_path", "hit_count", "updated_at")


@query(f"SELECT file_path FROM ({_ENTRIES}) WHERE file_path NOT IN (SELECT 'd' || CAST(user_id AS VARCHAR) FROM events)")
def cache_deleted(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("file_path")).distinct()
    return C.delete(entries(spark, sf), gone).select("file_path")


@query("SELECT event_id, strftime(make_timestamp((event_id * 86399123 + 1700000000000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at, CAST(floor((90000000000000 - event_id * 1234) / 1000 + 0.5) AS BIGINT) AS seconds FROM events")
def times(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf, "events").select(e, M.iso_time(e * 86399123 + 1700000000000).alias("at"), M.seconds_since(e * 1234, F.lit(90000000000000)).alias("seconds"))


# ---- JSON tables: each customer's orders as an array of objects
_ORDER = """'{"order":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '|' || '","priority":"' || o_orderpriority || '","tags":[' || CAST(o_orderkey % 3 AS VARCHAR) || ',2],"meta":{"a":1,"b":2}}'"""
_ORDERS = f"SELECT o_custkey AS k, count(*) AS n, '[' || string_agg({_ORDER}, ',' ORDER BY o_orderkey) || ']' AS j FROM orders GROUP BY o_custkey"


def order_arrays(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(_ORDER.replace("VARCHAR", "STRING")).alias("x"))
    o = o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))).alias("l"))
    return o.select("k", F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["x"]), ","), F.lit("]")).alias("j"))


@query(f"SELECT o_custkey AS k, 'order|status|priority|tags|meta' || chr(10) || string_agg(CASE WHEN r <= 3 THEN CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '¦|' || o_orderpriority || '|' || CAST(o_orderkey % 3 AS VARCHAR) || ',2|{{2 fields}}' END, chr(10) ORDER BY o_orderkey) || CASE WHEN count(*) > 3 THEN chr(10) || '... +' || CAST(count(*) - 3 AS VARCHAR) || ' more' ELSE '' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey".replace("{{", "{").replace("}}", "}"))
def json_tables(spark: SparkSession, sf: str) -> DataFrame:
    return order_arrays(spark, sf).select("k", J.table(J.items(F.col("j")), 3).alias("shown"))


@query("SELECT o_custkey AS k, 'order|priority' || chr(10) || string_agg(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS shown FROM orders GROUP BY o_custkey")
def json_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return order_arrays(spark, sf).select("k", J.whitelist(J.items(F.col("j")), ["order", "priority"]).alias("shown"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS shown FROM events")
def json_sections(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", J.toon(F.col("props")).alias("shown"))


@query("SELECT event_id, event_id % 3 <> 2 AS uniform FROM events")
def json_uniform(spark: SparkSession, sf: str) -> DataFrame:
    j = F.expr("CASE event_id % 3 WHEN 0 THEN '[{\"a\":1,\"b\":2},{\"b\":3,\"a\":4}]' WHEN 1 THEN '[' || props || ']' ELSE '[1,' || props || ']' END")
    return read(spark, sf, "events").select("event_id", J.is_uniform(J.items(j)).alias("uniform"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || ',\"a\":[1,2]}' ELSE 'no json' END AS shown FROM events")
def json_compact(spark: SparkSession, sf: str) -> DataFrame:
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1,  2]}'))).otherwise("no json")
    return read(spark, sf, "events").select("event_id", J.compact(j).alias("shown"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'toon' ELSE 'raw-nonjson' END AS format, CASE WHEN event_id % 2 = 0 THEN 'id|name' || chr(10) || CAST(event_id AS VARCHAR) || '|a' || chr(10) || CAST(user_id AS VARCHAR) || '|b' ELSE 'plain' || chr(10) || 'text' END AS content, CAST(event_id % 2 AS BIGINT) AS other_blocks FROM events")
def call_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.format_string('[{"id": %d, "name": "a"}, {"id": %d, "name": "b"}]', "event_id", "user_id")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.when(F.col("event_id") % 2 == 0, F.array(block("text", rows))).otherwise(F.array(block("text", F.lit("plain")), block("image", F.lit("x")), block("text", F.lit("text"))))
    return K.responses(read(spark, sf, "events").select(F.col("event_id").alias("id"), blocks.alias("blocks"))).select(F.col("id").alias("event_id"), "format", "content", "other_blocks")


# ---- a catalog of tools made from parts
_DESCRIPTION = "CASE WHEN p_partkey % 2 = 0 THEN 'Finds  ' || p_name || ' by key. More text e.g. this' ELSE p_name || ' ' || p_type || repeat(' and more', 20) END"
_SCHEMA = """CASE p_partkey % 3 WHEN 0 THEN '{"type":"object","properties":{"a":{"type":"number"},"b":{"type":"string"},"c":{"type":"array","items":{"type":"integer"}}},"required":["a"]}' WHEN 1 THEN '{"properties":{"mode":{"enum":["x","y","z"]},"n":{"type":["string","null"]}}}' ELSE '{}' END"""
_TOOLS = f"SELECT 's' || CAST(p_partkey % 20 AS VARCHAR) AS server, 't' || CAST(p_partkey AS VARCHAR) AS name, {_DESCRIPTION} AS description, {_SCHEMA} AS input_schema, p_partkey AS ord FROM part"


def tools(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").selectExpr("'s' || CAST(p_partkey % 20 AS STRING) AS server", "'t' || CAST(p_partkey AS STRING) AS name", f"{_DESCRIPTION} AS description", f"{_SCHEMA} AS input_schema", "p_partkey AS ord")


_SHORT = "CASE WHEN regexp_matches(d, '\\.(\\s|$)') AND length(regexp_extract(d, '^(.*?)\\.(\\s|$)', 1)) < 200 THEN regexp_extract(d, '^(.*?\\.)(\\s|$)', 1) ELSE d END"
_CATALOG = f"""tools AS ({_TOOLS}), cut AS (SELECT *, {_SHORT} AS s FROM (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS d FROM tools)),
catalog AS (SELECT server, name, CASE WHEN length(s) > 140 THEN substr(s, 1, 137) || '...' ELSE s END AS summary,
  CASE ord % 3 WHEN 0 THEN 'a:num, [b:str], [c:int[]]' WHEN 1 THEN '[mode:x|y|z], [n:string|null]' ELSE '' END AS params,
  {tok("name")} + {tok("description")} + {tok("input_schema")} + 10 AS original_tokens, ord FROM cut)"""


@query(f"WITH {_CATALOG} SELECT server, name, summary, params, original_tokens FROM catalog")
def tool_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return K.compressed(tools(spark, sf)).drop("optimized_tokens")


@query(f"WITH {_CATALOG} SELECT server, name FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY ord) AS r FROM catalog) WHERE r <= 5")
def tool_catalog_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Five tools a server."""
    return K.compressed(tools(spark, sf), per_server=5).select("server", "name")


@query(f"SELECT 's' || CAST(n_nationkey AS VARCHAR) AS server, coalesce(n, 0) AS tools FROM nation LEFT JOIN (SELECT server, count(*) AS n FROM ({_TOOLS}) GROUP BY server) ON server = 's' || CAST(n_nationkey AS VARCHAR) WHERE n_regionkey <> 1")
def enabled_servers(spark: SparkSession, sf: str) -> DataFrame:
    servers = read(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("server"), F.when(F.col("n_regionkey") == 1, True).alias("disabled"))
    return K.by_server(servers, tools(spark, sf))


# ---- scores: conversations answer for benchmark's first words
def _truth(spark: SparkSession, sf: str) -> DataFrame:
    b = read(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.concat(F.lit("src/m"), F.col("item_id").cast("string"), F.lit(".ts")).alias("path"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))).alias("symbols"))


_TRUTH = "truth AS (SELECT item_id AS id, 'src/m' || CAST(item_id AS VARCHAR) || '.ts' AS path, list_sort(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1))) AS symbols FROM benchmark)"
_REPLY = "(SELECT conv_id, array_agg(text ORDER BY turn)[1] AS answer FROM conversations GROUP BY conv_id)"


@query(f"WITH {_TRUTH} SELECT path, conv_id, CASE WHEN len(symbols) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(symbols, lambda s: contains(lower(answer), lower(s)))) / len(symbols) END AS recall, CASE WHEN len(symbols) = 0 THEN 0.0 ELSE least(len(list_filter(symbols, lambda s: regexp_matches(answer, '\\b' || regexp_escape(s) || '\\b'))) / 2, 1.0) END AS specificity, CASE WHEN len(symbols) = 0 THEN 0.0 ELSE least(len(list_intersect(symbols, list_distinct(regexp_extract_all(answer, '([A-Za-z_$][\\w$]*)', 1)))) / 3, 1.0) * 0.5 END AS usage FROM truth JOIN {_REPLY} ON conv_id % (SELECT count(*) FROM benchmark) = id")
def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's first turn as the answer about one benchmark item."""
    replies = read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    items = _truth(spark, sf)
    d = items.join(replies, F.col("conv_id") % items.count() == F.col("id"))
    a, s = F.col("answer"), F.col("symbols")
    return d.select("path", "conv_id", V.recall(a, s).alias("recall"), V.specificity(a, s).alias("specificity"), V.usage(a, s, F.col("path")).alias("usage"))


@query(f"WITH {_TRUTH} SELECT path, 1.0::DOUBLE AS recall, CASE WHEN len(symbols) = 0 THEN 0.0 ELSE least(len(symbols) / 3, 1.0) END AS usage, CASE WHEN len(symbols) = 0 THEN 0.0 ELSE least(len(symbols) / 2, 1.0) END AS specificity, CAST(floor(40 + CASE WHEN len(symbols) = 0 THEN 0 ELSE least(len(symbols) / 3, 1.0) * 35 + least(len(symbols) / 2, 1.0) * 25 END + 0.5) AS BIGINT) AS score FROM truth")
def perfect_answers(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    answers = t.select("path", F.explode(F.array(*[F.lit(p) for p, _ in V.PROMPTS])).alias("prompt_id"), "symbols")
    answers = answers.withColumn("text", V.mock_answer(F.col("symbols"), F.col("path"), F.col("prompt_id")))
    return V.score_answers(answers, t.select("path", "symbols")).drop("verdict")


@query(f"WITH {_TRUTH}, s AS (SELECT path, len(symbols) AS n, list_slice(symbols, 1, len(symbols) // 2) AS half, symbols FROM truth), r AS (SELECT path, CASE WHEN n = 0 THEN 1.0 ELSE len(list_filter(symbols, lambda s: contains(lower(array_to_string(half, chr(10))), lower(s)))) / n END AS recall, n, symbols FROM s) SELECT path, recall, CAST(floor(recall * 40 + 0.5) AS BIGINT) AS recall_part FROM r")
def faulty_answers(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    d = t.withColumn("text", V.mock_answer(F.col("symbols"), F.col("path"), F.lit(V.PROMPTS[0][0]), perfect=False))
    r = V.recall(F.col("text"), F.col("symbols"))
    return d.select("path", r.alias("recall"), M.half_up(r * 40).alias("recall_part"))


@query("SELECT path, prompt_id, scorer FROM (SELECT 'src/m' || CAST(item_id AS VARCHAR) || '.ts' AS path FROM benchmark) CROSS JOIN (VALUES ('p1-list-exports', 'recall'), ('p2-write-usage', 'usage'), ('p3-risk-audit', 'specificity'), ('p4-test-strategy', 'specificity')) v(prompt_id, scorer)")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("prompt_id"), F.lit(s).alias("scorer")) for p, s in V.PROMPTS])
    return _truth(spark, sf).select("path", F.explode(rows).alias("p")).select("path", "p.*")


@query("SELECT c_custkey, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'acceptable' WHEN s >= 30 THEN 'lossy' ELSE 'broken' END AS verdict FROM (SELECT c_custkey, c_custkey % 101 AS s FROM customer)")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", V.verdict(F.col("c_custkey") % 101).alias("verdict"))


# ---- images made from orders: sizes and confidences
@query("SELECT o_orderkey, CASE WHEN conf > 70 THEN 'text' ELSE 'visual' END AS intent, CAST(least(w, 512) AS BIGINT) AS width, CAST(CASE WHEN w > 512 THEN floor(512 * h / w + 0.5) ELSE h END AS BIGINT) AS height, CAST(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE ceil(w * h / 750) END AS BIGINT) AS original_tokens, CAST(CASE WHEN conf > 70 THEN ceil(length(o_orderpriority) / 4) WHEN w <= 0 OR h <= 0 THEN 0 ELSE ceil(least(w, 512) * (CASE WHEN w > 512 THEN floor(512 * h / w + 0.5) ELSE h END) / 1500) END AS BIGINT) AS optimized_tokens FROM (SELECT *, o_orderkey % 2000 AS w, o_custkey % 1500 AS h, o_orderkey % 101 AS conf FROM orders)")
def image_routes(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "orders").withColumns({"w": F.col("o_orderkey") % 2000, "h": F.col("o_custkey") % 1500, "conf": F.col("o_orderkey") % 101})
    w, h, c = F.col("w"), F.col("h"), F.col("conf")
    return d.select("o_orderkey", I.intent(c).alias("intent"), I.resized(w, h)["width"].alias("width"), I.resized(w, h)["height"].alias("height"), M.image_tokens(w, h).alias("original_tokens"), I.routed_tokens(w, h, c, F.col("o_orderpriority")).alias("optimized_tokens"))


# ---- a report a nation
_REPORT = "'# Graph Report - ' || n_name || ' (2026-05-17)' || chr(10) || 'Built from commit: `abcdef' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '`' || chr(10) || '## Community Hubs' || chr(10) || '- Community ' || n_name || chr(10) || '## God Nodes' || chr(10) || '1. `Hub' || n_name || '` - ' || CAST(n_nationkey + 2 AS VARCHAR) || ' edges' || chr(10) || '2. `Other` - 1 edge' || chr(10) || '## Summary' || chr(10) || '- ten nodes' || chr(10) || '## End'"


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", "n_name", F.expr(_REPORT.replace("VARCHAR", "STRING")).alias("text"))


@query("SELECT n_nationkey, n_name AS title, 'Hub' || n_name || '=' || CAST(n_nationkey + 2 AS VARCHAR) || ',Other=1' AS hubs, '## Community Hubs;- Community ' || n_name AS communities, '## Summary' || chr(10) || '- ten nodes' AS summary, 'abcdef' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS commit, '2026-05-17' AS date, n_nationkey <> 7 AS stale FROM nation")
def parsed_reports(spark: SparkSession, sf: str) -> DataFrame:
    d = reports(spark, sf).select("n_nationkey", P.parsed(F.col("text")).alias("p"), P.built(F.col("text")).alias("b"), P.stale(F.col("text"), F.lit("ABCDEF00712")).alias("stale"))
    hubs = F.array_join(F.transform("p.hubs", lambda h: F.concat(h["name"], F.lit("="), h["edges"].cast("string"))), ",")
    return d.select("n_nationkey", "p.title", hubs.alias("hubs"), F.array_join("p.community_lines", ";").alias("communities"), "p.summary", "b.commit", "b.date", "stale")


@query("SELECT n_nationkey, CASE WHEN contains(lower('Hub' || n_name), '1') THEN 'Hub' || n_name || ' (' || CAST(n_nationkey + 2 AS VARCHAR) || ' edges);- Community ' || n_name ELSE '' END AS lines FROM nation")
def report_search(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("n_nationkey", F.array_join(P.found(F.col("text"), "1"), ";").alias("lines"))


# ---- the memory store, of customers
_MEMORY = "SELECT c_name AS mem_key, c_mktsegment || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '!' END AS value, c_custkey AS updated_at FROM customer"


def memory(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").selectExpr("c_name AS mem_key", "c_mktsegment || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '!' END AS value", "c_custkey AS updated_at")


@query(f"SELECT * FROM (SELECT mem_key, CASE WHEN updated_at % 2 = 0 THEN 'new' ELSE value END AS value, CASE WHEN updated_at % 2 = 0 THEN updated_at + 1000000 ELSE updated_at END AS updated_at FROM ({_MEMORY})) ORDER BY updated_at DESC, mem_key LIMIT 2000")
def memory_written(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import memory as Y

    store = memory(spark, sf)
    new = store.where("updated_at % 2 = 0").withColumn("value", F.lit("new")).withColumn("updated_at", F.col("updated_at") + 1000000)
    refused = store.where("updated_at % 2 = 1").withColumn("value", F.lit(""))
    return Y.write(store, new.unionByName(refused)).select("mem_key", "value", "updated_at")


@query(f"SELECT mem_key, length(value) AS chars, updated_at, (SELECT count(*) FROM customer) AS total FROM ({_MEMORY}) ORDER BY updated_at DESC, mem_key LIMIT 25")
def memory_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The last 25 keys."""
    from ..operators import memory as Y

    return Y.listing(memory(spark, sf))


@query(f"SELECT count(*) AS entries, CAST(sum(length(value)) AS BIGINT) AS chars FROM ({_MEMORY})")
def memory_sizes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import memory as Y

    return Y.sizes(memory(spark, sf))


@query(f"SELECT doc_id, CASE WHEN p > o THEN 'Text ' || o || ' → ' || p || ' tokens (larger than the original).' WHEN o > 0 AND floor((o - p) / o * 100 + 0.5) > 0 THEN 'Text ' || o || ' → ' || p || ' tokens (' || CAST(floor((o - p) / o * 100 + 0.5) AS BIGINT) || '% saved).' ELSE 'Text ' || o || ' → ' || p || ' tokens.' END AS note FROM (SELECT doc_id, {tok('text')} AS o, {tok(_TWO)} AS p FROM documents)")
def savings_notes(spark: SparkSession, sf: str) -> DataFrame:
    m = M.savings(M.tokens(F.col("text")), M.tokens(S.first_lines(F.col("text"), 2)))
    return read(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", M.savings_note(F.col("m"), "Text").alias("note"))


@query("SELECT p_partkey, regexp_replace(p_name || '.*+?^${}()|[x]' || chr(92), '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM part")
def escaped_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", T.escape_regex(F.concat("p_name", F.lit(".*+?^${}()|[x]\\"))).alias("escaped"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:script|style)\\b')) AS assets, len(regexp_extract_all(html, '(?i)<a\\b')) AS links FROM pages")
def page_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts and styles found by the HTML scanner, and links by pattern."""
    from ..functions.scanners import signature

    d = read(spark, sf, "pages").select("page_id", F.size(signature(F.col("html"), F.lit("html"))["imports"]).cast("long").alias("assets"), F.regexp_count("html", F.lit(r"(?i)<a\b")).cast("long").alias("links"))
    return d
