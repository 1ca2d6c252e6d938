"""URL filters by a temporal list join.

A list is a history of dated entries: on a date a key (a domain, or a host with a path prefix) is blocked, allowed or
removed. The entries of a key become validity intervals, each ending where the next begins. A capture offers its keys
(every domain suffix of its host, every path prefix), which are joined to the entries active when it was fetched: an
as-of join by equality of the key and containment in the interval. Of the active entries the most specific decides.

A list of at most BROADCAST rows, counted first, is broadcast. A longer one is shuffled; since a key may belong to a
third of all captures, captures are salted over SALTS parts and the list's rows are repeated as often.

Defined cases: null urls and fetch times match nothing and are kept; captures without id are judged like any other; entries with a null key, date or action are
ignored; of entries of one key and date the last by action counts; repeated captures are judged alike; extra columns
are ignored; empty tables give no rows, an empty list keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BROADCAST, SALTS = 100_000, 32
# The list of the registered query: (date, action, key).
ENTRIES = [
    ("2024-01-01", "block", "adult-x.example.net"),
    ("2024-01-01", "block", "cheap-pills.example.com"),
    ("2024-02-01", "block", "ads-track.example.org"),
    ("2024-03-01", "block", "tionsh.example.net/de"),
    ("2024-05-01", "remove", "tionsh.example.net/de"),
    ("2024-05-15", "block", "example.org"),
    ("2024-06-01", "allow", "blog.thertion.example.org"),
    ("2024-07-01", "remove", "example.org"),
    ("2024-09-01", "block", "tionsh.example.net/de"),
    ("2024-10-01", "remove", "cheap-pills.example.com"),
]


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of entries(key, action, since); until is exclusive, null while open."""
    sound = entries.where("key IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL").groupBy(F.lower("key").alias("key"), "since").agg(F.max("action").alias("action"))
    return sound.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since"))).where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(id, url, fetched): id, url, fetched, key and action of the deciding entry (null if none), kept."""
    c = captures.select("id", "url", "fetched")
    rows = c.withColumn("host", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))).withColumn("path", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    domains = F.expr("get(transform(array(split(host, '[.]')), p -> transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p)), '.'))), 0)")
    prefixes = F.expr("get(transform(array(filter(split(path, '/'), s -> s <> '')), p -> transform(sequence(1, greatest(size(p), 1)), i -> concat(host, '/', array_join(slice(p, 1, i), '/')))), 0)")
    keyed = rows.where("host <> '' AND fetched IS NOT NULL").select("id", "url", "fetched", F.explode(F.array_distinct(F.concat(domains, prefixes))).alias("key"))
    active = intervals(entries)
    during = "since <= fetched AND (until IS NULL OR fetched < until)"
    if active.limit(BROADCAST + 1).count() <= BROADCAST:
        hits = keyed.join(F.broadcast(active), "key").where(during)
    else:
        salted = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).where(during)
    # the longest path prefix, then the longest domain
    best = hits.groupBy("id", "url", "fetched").agg(F.max(F.struct(F.instr("key", "/") > 0, F.length("key"), "key", "action")).alias("best")).select("id", "url", "fetched", "best.key", "best.action")
    c, b = c.alias("c"), best.alias("b")  # a capture without id is judged as well
    out = c.join(b, F.expr("c.id <=> b.id AND c.url = b.url AND c.fetched = b.fetched"), "left")
    return out.select("c.id", "c.url", "c.fetched", "b.key", "b.action", F.coalesce(F.col("b.action") != "block", F.lit(True)).alias("kept"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch times: page_id stands for the day of 2024 on which the page was fetched."""
    fetched = F.expr("date_add(date'2024-01-01', CAST(page_id % 366 AS INT))")
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", fetched.alias("fetched"))
    entries = spark.createDataFrame(ENTRIES, "since string, action string, key string").withColumn("since", F.col("since").cast("date"))
    return judge(captures, entries).select(F.col("id").alias("page_id"), "url", F.col("fetched").cast("string").alias("fetched"), F.col("key").alias("entry"), "action", "kept")


OP3_SQL = f"""
WITH list AS (SELECT DATE(d) AS since, a AS action, k AS key FROM (VALUES {", ".join(map(str, ENTRIES))}) v(d, a, k)),
active AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM list) WHERE action <> 'remove'),
p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hit AS (SELECT p.*, a.key, a.action, row_number() OVER (PARTITION BY page_id ORDER BY contains(a.key, '/') DESC, length(a.key) DESC) AS n
  FROM p JOIN active a ON a.since <= fetched AND (a.until IS NULL OR fetched < a.until)
  AND (host = a.key OR ends_with(host, '.' || a.key) OR starts_with(host || rtrim(path, '/') || '/', a.key || '/') AND contains(a.key, '/')))
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, h.key AS entry, h.action, coalesce(h.action <> 'block', true) AS kept
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.n = 1
"""
