"""Queries over the stores kept in folders: each makes its store from a table, changes it, and reads what is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as C
from ..operators import compress as Z
from ..operators.keyed import CACHE, KeptCache, KeptMemory
from ..sources.shared import folder, shuffled
from . import code, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _new(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _typed(entries: DataFrame) -> DataFrame:
    """Entries with all columns of the cache; those that they lack are null."""
    spark = entries.sparkSession
    return spark.createDataFrame([], CACHE).unionByName(entries, allowMissingColumns=True)


@query(tables.ORACLE_SQL["cache_hits_recorded"])
def kept_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """An entry a document, put into a kept cache; then the hits of all events."""
    store = KeptCache(spark, _new(spark, "kept-cache"))
    store.upsert(_typed(tables.entries(spark, sf)))
    e = spark.read.parquet(f"{sf}/events.parquet")
    store.record_hits(e.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("file_path"), F.lit(1).alias("n"), F.col("event_id").alias("at")))
    return store.frame().select("file_path", "hit_count", "updated_at")


@query(f"SELECT file_path, content FROM (SELECT {', '.join(f'{c} AS {n}' for c, n in zip(tables._ORDER_ENTRIES, ('file_path', 'content', 'updated_at'), strict=True))} FROM orders) ORDER BY updated_at DESC, file_path LIMIT {C.CACHE_ROWS}")
def kept_cache_capped(spark: SparkSession, sf: str) -> DataFrame:
    """An entry an order, stored within the caps of the cache."""
    store = KeptCache(spark, _new(spark, "kept-cache"))
    store.store(_typed(tables._entries_of(spark, sf, "orders", tables._ORDER_ENTRIES)))
    return store.frame().select("file_path", "content")


_LATER = "SELECT k, path, content || CASE WHEN k % 3 = 0 THEN ' ' ELSE '' END AS content FROM ({0})"


@query(f"SELECT path, CASE WHEN k % 3 = 0 THEN 'made' ELSE 'cached' END AS came, CASE WHEN k % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS hit_count, substr(sha256(content), 1, 16) AS hash FROM ({_LATER.format(code.FILES.replace('STRING', 'VARCHAR'))})")
def served_views(spark: SparkSession, sf: str) -> DataFrame:
    """Every file served, a third of them changed, all served again: what came from the cache, and what the cache holds.

    No cap of the cache holds here, since every file is to be found again.
    """
    store = KeptCache(spark, _new(spark, "kept-cache"), rows=1 << 40, chars=1 << 60)
    files = code.files(spark, sf)
    Z.served(store, files.select("path", "content"), "signature", 1)
    later = files.selectExpr("path", "CASE WHEN k % 3 = 0 THEN content || ' ' ELSE content END AS content")
    came = Z.served(store, later, "signature", 2).select("path", F.when(F.col("language") == "cached", "cached").otherwise("made").alias("came"))
    return came.join(shuffled(store.frame().select(F.col("file_path").alias("path"), "hit_count", "hash")), "path")


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS mem_key, CASE WHEN n > 0 THEN 'orders: ' || CAST(n AS VARCHAR) ELSE c_mktsegment END AS value FROM (SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def kept_memory(spark: SparkSession, sf: str) -> DataFrame:
    """A key a customer, written over by the orders of those who have any; the customers of a region are forgotten."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("mem_key")
    store = KeptMemory(spark, _new(spark, "kept-memory"))
    store.upsert(read("customer").select(key("c_custkey"), F.col("c_mktsegment").alias("value"), F.lit(0).cast("long").alias("updated_at")))
    n = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("updated_at"))
    store.upsert(n.select(key("o_custkey"), F.concat(F.lit("orders: "), F.col("n").cast("string")).alias("value"), "updated_at"))
    away = read("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    store.delete(read("customer").join(away, "c_nationkey", "left_semi").select(key("c_custkey")))
    return store.frame().select("mem_key", "value")
