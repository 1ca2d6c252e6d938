"""The stores as tables: open, save, and the JSON file that a store may begin from or be kept in."""

from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

log = logging.getLogger("loomlight")
CACHE = "file_path string, hash string, content string, tokens long, original_tokens long, type string, hit_count long, updated_at long"
MEMORY = "mem_key string, value string, updated_at long"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def open_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last version of a store's table; an empty frame, which isn't saved, where there is none that can be read."""
    empty = spark.createDataFrame([], schema)
    try:
        fs, at = _fs(spark, folder)
        versions = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("v-")) if fs.exists(at) else []
        done = [v for v in versions if fs.exists(_fs(spark, f"{v}/_SUCCESS")[1])]
        return spark.read.schema(empty.schema).parquet(done[-1]) if done else empty
    except (AnalysisException, OSError) as e:
        log.warning("the store %s can't be opened, it is kept in memory: %s", folder, e)
        return empty


def save_store(store: DataFrame, folder: str, now_ms: int) -> DataFrame:
    """Write a store as its next version and remove those before the last one, which readers may still use."""
    path = f"{folder.rstrip('/')}/v-{now_ms:020d}-{uuid.uuid4().hex[:8]}"
    store.write.parquet(path)
    fs, at = _fs(store.sparkSession, folder)
    versions = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("v-"))
    for old in versions[:-2]:
        fs.delete(_fs(store.sparkSession, old)[1], True)
    return store.sparkSession.read.schema(store.schema).parquet(path)


def read_json(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """(mem_key, value, updated_at) of a JSON object of strings; anything else has no rows."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("mem_key", "value"))
    return d.where("value IS NOT NULL").withColumn("updated_at", F.lit(now_ms).cast("long"))


def write_json(store: DataFrame, path: str) -> None:
    """A memory store as one JSON object of strings; its row cap bounds it."""
    one = store.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mem_key", "value"))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def migrate(store: DataFrame, path: str, now_ms: int) -> DataFrame:
    """A store with the rows of a JSON file, taken over once: only if the store is empty; the file is renamed then."""
    spark = store.sparkSession
    fs, at = _fs(spark, path)
    if not store.isEmpty() or not fs.exists(at):
        return store
    rows = cut(read_json(spark, path, now_ms).select(*store.columns), "migrated")  # a table before its file goes
    fs.rename(at, _fs(spark, f"{path}.migrated")[1])
    return rows
