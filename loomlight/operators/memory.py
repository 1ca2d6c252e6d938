"""The key-value memory store as a table memory(mem_key, value, updated_at): every action returns the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cache

SHOWN = 25


def write(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store new(mem_key, value, updated_at); empty values are refused; then the caps, least recently written first."""
    kept = cache.upsert(store, new.where("value <> ''"), "mem_key")
    rows = kept.withColumnRenamed("value", "content")
    return cache.keep_chars(cache.keep_newest(rows, cache.MEMORY_ROWS, "mem_key"), cache.MEMORY_CHARS, "mem_key", cache.MEMORY_BATCH).withColumnRenamed("content", "value")


def read(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("mem_key") == key)


def forget(store: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.delete(store, keys, "mem_key")


def listing(store: DataFrame) -> DataFrame:
    """The keys written last, with the number of all."""
    n = store.agg(F.count("*").alias("total"))  # one row
    return cache.listing(store, SHOWN, "mem_key").select("mem_key", F.length("value").cast("long").alias("chars"), "updated_at").crossJoin(n)


def sizes(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars"))


def clear(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cache.clear(store)


def act(store: DataFrame, action: str, key: str = "", value: str | None = None, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the next store, one row: action, key, value, entries, note) of one action; what can't be done says so in its note."""
    spark = store.sparkSession

    def said(after: DataFrame, note: Column | str, shown: Column | str | None = None, of: str = key) -> DataFrame:
        note = F.lit(note) if isinstance(note, str) else note
        shown = F.lit(shown).cast("string") if shown is None or isinstance(shown, str) else shown
        return sizes(after).select(F.lit(action).alias("action"), F.lit(of).alias("key"), shown.alias("value"), "entries", note.alias("note"))

    if action == "read":
        found = read(store, key).agg(F.max("value").alias("found"))  # a key has one row
        length = F.concat(F.lit(f'Found "{key}" ('), F.length("found").cast("string"), F.lit(" chars)."))
        row = sizes(store).crossJoin(found)
        return store, row.select(F.lit(action).alias("action"), F.lit(key).alias("key"), F.col("found").alias("value"), "entries", F.when(F.col("found").isNull(), f'Key "{key}" not found.').otherwise(length).alias("note"))
    if action == "write":
        if not value:
            return store, said(store, "Error: a value is required.")
        after = write(store, spark.createDataFrame([(key, value, now_ms)], "mem_key string, value string, updated_at long"))
        return after, said(after, f'Stored "{key}" ({len(value)} chars).', value)
    if action == "delete":
        after = forget(store, spark.createDataFrame([(key,)], "mem_key string"))
        there = not read(store, key).isEmpty()
        return after, said(after, f'Deleted "{key}".' if there else f'Key "{key}" not found. Nothing deleted.')
    if action == "list":
        rows = listing(store)
        lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("updated_at")).alias("o"), "mem_key", F.concat("mem_key", F.lit(": "), F.col("chars").cast("string"), F.lit(" chars")).alias("line")))), lambda x: x["line"])
        shown = rows.agg(F.array_join(lines, "\n").alias("text"))
        n = F.col("entries")
        more = F.when(n > SHOWN, F.concat(F.lit("\n... +"), (n - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
        text = F.when(n == 0, "(empty)").otherwise(F.concat("text", more))
        return store, sizes(store).crossJoin(shown).select(F.lit(action).alias("action"), F.lit("*").alias("key"), text.alias("value"), "entries", F.concat(n.cast("string"), F.lit(" entries.")).alias("note"))
    if action == "clear":
        after, removed = clear(store)
        return after, removed.select(F.lit(action).alias("action"), F.lit("*").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("entries"), F.concat(F.lit("Cleared "), F.col("removed").cast("string"), F.lit(" entries.")).alias("note"))
    return store, said(store, f'Unknown action "{action}". Known are read, write, delete, list, clear.')
