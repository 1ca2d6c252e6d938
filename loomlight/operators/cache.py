"""The content-hash cache and the key-value memory store: replay of traces, upsert, caps and statistics.

A trace is a table of checks and stores in time. Replay needs no state kept by a process: stores open epochs of their
path, a check hits while its hash is the epoch's and none before it differed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..sources.shared import cut, shuffled

# Caps of the two stores in rows and in characters, and how many rows a byte eviction takes at once.
CACHE_ROWS, CACHE_CHARS, CACHE_BATCH, MAX_BATCHES = 10_000, 500 * 1024 * 1024, 200, 100
MEMORY_ROWS, MEMORY_CHARS, MEMORY_BATCH = 2_000, 10 * 1024 * 1024, 100
#: Rows up to which the newest are found by a top-k, which one task holds.
TOP = 1 << 16


def _played(trace: DataFrame, by: list[str]) -> DataFrame:
    """The replay of each group of rows on its own, going on from the state in its columns in_hash, in_dead and in_hits.

    in_dead: null where nothing was stored before. Adds epoch, stored, differs, dead, status and hits; epoch starts at 0.
    """
    rows = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = trace.withColumn("epoch", F.sum((F.col("action") == "store").cast("long")).over(rows))
    inside = Window.partitionBy(*by, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("epoch") == 0
    own = F.first(F.when(F.col("action") == "store", F.col("hash")), ignorenulls=True).over(inside)
    d = d.withColumn("stored", F.when(first, F.col("in_hash")).otherwise(own))
    differs = (F.col("action") == "check") & (F.col("hash") != F.col("stored"))
    d = d.withColumn("differs", F.coalesce(differs, F.lit(False)).cast("int"))
    dead = F.greatest(F.coalesce(F.max("differs").over(before), F.lit(0)), F.when(first, F.coalesce("in_dead", F.lit(1))).otherwise(0))
    d = d.withColumn("dead", dead)
    status = F.when(F.col("action") == "store", "stored").when(F.col("dead") == 1, "miss").when(F.col("differs") == 1, "update").otherwise("hit")
    d = d.withColumn("status", status)
    return d.withColumn("hits", F.sum((F.col("status") == "hit").cast("long")).over(inside) + F.when(first, F.coalesce("in_hits", F.lit(0))).otherwise(0))


_FRESH = {"in_hash": "string", "in_dead": "int", "in_hits": "long"}


def summaries(segments: DataFrame) -> DataFrame:
    """One row for each (path, part) of segments(path, part, seq, action, hash): what it does to the state it meets.

    stores: its number of stores; with any, out_hash, out_dead and out_hits are the state that it leaves, whatever it
    met. Without one the state it meets goes on: checks are all its checks, v the first hash checked, before those
    checks ahead of v, like those ahead of the first check of another hash than v, mixed whether there is one.
    """
    d = _played(segments.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _FRESH.items()]), ["path", "part"])
    rows = Window.partitionBy("path", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.col("epoch") == 0
    d = d.withColumn("at", F.row_number().over(rows)).withColumn("v", F.first(F.when(lead, F.col("hash")), ignorenulls=True).over(rows))
    last = lambda c: F.max_by(c, "at")
    d = d.groupBy("path", "part").agg(
        F.max("epoch").alias("stores"),
        last("stored").alias("out_hash"),
        last("dead").alias("dead"),
        last("differs").alias("differs"),
        last("hits").alias("out_hits"),
        F.count_if(lead).alias("checks"),
        last("v").alias("v"),
        F.min(F.when(lead & F.col("v").isNotNull(), F.col("at"))).alias("first_at"),
        F.min(F.when(lead & (F.col("hash") != F.col("v")), F.col("at"))).alias("other_at"),
    )
    before, like = F.coalesce(F.col("first_at") - 1, F.col("checks")), F.coalesce(F.col("other_at") - 1, F.col("checks"))
    return d.select("path", "part", "stores", "out_hash", F.greatest("dead", "differs").alias("out_dead"), "out_hits", "checks", "v", before.alias("before"), like.alias("like"), F.col("other_at").isNotNull().alias("mixed"))


def composed(summary: DataFrame) -> DataFrame:
    """(path, part, epochs, in_hash, in_dead, in_hits): the state that each part of a path meets, from all before it.

    Only summaries are put in order, a row a part.
    """
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = F.when(F.col("stores") > 0, F.struct("out_hash", "out_dead", "out_hits"))
    d = summary.select("*", F.last(left, ignorenulls=True).over(earlier).alias("base"), F.coalesce(F.sum("stores").over(earlier), F.lit(0)).alias("epochs"))
    # parts of one group meet what one and the same store has left: those after it, the next one with a store included
    h, v = F.col("base.out_hash"), F.col("v")
    d = d.withColumn("turns", (F.col("stores") == 0) & h.isNotNull() & v.isNotNull() & ((h != v) | F.col("mixed")))
    adds = F.when(h.isNull() | v.isNull(), F.col("checks")).when(h != v, F.col("before")).otherwise(F.col("like"))
    group = Window.partitionBy("path", "epochs").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("in_dead", F.when(F.col("base").isNotNull(), F.greatest(F.col("base.out_dead"), F.coalesce(F.max(F.col("turns").cast("int")).over(group), F.lit(0)))))
    d = d.withColumn("adds", F.when(F.col("in_dead") == 0, adds).otherwise(0))
    return d.select("path", "part", "epochs", h.alias("in_hash"), "in_dead", (F.col("base.out_hits") + F.coalesce(F.sum("adds").over(group), F.lit(0))).alias("in_hits"))


def replay(trace: DataFrame, parts: int | None = None) -> DataFrame:
    """trace(seq, action, path, hash), action store or check, plus (epoch, status, hits) of each row.

    status: stored; hit while the stored hash is unchanged; update at the first check that differs; miss otherwise.
    hits: the running number of hits in the epoch. A null hash differs from none. seq is unique within a path.

    The trace is cut by (path, seq) into ranges of like size, so a path with most of all rows is spread over many of
    them. What a segment (a path's rows in a range) does to the state it meets is summed up in one row; those of paths
    with several segments, two a range at most besides whole ranges, are composed in order; then every segment is
    replayed from the state that it meets. No task orders more than a range.
    """
    spark = trace.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = cut(trace.repartitionByRange(parts, "path", "seq").withColumn("part", F.spark_partition_id()), "cache-trace")
    spans = d.groupBy("path").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("path")
    states = cut(composed(summaries(d.join(cut(spans, "cache-spans"), "path", "left_semi").select("path", "part", "seq", "action", "hash"))), "cache-states")
    out = _played(d.join(states, ["path", "part"], "left"), ["path", "part"])
    return out.select(*[c for c in trace.columns], (F.col("epoch") + F.coalesce("epochs", F.lit(0))).alias("epoch"), "status", "hits")


def upsert(entries: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """Entries with the newest row of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc("updated_at"), F.desc("_new"))
    both = entries.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_new")


def record_hits(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Entries with hits(file_path, n, at) added, and their time moved on."""
    h = hits.groupBy("file_path").agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    return entries.join(h, "file_path", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("n", F.lit(0))).withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", F.lit(0)))).drop("n", "at")


def delete(entries: DataFrame, keys: DataFrame, key: str = "file_path") -> DataFrame:
    return entries.join(keys.select(key), key, "left_anti")


def statistics(entries: DataFrame) -> DataFrame:
    """One row: entries, total_hits, tokens_saved."""
    saved = F.col("hit_count") * F.greatest(F.lit(0), F.col("original_tokens") - F.col("tokens"))
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"), F.coalesce(F.sum(saved), F.lit(0)).alias("tokens_saved"))


def _placed(entries: DataFrame, key: str) -> DataFrame:
    """(at, key, n) of each entry: all that caps move. Entries without a time are the oldest."""
    return entries.select(F.coalesce(F.col("updated_at").cast("long"), F.lit(-(1 << 63))).alias("at"), F.col(key).alias("key"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n"))


def _newer(entries: DataFrame, key: str, last: Row, also: bool = False) -> DataFrame:
    """Entries newer than the row `last` (or that one also), a filter; of equal times the smaller key is newer."""
    at = F.coalesce(F.col("updated_at").cast("long"), F.lit(-(1 << 63)))
    beyond = F.col(key) <= last.key if also else F.col(key) < last.key
    return entries.where((at > last.at) | ((at == last.at) & beyond))


def _ranged(entries: DataFrame, key: str) -> tuple[DataFrame, list[Row]]:
    """Times, keys and lengths cut into ranges of time, oldest first, and a row a range: part, rows, chars."""
    ranged = cut(_placed(entries, key).repartitionByRange(F.col("at"), F.desc("key")).withColumn("part", F.spark_partition_id()), "cache-ranges")
    return ranged, ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).orderBy("part").collect()


def _numbered(ranged: DataFrame, part: int) -> DataFrame:
    """The rows of one range in order, with their rank in it and the characters up to there."""
    ordered = Window.partitionBy("part").orderBy(F.col("at"), F.desc("key"))
    return ranged.where(F.col("part") == part).select("*", F.row_number().over(ordered).alias("rank"), F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sum"))


def _without_oldest(entries: DataFrame, key: str, gone: int, ranged: DataFrame, ranges: list[Row]) -> DataFrame:
    """Entries but the `gone` oldest: a filter, for which the one range that holds the last of these is put in order."""
    if gone <= 0:
        return entries
    for r in ranges:
        if gone <= r.rows:
            return _newer(entries, key, _numbered(ranged, r.part).where(F.col("rank") == gone).first())
        gone -= r.rows
    return entries.limit(0)


def keep_newest(entries: DataFrame, rows: int, key: str = "file_path") -> DataFrame:
    """At most `rows` rows, the last written; keys are unique.

    A top-k over times and keys alone finds the oldest row that stays, then a filter keeps the rest; contents don't move.
    More rows than a task should hold are found by ranges of time, as in keep_chars.
    """
    slim = entries.withColumn("content", F.lit(None).cast("string"))
    if rows <= 0:
        return entries.limit(0)
    if rows > TOP:
        ranged, ranges = _ranged(slim, key)
        return _without_oldest(entries, key, sum(r.rows for r in ranges) - rows, ranged, ranges)
    newest = _placed(slim, key).orderBy(F.desc("at"), "key").limit(rows)
    found = newest.agg(F.count("*").alias("n"), F.min("at").alias("at")).first()
    if found.n < rows:
        return entries
    last = newest.where(F.col("at") == found["at"]).agg(F.max("at").alias("at"), F.max("key").alias("key")).first()
    return _newer(entries, key, last, also=True)


def keep_chars(entries: DataFrame, chars: int, key: str = "file_path", batch: int = 1, batches: int | None = None) -> DataFrame:
    """Newest first while their characters stay within the cap; older rows go `batch` at a time, `batches` times at most.

    Times, keys and lengths are cut into ranges of time. A row a range tells how many rows and characters come before
    it (what the driver sees: as many rows as ranges), so one range holds the row with which enough is gone, and one the
    last row of its batch; only within these two is anything ordered. The caps then are a filter on the entries, whose
    contents don't move. Keys are unique.
    """
    ranged, ranges = _ranged(entries, key)
    over = sum(r.chars for r in ranges) - chars
    if over <= 0:
        return entries
    gone = length = 0
    for r in ranges:
        if length + r.chars >= over:
            gone += _numbered(ranged, r.part).where(F.col("sum") >= over - length).agg(F.min("rank")).first()[0]
            break
        gone, length = gone + r.rows, length + r.chars
    gone = -(-gone // batch) * batch
    return _without_oldest(entries, key, gone if batches is None else min(gone, batches * batch), ranged, ranges)


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after storing new rows: the newest row of each path, within the caps on rows and on characters."""
    return keep_chars(keep_newest(upsert(entries, new), CACHE_ROWS), CACHE_CHARS, batch=CACHE_BATCH, batches=MAX_BATCHES)


def clear(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(an empty cache, one row with the number of entries that it held)."""
    return entries.limit(0), entries.agg(F.count("*").alias("removed"))


def stub(path: Column, n: Column) -> Column:
    """What a client reads of an unchanged file instead of its text."""
    return F.concat(F.lit("[cached] "), path, F.lit(" unchanged. "), n.cast("string"), F.lit(" tokens."))


def checked(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """seen(file_path, hash): status hit, update or miss, the view of a hit, the stub's tokens, its savings, and a note."""
    e = entries.select("file_path", F.col("hash").alias("kept"), "content", "tokens", "original_tokens", F.col("hit_count") + 1)
    e = e.toDF("file_path", "kept", "content", "tokens", "original_tokens", "hits")
    d = seen.select("file_path", "hash").join(shuffled(e), "file_path", "left")
    hit = F.col("kept") == F.col("hash")
    status = F.when(F.col("kept").isNull(), "miss").when(hit, "hit").otherwise("update")
    stubbed = M.tokens(stub(F.col("file_path"), F.col("tokens")))
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("tokens"))
    percent = M.half_up((F.col("original_tokens") - stubbed) / F.greatest(F.col("original_tokens"), F.lit(1)) * 100)
    number = F.concat(F.lit("Cache hit #"), F.col("hits").cast("string"), F.lit(", unchanged (hash "), F.col("hash"), F.lit("). "))
    said = F.when(status == "miss", "Not in the cache.").when(status == "update", F.concat(F.lit("Changed (was "), F.col("kept"), F.lit(", is "), F.col("hash"), F.lit("); the entry is dropped.")))
    said = said.otherwise(F.concat(number, F.when(saved > 0, F.concat(F.lit("Saved ~"), saved.cast("string"), F.lit(" tokens."))).otherwise("The kept view is not smaller than the file.")))
    only = lambda c: F.when(hit, c)
    return d.select("file_path", "hash", status.alias("status"), only(F.col("content")).alias("content"), only(F.col("hits")).alias("hit_count"), only(stubbed).alias("stub_tokens"), only(percent).alias("savings_percent"), said.alias("note"))


def after_check(entries: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """The cache after checks of seen(file_path, hash): hits are counted, entries of changed files go."""
    return after_answers(entries, checked(entries, seen), now_ms)


def after_answers(entries: DataFrame, answers: DataFrame, now_ms: int) -> DataFrame:
    """The cache after answers(file_path, status) that were taken from it."""
    left = delete(entries, answers.where("status = 'update'").select("file_path"))
    return record_hits(left, answers.where("status = 'hit'").select("file_path", F.lit(1).alias("n"), F.lit(now_ms).alias("at")))


def as_client_rows(entries: DataFrame) -> DataFrame:
    """Entries under the names that clients know."""
    return entries.select(F.col("hash"), F.col("content"), F.col("tokens"), F.col("original_tokens").alias("originalTokens"), F.col("updated_at").alias("timestamp"), F.col("hit_count").alias("hitCount"), F.col("file_path").alias("filePath"), F.col("type"))


def lookup(entries: DataFrame, key: str, column: str = "file_path") -> DataFrame:
    """The row of one key, if there is one; the key reaches the scan."""
    return entries.where(F.col(column) == key)


def report(entries: DataFrame, backend: str = "table") -> DataFrame:
    """The statistics with a note."""
    said = F.concat(F.lit(f"{backend} cache: "), F.col("entries").cast("string"), F.lit(" entries, "), F.col("total_hits").cast("string"), F.lit(" hits, "), F.col("tokens_saved").cast("string"), F.lit(" tokens saved."))
    return statistics(entries).withColumn("note", said)


def listing(entries: DataFrame, n: int, key: str = "file_path") -> DataFrame:
    """The n rows written last."""
    return entries.orderBy(F.desc("updated_at"), key).limit(n)
