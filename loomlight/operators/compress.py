"""Views of files and of JSON texts with their savings: the drivers behind every compressed answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontable as J
from ..functions import metrics as M
from ..functions import signatures as S
from ..functions import text as T
from ..functions.scanners import signature
from ..sources.shared import cut, settled, shuffled
from .keyed import KeptCache

DEPTHS = ["signature", "structure", "summary", "full"]
FORMATS = ["toon", "compact", "whitelist"]


def files(sources: DataFrame, depth: str = "signature", cache: DataFrame | None = None) -> DataFrame:
    """sources(path, content) at a depth: path, language, type, view, tokens before and after, savings, note.

    cache(file_path, hash, content, tokens, original_tokens, hit_count): a source whose hash is unchanged answers with
    the kept view and isn't scanned; its language is `cached`.
    """
    if depth not in DEPTHS:
        raise ValueError(f"unknown depth {depth}")
    d = sources.select("path", "content", T.language(F.col("path")).alias("language"), M.content_hash(F.col("content")).alias("hash"))
    hits = None
    if cache is not None:
        kept = cache.select(F.col("file_path").alias("path"), "hash", F.col("content").alias("kept"), "tokens", "original_tokens", "hit_count")
        hits = d.drop("content", "language").join(shuffled(kept), ["path", "hash"])
        d = d.join(shuffled(kept.select("path", "hash")), ["path", "hash"], "left_anti")
    structure = T.structure_only(F.col("language"), F.lit(depth))
    d = d.withColumn("sig", signature(F.col("content"), T.grammar(F.col("path"), F.col("content"))))
    d = d.select("path", "language", F.when(structure, "structure").otherwise(depth).alias("type"), "content", S.view(F.col("content"), F.col("language"), depth, F.col("sig")).alias("view"))
    d = d.select("path", "language", "type", "view", M.savings(M.tokens(F.col("content")), M.tokens(F.col("view"))).alias("m"))
    note = M.savings_note(F.col("m"), "Compressed:")
    d = d.select("path", "language", "type", "view", "m.*", note.alias("note"))
    if hits is None:
        return d
    saved = F.col("original_tokens") - F.col("tokens")
    number = F.concat(F.lit("Cache hit #"), (F.col("hit_count") + 1).cast("string"))
    said = F.when(saved > 0, F.concat(number, F.lit("; saved ~"), saved.cast("string"), F.lit(" tokens."))).otherwise(F.concat(number, F.lit("; the kept view is not smaller than the file.")))
    hits = hits.select("path", F.lit("cached").alias("language"), F.lit(depth).alias("type"), F.col("kept").alias("view"), M.savings(F.col("original_tokens"), F.col("tokens")).alias("m"), F.concat(F.lit("Unchanged (hash "), F.col("hash"), F.lit("). "), said).alias("note"))
    return d.unionByName(hits.select("path", "language", "type", "view", "m.*", "note"))


def served(store: KeptCache, sources: DataFrame, depth: str, now_ms: int) -> DataFrame:
    """`files` through a kept cache: hits are counted, stale entries go, and the views just made are stored.

    Only buckets of the sources' paths are read and rewritten. Of sources that repeat a path the cache stores one.
    """
    seen = cut(sources.select(F.col("path").alias("file_path"), M.content_hash(F.col("content")).alias("hash")), "served-seen")
    made = cut(files(sources, depth, cache=store.lookup(seen)), "served-views")
    store.check(seen, now_ms)
    view = made.where("language <> 'cached'").join(shuffled(seen.withColumnRenamed("file_path", "path").dropDuplicates(["path"])), "path")
    store.store(view.select(F.col("path").alias("file_path"), "hash", F.col("view").alias("content"), F.col("optimized_tokens").alias("tokens"), "original_tokens", "type", F.lit(0).cast("long").alias("hit_count"), F.lit(now_ms).cast("long").alias("updated_at")))
    return made


def cleaned(texts: DataFrame, form: str = "toon", fields: list[str] | None = None, max_items: int = J.MAX_ITEMS) -> DataFrame:
    """texts(id, data), JSON, in a form: id, original (a preview), cleaned, format, tokens before and after, savings, note.

    What isn't JSON comes back whole, with format passthrough; savings may be below zero.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    data = F.col("data")
    sound = F.try_parse_json("data").isNotNull()
    whitelisted = F.when(J.items(data).isNotNull(), J.whitelist(J.items(data), fields or [], max_items)).otherwise(J.compact(F.to_json(J.select_fields(data, fields or []))))
    made: dict[str, Column] = {"toon": J.toon(data, max_items), "compact": J.compact(data), "whitelist": whitelisted}
    d = settled(texts.select("id", "data"), sound=sound)
    d = settled(d, cleaned=F.when(F.col("sound"), made[form]).otherwise(data))
    d = d.withColumns({"original_tokens": M.tokens(data), "optimized_tokens": M.tokens(F.col("cleaned"))})
    percent = M.percent_saved(F.col("original_tokens"), F.col("optimized_tokens"))
    arrow = F.concat(F.col("original_tokens").cast("string"), F.lit(" → "), F.col("optimized_tokens").cast("string"), F.lit(" tokens ("), percent.cast("string"), F.lit("% saved)."))
    note = F.when(F.col("sound"), F.concat(F.lit(f"JSON in the {form} form. "), arrow)).otherwise(F.lit("Not valid JSON, returned as it is."))
    return d.select("id", F.when(F.col("sound"), M.preview(data)).otherwise(data).alias("original"), "cleaned", F.when(F.col("sound"), form).otherwise("passthrough").alias("format"), "original_tokens", "optimized_tokens", percent.alias("savings_percent"), note.alias("note"))
