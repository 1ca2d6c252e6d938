"""Compression of tool catalogs: one line a tool, token costs, and responses of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontable as J
from ..functions import metrics as M
from ..functions import text as T

EXTRA_TOKENS = 10


def compressed(tools: DataFrame, per_server: int | None = None) -> DataFrame:
    """tools(server, name, description, input_schema, ord): server, name, summary, params, tokens of either form."""
    if per_server is not None:
        tools = tools.withColumn("_rank", F.row_number().over(Window.partitionBy("server").orderBy("ord", "name"))).where(F.col("_rank") <= per_server)
    whole = M.tokens(F.col("name")) + M.tokens(F.coalesce("description", F.lit(""))) + M.tokens(F.coalesce("input_schema", F.lit(""))) + EXTRA_TOKENS
    d = tools.select("server", "name", T.abbreviate(F.col("description")).alias("summary"), J.parameters(F.col("input_schema")).alias("params"), whole.alias("original_tokens"))
    return d.withColumn("optimized_tokens", M.tokens(F.concat_ws(" ", "name", "summary", "params")))


def by_server(servers: DataFrame, tools: DataFrame) -> DataFrame:
    """Enabled servers with the number of their tools."""
    counted = tools.groupBy("server").agg(F.count("*").alias("tools"))
    return servers.where(~F.coalesce("disabled", F.lit(False))).join(counted, "server", "left").select("server", F.coalesce("tools", F.lit(0)).alias("tools"))


def responses(calls: DataFrame) -> DataFrame:
    """calls(id, blocks ARRAY<STRUCT<type, text>>): joined text blocks, as a table where they are JSON; the rest counted.

    format: toon, raw-nonjson where the text isn't JSON, raw-fallback where the table would be larger.
    """
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    other = F.size(F.filter("blocks", lambda b: b["type"] != "text"))
    d = calls.select("id", text.alias("raw"), other.cast("long").alias("other_blocks"))
    d = d.withColumn("table", F.when(T.looks_like_json(F.col("raw")) & F.try_parse_json("raw").isNotNull(), J.toon(F.col("raw"))))
    d = d.withColumn("original_tokens", M.tokens(F.col("raw"))).withColumn("table_tokens", M.tokens(F.col("table")))
    kind = F.when(F.col("table").isNull(), "raw-nonjson").when(F.col("table_tokens") > F.col("original_tokens"), "raw-fallback").otherwise("toon")
    return d.withColumn("format", kind).select("id", "format", F.when(kind == "toon", F.col("table")).otherwise(F.col("raw")).alias("content"), "original_tokens", F.when(kind == "toon", F.col("table_tokens")).otherwise(F.col("original_tokens")).alias("optimized_tokens"), "other_blocks")


def cost(catalog: DataFrame) -> DataFrame:
    """One row for a compressed catalog: tools, tokens of the whole schemas, tokens of the compressed rows as JSON, savings of 0 at least."""
    row = M.tokens(F.to_json(F.struct("server", "name", "summary", "params")))
    d = catalog.agg(F.count("*").alias("tools"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum(row), F.lit(0)).alias("optimized_tokens"))
    return d.withColumn("savings_percent", M.clamped_percent(F.col("original_tokens"), F.col("optimized_tokens")))


def described(wanted: DataFrame, tools: DataFrame) -> DataFrame:
    """wanted(server, tool): the whole description and schema of each, and its tokens; what isn't there has an error.

    The error names the tools that the server has, a list that the catalog's size bounds.
    """
    have = tools.groupBy("server").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    whole = tools.select("server", F.col("name").alias("tool"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("input_schema", F.lit("{}")).alias("input_schema"), F.lit(True).alias("there"))
    d = wanted.select("server", "tool").join(whole, ["server", "tool"], "left").join(have, "server", "left")
    error = F.concat(F.lit("tool "), "tool", F.lit(" not found on "), "server", F.lit("; available: "), F.coalesce("names", F.lit("none")))
    payload = F.to_json(F.struct("server", F.col("tool").alias("name"), "description", "input_schema"))
    return d.select("server", "tool", "description", "input_schema", F.when(F.col("there"), M.tokens(payload)).alias("tokens"), F.when(F.col("there").isNull(), error).alias("error"))


def status(connections: DataFrame, now_ms: int) -> DataFrame:
    """connections(server, connected_at, tools): how long each is open, and the tools it is known to have."""
    return connections.select("server", M.seconds_since(F.col("connected_at"), F.lit(now_ms)).alias("connected_seconds"), F.coalesce("tools", F.lit(0)).alias("tools"))


def refresh(kept: DataFrame, listed: DataFrame, servers: DataFrame) -> DataFrame:
    """The kept catalog with the tools of servers(server) replaced by those just listed; a server that lists none keeps none."""
    return kept.join(servers.select("server"), "server", "left_anti").unionByName(listed.join(servers.select("server"), "server", "left_semi"))
