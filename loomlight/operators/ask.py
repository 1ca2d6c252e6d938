"""Questions to a symbol graph and a report, each answered by one row of text with its savings.

Only what is shown is gathered: at most SHOWN matches, FILES_SHOWN files, and PER_DEPTH names a depth; numbers are
aggregates over all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..sources import report as P
from . import graph as G

SYMBOL_KINDS = ["search", "file_symbols", "depends_on", "dependents", "stats"]
REPORT_KINDS = ["report_hubs", "report_map", "report_search"]


def _joined(rows: DataFrame, order: Column, line: Column, sep: str = "\n") -> DataFrame:
    """One row, text: the lines of a few rows in order; empty without rows."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.agg(F.array_join(listed, sep).alias("text"))


def _search(nodes: DataFrame, query: str) -> DataFrame:
    """(text, n): the first SHOWN matches, and the number of all."""
    hits = G.search(nodes, query)
    first = hits.limit(G.SHOWN)
    shown = _joined(first, F.struct("file", "ord", "key"), F.concat("kind", F.lit(": "), "name", F.lit(" — "), "file"))
    total = nodes.agg(F.count_if(G.matches(query)).alias("n"))
    head = F.concat(F.lit(f'// Search results for "{query}" ('), F.col("n").cast("string"), F.lit(" matches)\n\n"))
    more = F.when(F.col("n") > G.SHOWN, F.concat(F.lit("\n... and "), (F.col("n") - G.SHOWN).cast("string"), F.lit(" more results"))).otherwise(F.lit(""))
    none = F.lit(f'No symbols matching "{query}".')
    return shown.crossJoin(total).select(F.when(F.col("n") > 0, F.concat(head, "text", more)).otherwise(none).alias("text"), "n")  # one row each


def _file_symbols(nodes: DataFrame, query: str) -> DataFrame:
    """(text, n): the symbols of the first FILES_SHOWN files that match, and the number of those of all."""
    every = G.file_symbols(nodes, query)
    total = every.agg(F.count("*").alias("n"))
    first = every.select("file").distinct().orderBy("file").limit(G.FILES_SHOWN)
    some = every.join(F.broadcast(first), "file").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", F.concat(F.lit("  "), "kind", F.lit(": "), "name").alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    shown = _joined(some, F.col("file"), F.concat(F.lit("// "), "file", F.lit("\n"), "lines", F.lit("\n")))
    return shown.crossJoin(total).select(F.when(F.col("n") > 0, F.col("text")).otherwise(f'No files matching "{query}".').alias("text"), "n")


def _traversal(nodes: DataFrame, edges: DataFrame, query: str, incoming: bool) -> DataFrame:
    """(text, n): what the first SEEDS matches reach, by depth, and how much that is."""
    seeds = G.search(nodes, query).limit(G.SEEDS).select("key")
    found = G.traverse(edges, seeds, incoming=incoming)
    total = found.agg(F.count("*").alias("n"))
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n... and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    line = F.concat(F.lit("Depth "), F.col("depth").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit("):\n"), F.coalesce("listed", F.lit("")), more)
    title = f'// {"Dependents" if incoming else "Dependencies"} of "{query}"\n\n'
    shown = _joined(G.by_depth(found, nodes), F.col("depth"), line)
    return shown.crossJoin(total).select(F.when(F.col("n") > 0, F.concat(F.lit(title), "text")).otherwise(f'No symbols matching "{query}".').alias("text"), "n")


def _stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = G.statistics(nodes, edges)
    rows = [("Files", "files"), ("Nodes", "nodes"), ("Functions", "functions"), ("Classes", "classes"), ("Exports", "exports"), ("Edges", "edges"), ("Import edges", "import_edges"), ("Tokens of all files", "naive_tokens")]
    return s.select(F.concat_ws("\n", *[F.concat(F.lit(f"{t}: "), F.col(c).cast("string")) for t, c in rows]).alias("text"), F.col("nodes").alias("n"))


def ask(nodes: DataFrame, edges: DataFrame, query: str, kind: str = "search", report: str | None = None, head: str | None = None) -> DataFrame:
    """One row: query, kind, result, nodes_traversed, tokens before and after, savings, source, note.

    report: the text of a report; it answers the report's kinds, and a search that no symbol matches falls back to it.
    head: the current commit, from which a stale report is told.
    """
    spark = nodes.sparkSession
    text = F.lit(report).cast("string")
    if kind in REPORT_KINDS:
        made = {"report_hubs": P.hubs_view, "report_map": P.map_view, "report_search": lambda t: P.search_view(t, query)}[kind](text)
        d = spark.range(1).select(F.coalesce(made, F.lit("No report.")).alias("result"), F.lit(0 if report is None else 1).cast("long").alias("n"), F.coalesce(P.report_tokens(text), F.lit(0)).alias("original_tokens"), F.lit("report").alias("source"))
    elif kind in SYMBOL_KINDS:
        d = {"search": lambda: _search(nodes, query), "file_symbols": lambda: _file_symbols(nodes, query), "depends_on": lambda: _traversal(nodes, edges, query, False), "dependents": lambda: _traversal(nodes, edges, query, True), "stats": lambda: _stats(nodes, edges)}[kind]()
        naive = nodes.agg((F.count_if(F.col("kind") == "module") * M.FILE_TOKENS).alias("original_tokens"))
        back = (F.col("n") == 0) & F.lit(kind == "search" and report is not None)
        also = F.concat("text", F.lit("\n\n--- from the report ---\n"), P.search_view(text, query))
        hit = F.size(P.found(text, query)) > 0
        d = d.crossJoin(naive).select(F.when(back, also).otherwise(F.col("text")).alias("result"), F.when(back & hit, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"), "original_tokens", F.when(back, "symbol+report").otherwise("symbol").alias("source"))
    else:
        raise ValueError(f"unknown kind {kind}; known are {', '.join(SYMBOL_KINDS + REPORT_KINDS)}")
    m = M.savings(F.col("original_tokens"), M.tokens(F.col("result")))
    d = d.withColumn("m", m)
    said = F.concat(F.lit("Traversed "), F.col("n").cast("string"), F.lit(" node(s)."))
    detail = F.concat_ws(" ", said, M.savings_note(F.col("m"), "Answer:"), P.stale_warning(text, F.lit(head).cast("string")))
    return d.select(F.lit(query).alias("query"), F.lit(kind).alias("kind"), "result", F.col("n").alias("nodes_traversed"), "m.*", "source", detail.alias("note"))
