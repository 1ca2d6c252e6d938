"""Markdown graph reports: title, hubs, communities, summary, build and staleness, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.metrics import tokens
from ..functions.text import commits_match

# Patterns of a report.
TITLE = r"(?m)^#\s*Graph Report\s*-\s*(.+?)\s*\("
HUBS = r"(## God Nodes[\s\S]*?)(?=\n## |\n---|\z)"
HUB = r"(?m)^\d+\.\s*`([^`]+)`\s*-\s*(\d+)\s*edges?"
COMMUNITIES = r"(## Community Hubs[\s\S]*?)(?=\n## God|\n## Surprising|\z)"
SUMMARY = r"(## Summary[\s\S]*?)(?=\n## )"
COMMITS = [r"(?i)Built from commit:\s*`?([0-9a-f]{7,40})`?", r"(?i)commit[:\s]+`?([0-9a-f]{7,40})`?"]
DATE = r"(?m)^#\s*Graph Report[^)]*\(([^)]+)\)"
MAP_HUBS, MAP_COMMUNITIES, FOUND_HUBS, FOUND_COMMUNITIES, FOUND_SUMMARY = 15, 20, 15, 15, 10


def parsed(text: Column) -> Column:
    """struct(title, hubs, community_lines, summary)."""
    section = F.regexp_extract(text, HUBS, 1)
    names, edges = (F.regexp_extract_all(section, F.lit(HUB), F.lit(g)) for g in (1, 2))
    hubs = F.zip_with(names, edges, lambda n, e: F.struct(n.alias("name"), e.cast("int").alias("edges")))
    lines = F.filter(F.split(F.regexp_extract(text, COMMUNITIES, 1), "\n"), lambda x: F.contains(x, F.lit("Community")))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(text, TITLE, 1)), F.lit("")), F.lit("report"))
    return F.struct(title.alias("title"), hubs.alias("hubs"), F.transform(lines, lambda x: F.trim(x)).alias("community_lines"), F.trim(F.regexp_extract(text, SUMMARY, 1)).alias("summary"))


def built(text: Column) -> Column:
    """struct(commit, date) of the build that made the report."""
    commit = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in COMMITS])
    return F.struct(commit.alias("commit"), F.nullif(F.trim(F.regexp_extract(text, DATE, 1)), F.lit("")).alias("date"))


def stale(text: Column, head: Column) -> Column:
    """Whether the report was built from another commit; null where either isn't known."""
    return ~commits_match(built(text)["commit"], head)


def found(text: Column, query: str) -> Column:
    """Lines for a query: hubs and communities that contain it; the summary's lines only if neither does."""
    p, q = parsed(text), F.lower(F.lit(query))
    has = lambda x: F.contains(F.lower(x), q)
    hubs = F.transform(F.filter(p["hubs"], lambda h: has(h["name"])), lambda h: F.concat(h["name"], F.lit(" ("), h["edges"].cast("string"), F.lit(" edges)")))
    both = F.concat(F.slice(hubs, 1, FOUND_HUBS), F.slice(F.filter(p["community_lines"], has), 1, FOUND_COMMUNITIES))
    rest = F.slice(F.filter(F.split(p["summary"], "\n"), has), 1, FOUND_SUMMARY)
    return F.when(F.size(both) > 0, both).otherwise(rest)


def hubs_view(text: Column) -> Column:
    """The title and the first hubs, numbered."""
    p = parsed(text)
    listed = F.transform(F.slice(p["hubs"], 1, MAP_HUBS), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["name"], F.lit(" ("), h["edges"].cast("string"), F.lit(" edges)")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("// report: "), p["title"]), F.lit(""), F.lit("## Hubs (most connected)")), listed), "\n")


def map_view(text: Column) -> Column:
    """The title, the summary and the first community lines; says how many more there are. Empty lines are left out."""
    p = parsed(text)
    n = F.size(p["community_lines"])
    more = F.when(n > MAP_COMMUNITIES, F.concat(F.lit("// ... "), (n - MAP_COMMUNITIES).cast("string"), F.lit(" more, search for them"))).otherwise(F.lit(""))
    lines = F.concat(F.array(F.concat(F.lit("// report: "), p["title"]), p["summary"], F.lit("## Community hubs (first ones)")), F.slice(p["community_lines"], 1, MAP_COMMUNITIES), F.array(more))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def search_view(text: Column, query: str) -> Column:
    """Lines for a query under a heading; the map where the query is blank; a note where nothing matches."""
    if not query.strip():
        return map_view(text)
    lines = found(text, query.strip())
    body = F.when(F.size(lines) > 0, F.transform(lines, lambda x: F.concat(F.lit("  "), x))).otherwise(F.array(F.lit("  no hub, community or summary line matches")))
    return F.array_join(F.concat(F.array(F.lit(f'// report search: "{query}"'), F.lit("")), body), "\n")


def stale_warning(text: Column, head: Column) -> Column:
    """What to say of a report that was built from another commit; null where it is current or either isn't known."""
    seven = lambda c: F.substring(c, 1, 7)
    return F.when(stale(text, head), F.concat(F.lit("The report may be stale (built "), seven(built(text)["commit"]), F.lit(", head "), seven(head), F.lit(").")))


def report_tokens(text: Column) -> Column:
    """What reading the whole report would cost: the baseline of its views."""
    return tokens(text)
