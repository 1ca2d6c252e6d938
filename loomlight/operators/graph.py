"""A symbol graph over a corpus: nodes and edges as tables, search, statistics and breadth-first traversal.

files(path, content) -> signatures -> nodes(key, name, kind, file, ord) and edges(src, dst, kind, ord). Edges are a bag.
Traversals are unrolled joins (at most three hops), never a driver loop over rows. `stored` keeps a graph between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metrics import FILE_TOKENS
from ..functions.scanners import signature
from ..sources.shared import cut, settled

# Matches shown, matches a traversal starts from, hops, names shown a depth, and files shown.
SHOWN, SEEDS, HOPS, PER_DEPTH, FILES_SHOWN = 25, 3, 3, 20, 5
#: Hexadecimal digits of a path's hash that name its part of a manifest.
MANIFEST_DIGITS = 3
# Order of a file's symbols, their key prefixes and edges.
ORDER = [("functions", "function", "fn", "contains"), ("classes", "class", "cls", "contains"), ("imports", "import", "imp", None), ("exports", "export", "exp", "exports")]


def signatures(files: DataFrame, *more: str) -> DataFrame:
    """(path, language, more, sig) of files(path, content): by the language's scanner, else by line patterns."""
    d = files.select("path", "content", *[c for c in more if c != "content"], T.language(F.col("path")).alias("language"), T.grammar(F.col("path"), F.col("content")).alias("grammar"))
    return settled(d, sig=signature(F.col("content"), F.col("grammar"))).select("path", "language", *more, "sig")


def symbols(sigs: DataFrame) -> DataFrame:
    """(path, section, pos, name, kind, prefix, edge): the declared names of each file, in order, repeats kept."""

    def declared(n: int, section: str, kind: str, prefix: str, edge: str) -> Column:
        return F.transform(f"sig.{section}", lambda line, pos: F.struct(F.lit(n).alias("section"), pos.alias("pos"), T.symbol_name(line, kind).alias("name"), F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), F.lit(edge).alias("edge")))

    every = F.flatten(F.array(*[declared(n, *o) for n, o in enumerate(ORDER) if o[3]]))
    return sigs.select("path", F.explode(every).alias("s")).select("path", "s.*").where("name IS NOT NULL")


def wanted(sigs: DataFrame) -> DataFrame:
    """(path, pos, names, rank, candidate): the paths that each import may mean, in order."""
    d = sigs.select("path", "language", F.posexplode("sig.imports").alias("pos", "line"))
    d = settled(d, parsed=T.parse_import(F.col("line"), F.col("language"))).where("parsed IS NOT NULL")
    return d.select("path", "pos", "parsed.names", F.posexplode(T.import_candidates(F.col("parsed.source"), F.col("path"))).alias("rank", "candidate"))


def imports(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, pos, target, names): imports of files of the corpus paths(path); the first candidate that exists wins."""
    there = paths.select(F.col("path").alias("candidate")).distinct()
    return wanted.join(there, "candidate").groupBy("path", "pos").agg(F.min_by("candidate", "rank").alias("target"), F.first("names").alias("names"))


def linked(sigs: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of some files' signatures and imports. A key declared twice keeps its first place.

    But for imports, whose name is the last target's, a key has one prefix, path and name: those are grouped, with the
    place as a number, which is hashed and not sorted as places and names of a group would be.
    """
    named = symbols(sigs)
    key = F.concat_ws(":", "prefix", "path", "name")
    modules = sigs.select(F.lit("mod").alias("prefix"), F.lit("module").alias("kind"), "path", F.lit(None).cast("string").alias("name"), F.lit(-1).alias("section"), F.lit(0).alias("pos"))
    own = modules.unionAll(named.select("prefix", "kind", "path", "name", "section", "pos"))
    own = own.groupBy("prefix", "kind", "path", "name").agg(F.min(F.shiftleft(F.col("section").cast("long"), 32) + F.col("pos")).alias("place"))
    place = F.struct(F.shiftright("place", 32).cast("int").alias("section"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    own = own.select(key.alias("key"), F.coalesce("name", "path").alias("name"), "kind", F.col("path").alias("file"), place.alias("ord"))
    used = imported.select("path", "pos", "target", F.explode("names").alias("n"))
    used = used.select(F.concat(F.lit("imp:"), "path", F.lit(":"), "n").alias("key"), F.concat("n", F.lit(" (from "), "target", F.lit(")")).alias("name"), F.lit("import").alias("kind"), F.col("path").alias("file"), F.lit(2).alias("section"), "pos")
    nodes = own.unionAll(used.groupBy("key").agg(F.max_by("name", F.struct("section", "pos")).alias("name"), F.first("kind").alias("kind"), F.first("file").alias("file"), F.min(F.struct("section", "pos")).alias("ord")).select(own.columns))
    src = F.concat(F.lit("mod:"), "path")
    edges = named.select(src.alias("src"), key.alias("dst"), F.col("edge").alias("kind"), F.struct("section", "pos").alias("ord"))
    edges = edges.unionAll(imported.select(src.alias("src"), F.concat(F.lit("mod:"), "target").alias("dst"), F.lit("imports").alias("kind"), F.struct(F.lit(2).alias("section"), "pos").alias("ord")))
    return nodes.select("key", "name", "kind", "file", "ord"), edges


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files(path, content).

    Signatures are extracted once and written to the shared folder: nodes and edges read them several times.
    """
    sigs = cut(signatures(files), "graph-signatures")
    return linked(sigs, imports(wanted(sigs), sigs))


def matches(query: str) -> Column:
    """Whether a node's name or key contains the query, whatever the case."""
    q = F.lower(F.lit(query))
    return F.contains(F.lower("name"), q) | F.contains(F.lower("key"), q)


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that match the query, in order of file and place."""
    return ordered(nodes.where(matches(query)))


def ordered(nodes: DataFrame) -> DataFrame:
    """Nodes in order of file and place."""
    return nodes.orderBy("file", "ord", "key")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, nodes by kind, edges, and the tokens that reading all files would cost."""
    of_nodes = nodes.select("kind", F.lit("node").alias("of")).unionAll(edges.select("kind", F.lit("edge").alias("of")))
    node, edge, kind = F.col("of") == "node", F.col("of") == "edge", F.col("kind")
    counts = {"nodes": node, "files": node & (kind == "module"), "functions": node & (kind == "function"), "classes": node & (kind == "class"), "exports": node & (kind == "export"), "edges": edge, "import_edges": edge & (kind == "imports")}
    return of_nodes.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("naive_tokens", F.col("files") * FILE_TOKENS)


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, incoming: bool = False) -> DataFrame:
    """(key, depth): everything within `hops` of seeds(key), at its least depth.

    Links are written once to the shared folder, else each hop would recompute all before it.
    """
    return walk(cut(links(edges, incoming), "graph-links"), seeds, hops)


def links(edges: DataFrame, incoming: bool, buckets: int | None = None) -> DataFrame:
    """(at, key): the distinct steps of a traversal; dealt out by at over some buckets, if they are named, by one shuffle."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    d = edges.select(F.col(a).alias("at"), F.col(b).alias("key"))
    return (d.repartition(buckets, "at") if buckets else d).distinct()


def walk(links: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, depth): what links(at, key) reach from seeds(key), at its least depth.

    Each hop joins the frontier to the links, and drops what was seen; the frontier's size decides how it is joined.
    Frontiers are written to the shared folder.
    """
    seen = cut(seeds.select("key").distinct().withColumn("depth", F.lit(0)), "graph-frontier")
    frontier = seen
    for depth in range(1, hops + 1):
        reached = links.join(frontier.select(F.col("key").alias("at")), "at", "left_semi").select("key").distinct()
        frontier = cut(reached.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)), "graph-frontier")
        seen = seen.unionAll(frontier)
    return seen


def by_depth(found: DataFrame, nodes: DataFrame, shown: int = PER_DEPTH) -> DataFrame:
    """(depth, n, listed, more): a depth's number of keys, its first names, and how many more nodes there are.

    The ranks are limited in every task before the few first rows of a depth meet; the numbers are counted apart.
    """
    named = found.join(nodes.select("key", "name", "kind"), "key", "left")
    counted = named.groupBy("depth").agg(F.count("*").alias("n"), F.count("kind").alias("named"))
    order = Window.partitionBy("depth").orderBy("key")
    first = named.where("kind IS NOT NULL").select("depth", "key", F.concat("kind", F.lit(" "), "name").alias("line"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= shown)
    listed = first.groupBy("depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("listed"))
    d = counted.join(listed, "depth", "left")
    return d.select("depth", "n", F.when(F.col("named") > 0, F.col("listed")).alias("listed"), F.when(F.col("named") > 0, F.greatest(F.lit(0), F.col("named") - shown)).alias("more"))


def part(path: Column, digits: int = MANIFEST_DIGITS) -> Column:
    """The part of a manifest that a path belongs to, by its hash."""
    return F.substring(F.sha2(path, 256), 1, digits)


_JOINED = lambda of, sep: F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["line"]), sep)


def digests(files: DataFrame, digits: int = MANIFEST_DIGITS) -> DataFrame:
    """(part, line): a hash over files(path, mtime_ms, size) of each part, in order of their paths."""
    line = F.concat_ws("|", "path", F.col("mtime_ms").cast("string"), F.col("size").cast("string"))
    d = files.select("path", line.alias("line"), part(F.col("path"), digits).alias("part"))
    return d.groupBy("part").agg(F.sha2(_JOINED(F.struct("path", "line"), "\n"), 256).alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """One row, 16 hexadecimal digits over files(path, mtime_ms, size).

    Files are dealt out by their paths' hash; each part is hashed, then the parts in order of their numbers, at most
    16 ** MANIFEST_DIGITS of them. So no task gathers all paths.
    """
    return digests(files).agg(F.substring(F.sha2(_JOINED(F.struct("part", "line"), "\n"), 256), 1, 16).alias("manifest"))


def file_symbols(nodes: DataFrame, query: str) -> DataFrame:
    """(file, symbols, ord, kind, name) for every symbol of the files whose path contains the query, whatever the case."""
    some = nodes.where(F.contains(F.lower("file"), F.lower(F.lit(query))))
    counted = some.groupBy("file").agg(F.count("*").alias("symbols"))
    return some.join(counted, "file").select("file", "symbols", "ord", "kind", "name", "key")
