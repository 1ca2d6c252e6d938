"""A symbol graph kept in a folder that follows its corpus: what changed is found by digests, and only that is read again.

Files belong to parts by their paths' hash, and each part has a digest over its files' times and sizes: two levels of a
Merkle tree. A refresh compares the digests, then the files of the parts that differ, and scans the contents of changed
and new files alone. An import depends on which paths exist as well: where files came or went, the imports of other
files that may mean them are resolved again, from the candidates that are kept. Tables are partitioned by part and the
touched parts are replaced; nothing of an older graph stays.

Crash safety: nodes, edges and indexes are written first, what was scanned second, digests last. A refresh that dies
leaves the old digests, so the next one finds the same parts again. One writer a folder at a time; frames taken before
a refresh may name files that it has replaced, take them anew.

Traversals read the links by source or by target, bucketed and sorted by it: a hop moves its frontier only. Search reads
posting lists of trigrams, whose intersection names the blocks of files whose nodes to look at. A posting is a gram and a
block, not a node: a block's files share most of their grams, so that the lists grow far slower than the nodes. Links are
made by the first traversal after a refresh, the postings of the parts that it touched by the first search.

Below the folder: sources (path, language, sig, mtime_ms, size), candidates (the paths that imports may mean), nodes,
edges, postings (gram, block), each by part; digests; links.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, settled
from . import graph as G

#: Buckets of the links, the length of the grams of the search, and the blocks that a part's files are dealt out over for it.
BUCKETS, GRAM, BLOCKS = 32, 3, 256
_ORD, _SIG = "struct<section: int, pos: int>", "struct<imports: array<string>, exports: array<string>, functions: array<string>, classes: array<string>>"
SCHEMAS = {
    "sources": f"path string, language string, sig {_SIG}, mtime_ms long, size long, part string",
    "candidates": "path string, pos int, names array<string>, rank int, candidate string, part string",
    "nodes": f"key string, name string, kind string, file string, ord {_ORD}, part string",
    "edges": f"src string, dst string, kind string, ord {_ORD}, part string",
    "postings": "gram string, block int, part string",
    "digests": "part string, line string",
    "links": "at string, key string",
}


@dataclass(frozen=True)
class Refreshed:
    """Parts that differed, parts whose imports were resolved again, files whose contents were read."""

    parts: int
    relinked: int
    scanned: int


class StoredGraph:
    """The graph kept in a folder; `digits` hexadecimal digits name a part, 16 ** digits of them."""

    def __init__(self, spark: SparkSession, folder: str, digits: int = G.MANIFEST_DIGITS):
        self.spark, self.folder, self.digits = spark, f"{folder.rstrip('/')}/by-{digits}", digits

    # ---- tables
    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, name: str) -> DataFrame:
        fs, path = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def _parts(self, name: str) -> set[str]:
        """The parts that a table has."""
        fs, path = self._path(name)
        found = fs.listStatus(path) if fs.exists(path) else []
        return {n.removeprefix("part=") for f in found if (n := f.getPath().getName()).startswith("part=")}

    def _drop(self, name: str, parts: list[str]) -> None:
        for part in self._parts(name) & set(parts):
            fs, path = self._path(f"{name}/part={part}")
            fs.delete(path, True)

    def _replace(self, name: str, rows: DataFrame, parts: list[str]) -> None:
        """The rows, of these parts only, take the place of what those parts held."""
        self._drop(name, parts)
        by_part = rows.hint("rebalance", "part").sortWithinPartitions("part", *(["gram"] if name == "postings" else []))
        by_part.write.mode("append").partitionBy("part").parquet(f"{self.folder}/{name}")

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes").drop("part")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges").drop("part")

    # ---- refresh
    def _part(self, path):  # noqa: ANN001, ANN202
        return F.concat(F.lit("p"), G.part(path, self.digits))

    def refresh(self, files: DataFrame, rebuild: bool = False) -> Refreshed:
        """Follow files(path, content, mtime_ms, size), the whole corpus as it is now; paths are unique."""
        files = files.select("path", "content", F.col("mtime_ms").cast("long").alias("mtime_ms"), F.col("size").cast("long").alias("size"))
        fs, path = self._path("digests/_SUCCESS")
        if rebuild or not fs.exists(path):
            return self._first(files)
        now = cut(self._digests(files), "graph-digests")
        both = now.withColumnRenamed("line", "new").join(self.table("digests").withColumnRenamed("line", "old"), "part", "full_outer")
        parts = [r.part for r in both.where("NOT (new <=> old)").select("part").collect()]  # 16 ** digits at most
        if not parts:
            return Refreshed(0, 0, 0)
        touched = lambda d: d.where(F.col("part").isin(parts))
        others = lambda d: d.where(~F.col("part").isin(parts))
        kept = ["path", "mtime_ms", "size"]
        seen = touched(self.table("sources"))
        there = cut(touched(files.select(*kept, self._part(F.col("path")).alias("part"))), "graph-there")
        changed = cut(there.join(seen, kept, "left_anti").select("path"), "graph-changed")
        scanned = cut(G.signatures(files.join(changed, "path", "left_semi"), "mtime_ms", "size"), "graph-signatures")
        sigs = scanned.unionByName(seen.join(there, kept, "left_semi").select(*scanned.columns)).withColumn("part", self._part(F.col("path")))
        sigs = cut(sigs.select("path", "language", "sig", "mtime_ms", "size", "part"), "graph-sources")
        moved = seen.select("path", F.lit(1).alias("was")).join(there.select("path", F.lit(1).alias("now")), "path", "full_outer").where("was IS NULL OR now IS NULL")
        moved = cut(moved.select(F.col("path").alias("candidate")), "graph-moved")
        elsewhere = others(self.table("candidates"))
        again = [r.part for r in elsewhere.join(moved, "candidate", "left_semi").select("part").distinct().collect()]
        relinked = lambda d: d.where(F.col("part").isin(again))
        wanted = cut(G.wanted(sigs).withColumn("part", self._part(F.col("path"))), "graph-wanted")
        paths = others(self.table("sources")).select("path").unionAll(sigs.select("path"))
        imported = cut(G.imports(wanted.unionByName(relinked(self.table("candidates"))), paths), "graph-imports")
        nodes, edges = G.linked(sigs.unionByName(relinked(self.table("sources"))), imported)
        every = parts + again
        self._replace("nodes", nodes.withColumn("part", self._part(F.col("file"))), every)
        self._replace("edges", edges.withColumn("part", self._part(F.expr("substring(src, 5)"))), every)
        self._drop("postings", every)
        self._replace("candidates", wanted, parts)
        self._replace("sources", sigs, parts)
        fs, path = self._path("links")
        fs.delete(path, True)
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/digests")
        return Refreshed(len(parts), len(again), scanned.count())

    def _first(self, files: DataFrame) -> Refreshed:
        """Keep all of the files, and nothing of an older graph. Contents are made and read once: what is compared later
        follows from the rows that were scanned."""
        fs, path = self._path("")
        fs.delete(path, True)
        sigs = G.signatures(files.where("path IS NOT NULL"), "mtime_ms", "size")
        self._replace("sources", sigs.withColumn("part", self._part(F.col("path"))), [])
        sigs = self.table("sources")
        self._replace("candidates", G.wanted(sigs).withColumn("part", self._part(F.col("path"))), [])
        imported = cut(G.imports(self.table("candidates").drop("part"), sigs.select("path")), "graph-imports")
        nodes, edges = G.linked(sigs, imported)
        self._replace("nodes", nodes.withColumn("part", self._part(F.col("file"))), [])
        self._replace("edges", edges.withColumn("part", self._part(F.expr("substring(src, 5)"))), [])
        now = cut(self._digests(sigs), "graph-digests")
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/digests")
        return Refreshed(now.count(), 0, sigs.count())

    def _digests(self, files: DataFrame) -> DataFrame:
        return G.digests(files, self.digits).withColumn("part", F.concat(F.lit("p"), "part"))

    # ---- traversal
    def links(self, incoming: bool) -> DataFrame:
        """(at, key), bucketed and sorted by at: a table of this session over files made by the first traversal."""
        at, name = f"links/{'in' if incoming else 'out'}-{BUCKETS}", f"loomlight_{uuid.uuid4().hex}"
        fs, done = self._path(f"{at}/_SUCCESS")
        if not fs.exists(done):
            rows = G.links(self.edges, incoming, BUCKETS)
            rows.write.mode("overwrite").bucketBy(BUCKETS, "at").sortBy("at").option("path", f"{self.folder}/{at}").saveAsTable(name)
        else:
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMAS['links']}) USING parquet CLUSTERED BY (at) SORTED BY (at) INTO {BUCKETS} BUCKETS LOCATION '{self.folder}/{at}'")
        return self.spark.table(name)

    def traverse(self, seeds: DataFrame, hops: int = G.HOPS, incoming: bool = False) -> DataFrame:
        """(key, depth): everything within `hops` of seeds(key), at its least depth."""
        return G.walk(self.links(incoming), seeds, hops)

    # ---- search
    def candidates(self, query: str) -> DataFrame:
        """(part, block) of the blocks that hold every trigram of the query; not every node of theirs matches it."""
        if missing := sorted(self._parts("nodes") - self._parts("postings")):
            self._replace("postings", postings(self.table("nodes").where(F.col("part").isin(missing))), missing)
        of = sorted({query.lower()[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
        hits = self.table("postings").where(F.col("gram").isin(of))
        return hits.groupBy("part", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(of)).select("part", "block")

    def found(self, query: str) -> DataFrame:
        """Nodes whose name or key contains the query, whatever the case, in no order.

        Queries of fewer characters than a gram, and those whose lower case has another length, scan the nodes.
        """
        if len(query) < GRAM or len(query.lower()) != len(query):
            return self.nodes.where(G.matches(query))
        blocks = cut(self.candidates(query), "graph-candidates")
        parts = [r.part for r in blocks.select("part").distinct().collect()]  # 16 ** digits at most
        some = self.table("nodes").where(F.col("part").isin(parts)).where(G.matches(query))
        return some.withColumn("block", block(F.col("file"))).join(blocks, ["part", "block"], "left_semi").drop("part", "block")

    def search(self, query: str) -> DataFrame:
        """What `found` finds, in order of file and place."""
        return G.ordered(self.found(query))


def block(file: Column) -> Column:
    """The block of a part that a file belongs to, by its path's hash."""
    return F.pmod(F.xxhash64(file), F.lit(BLOCKS)).cast("int")


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, block, part): the distinct trigrams of the names and keys of each block's nodes, in lower case."""
    d = settled(nodes.select("part", block(F.col("file")).alias("block"), "name", "key"), low_name=F.lower("name"), low_key=F.lower("key"))
    # a key mostly ends with its name, whose grams it then has
    texts = d.select("part", "block", F.explode(F.when(F.contains("low_key", "low_name"), F.array("low_key")).otherwise(F.array("low_key", "low_name"))).alias("text"))
    n = F.length("text")
    grams = texts.where(n >= GRAM).select(F.explode(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring("text", i, F.lit(GRAM)))).alias("gram"), "block", "part")
    return grams.distinct()


def open_graph(files: DataFrame, folder: str, rebuild: bool = False, digits: int = G.MANIFEST_DIGITS) -> StoredGraph:
    """The stored graph of files(path, content, mtime_ms, size), brought up to date."""
    graph = StoredGraph(files.sparkSession, folder, digits)
    graph.refresh(files, rebuild)
    return graph
