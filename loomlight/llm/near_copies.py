"""Near copies: Jaccard similarity of at least 4 / 5 over five-word shingles, every link verified on the shingle sets.

Two routes lead to candidates. The first is quick and contracts what is plainly alike: a fingerprint of a text's
distinct words is looked up in the byte-position index at MAX_BITS differing bits. Whoever is connected by candidates
forms a cluster; within it pairs that a signature (the smallest shingle hash in each of BINS bins, one byte of it)
estimates at LOOSE or more are verified on their shingle sets, unless linked already. Clusters over CHUNK texts are
dealt out as pairs of chunks, and tasks return spanning forests.

The second route finds the rest. All shingles have one order; of two sets of which the larger has n shingles and that
reach the similarity, at least 4 n / 5 are shared, so the first n - ceil(4 n / 5) + 1 of each set share one (prefix
filter). Texts of different groups that share such a shingle, and whose sizes and places in the order allow the
similarity, are pairs to verify: those whose signatures estimate less than LOOSE go (a pair at 0.8 does so with a chance
below one in a million), the rest is verified on the sets. The order is by hash, with shingles that are frequent in a sample of the
texts last: a wrong guess of a frequency costs candidates, never a pair. Lists over CHUNK texts are dealt out as pairs
of chunks, and lists of one group only are dropped before any pair is made.

Shingles are 64-bit hashes; equal sets, by 128 bits of theirs, are one text throughout.

Defined cases: as in simhash; texts without words are copies of one another; a text with fewer words than a shingle
has its whole sequence as the one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, gathered, materialize, prepare
from .simhash import links
from .substrings import Hashed, _cut, _mix

MAX_BITS, SHINGLE, BINS, CHUNK, LOOSE = 6, 5, 256, 1024, 0.65
#: One text in SAMPLE counts for the order of shingles; those in COMMON of them and more come last, MOST at most.
SAMPLE, COMMON, MOST = 64, 3, 200_000


def signature(hashes: np.ndarray) -> bytes:
    """One byte of the smallest hash in each bin, 1 to 255; 0 marks an empty bin."""
    h = np.unique(hashes)
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (_mix(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all, enough to share one with every set that is a near copy."""
    last = np.isin(shingles, common, assume_unique=True)
    return np.concatenate((shingles[~last], shingles[last]))[: len(shingles) - (4 * len(shingles) + 4) // 5 + 1]


def copies(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of at least 4 / 5."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Slices of the batches, with the ascending shingles and the ascending words of each text, by hash."""
    for b in batches:
        for some, texts in _cut(b):
            h = Hashed([(t or b"").lower() for t in texts], SHINGLE)
            words, sets, own = h.word_hashes(), [], []
            for i in range(len(texts)):
                lo, hi = h.first[i], h.first[i + 1]
                shingles = h.hashes[h.before[i] : h.before[i + 1]]
                if not len(shingles) and hi > lo:  # fewer words than a shingle: the whole sequence
                    shingles = np.array([np.bitwise_xor.reduce(_mix(words[lo:hi] + np.arange(hi - lo, dtype=np.uint64)))], np.uint64)
                sets.append(np.unique(shingles))
                own.append(np.unique(words[lo:hi]))
            yield some, sets, own


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets, _ in _shingles(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])


def _described(batches: Iterator[pa.RecordBatch], common: Broadcast) -> Iterator[pa.RecordBatch]:
    for some, sets, words in _shingles(batches):
        fps = np.zeros(len(sets), np.uint64)
        for i, own in enumerate(words):
            if len(own):
                bits = np.unpackbits(_mix(own).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                fps[i] = np.packbits(2 * bits > len(own)).view(np.uint64)[0]
        first = [prefix(x, common.value).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
        columns = {"fp": pa.array(fps.view(np.int64)), "signature": pa.array([signature(x) for x in sets], pa.binary()), "digest": pa.array([_digest(x) for x in sets], pa.binary())}
        columns |= {"size": pa.array([len(x) for x in sets], pa.int32()), "prefix": pa.array(first, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns.values()], ["doc_id", *columns])


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows that have the wanted digest: those that repeat a doc_id may have another text."""
    for some, sets, _ in _shingles(batches):
        wanted = [i for i, (x, d) in enumerate(zip(sets, some.column("digest").to_pylist(), strict=True)) if _digest(x) == d]
        yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(wanted, pa.int64())), pa.array([sets[i].tobytes() for i in wanted], pa.binary())], ["node", "shingles"])


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of signatures."""
    used = ((a | b) > 0).sum(axis=1)
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1)


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of the verified links of each part of a cluster."""
    for f in gathered(frames, ["cluster", "part"], 2 * CHUNK):
        for _, g in f.groupby(["cluster", "part"], sort=False):
            x = np.frombuffer(b"".join(g["signature"]), np.uint8).reshape(-1, BINS)
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            node, label = g["node"].to_numpy(), np.arange(len(g))
            for i in range(len(g) - 1):
                rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                for j in rest[_estimates(x[rest], x[i]) >= LOOSE]:
                    if label[i] != label[j] and copies(sets[i], sets[j]):
                        both = label[i], label[j]
                        label[label == max(both)] = min(both)
            moved = label != np.arange(len(g))
            yield pd.DataFrame({"u": node[moved], "v": node[label[moved]]})


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a list's texts, of different groups, whose sizes and places in the order allow the similarity."""
    for f in gathered(frames, ["h", "part"], 100_000):
        h, part, node, group, size, place = (f[c].to_numpy() for c in ("h", "part", "node", "component", "size", "place"))
        new = np.ones(len(f), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        run = np.cumsum(new) - 1
        left = size - place  # shingles from this one on
        at, k = np.arange(len(f)), 1
        found: list[np.ndarray] = []
        while len(at := at[at + k < len(f)]) and len(at := at[run[at] == run[at + k]]):
            b = at + k
            hit = (group[at] != group[b]) & (9 * np.minimum(left[at], left[b]) >= 4 * (size[at] + size[b])) & (5 * np.minimum(size[at], size[b]) >= 4 * np.maximum(size[at], size[b]))
            if hit.any():
                u, v = node[at[hit]], node[b[hit]]
                found.append(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1))
            if sum(map(len, found)) > 1_000_000:
                u, v = np.unique(np.concatenate(found), axis=0).T
                yield pd.DataFrame({"u": u, "v": v})
                found = []
            k += 1
        if found:
            u, v = np.unique(np.concatenate(found), axis=0).T
            yield pd.DataFrame({"u": u, "v": v})


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b"))
        hit = pa.array(_estimates(x, y) >= LOOSE)
        yield pa.RecordBatch.from_arrays([b.column("u").filter(hit), b.column("v").filter(hit)], ["u", "v"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)
        hit = pa.array([copies(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(hit), b.column("v").filter(hit)], ["u", "v"])


def _dealt(df: DataFrame) -> DataFrame:
    """Each row of df(node, n, ...) once for every pair of n chunks that holds its node, named by part."""
    own = F.when(F.col("n") > 1, F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).otherwise(F.lit(0))
    part = F.explode(F.expr("transform(sequence(0, n - 1), j -> CAST(least(own, j) AS BIGINT) * n + greatest(own, j))"))
    return df.withColumn("own", own).withColumn("part", part).drop("own", "n")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text); component_id is the smallest doc_id of its group."""
    spark = docs.sparkSession
    prepare(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sample = read.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_sampled, "h long")
    frequent = sample.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST)
    common = spark.sparkContext.broadcast(frequent.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    with Scratch(spark) as scratch:
        described = scratch.keep(read.mapInArrow(partial(_described, common=common), "doc_id long, fp long, signature binary, digest binary, size int, prefix array<long>"), "near-described")
        common.destroy()
        rows = scratch.keep(described.select("doc_id", "digest"), "near-rows")
        named = scratch.keep(rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")), "near-names")
        sets = lambda nodes: read.join(named.join(nodes.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "doc_id"), "doc_id").mapInArrow(_sets, "node long, shingles binary")
        texts = described.withColumnRenamed("doc_id", "node").join(named, ["node", "digest"], "left_semi")
        texts = scratch.keep(texts.where("size > 0").select("node", "fp", "signature", "size", "prefix"), "near-texts")
        scratch.drop("near-described")

        by = scratch.keep(texts.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
        linked = components(links(by, MAX_BITS), scratch, "near-candidates")
        homes = by.join(linked, "node", "left").select("fp", F.coalesce("component_id", "node").alias("cluster"))
        clusters = scratch.keep(texts.select("node", "fp").join(homes, "fp").select("node", "cluster"), "near-clusters")
        sizes = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster", F.ceil(F.col("c") / CHUNK).cast("int").alias("n"))
        some = scratch.keep(clusters.join(sizes, "cluster"), "near-clustered")
        dealt = _dealt(some.join(texts.select("node", "signature"), "node").join(sets(some), "node"))
        dealt = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
        quick = components(dealt.select("cluster", "part", "node", "signature", "shingles").mapInPandas(_verified, "u long, v long"), scratch, "near-quick")
        scratch.drop("near-fingerprints", "near-candidates", "near-clusters", "near-clustered")

        # the second route: what is of one group already needs no more links
        entries = texts.join(quick, "node", "left").select("node", F.coalesce("component_id", "node").alias("component"), "size", F.posexplode("prefix").alias("place", "h"))
        lists = entries.groupBy("h").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        lists = scratch.keep(lists.select("h", F.ceil(F.col("c") / CHUNK).cast("int").alias("n")), "near-lists")
        dealt = _dealt(entries.join(lists, "h")).repartition("h", "part").sortWithinPartitions("h", "part")
        pairs = scratch.keep(dealt.select("h", "part", "node", "component", "size", "place").mapInPandas(_pairs, "u long, v long").distinct(), "near-pairs")
        side = lambda of, end, x, to: of.select(F.col("node").alias(end), F.col(x).alias(to))
        likely = pairs.join(side(texts, "u", "signature", "a"), "u").join(side(texts, "v", "signature", "b"), "v")
        likely = scratch.keep(likely.mapInArrow(_likely, "u long, v long"), "near-likely")
        scratch.drop("near-lists", "near-pairs", "near-texts")
        ends = scratch.keep(sets(likely.select(F.explode(F.array("u", "v")).alias("node"))), "near-sets")
        compared = likely.join(side(ends, "u", "shingles", "a"), "u").join(side(ends, "v", "shingles", "b"), "v")
        exact = compared.mapInArrow(_compared, "u long, v long")

        found = components(exact.unionAll(quick.select(F.col("node").alias("u"), F.col("component_id").alias("v"))), scratch, "near-found")
        named = named.join(found, "node", "left").select("digest", F.coalesce("component_id", "node").alias("component_id"))
        return materialize(rows.join(named, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "near-copies")
