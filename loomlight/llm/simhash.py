"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most d bits differ in at most d
bytes, so at least 8 - d positional bytes are shared: the guaranteed minimum. The index posts every distinct
fingerprint under sets of positional bytes chosen so that any pair reaching the minimum meets in some posting list
(for d = 4: twenty sets of three positions, such that every four of the eight positions contain one). Lists of single
bytes would hold a 256th of all fingerprints each, so that tallying over them were all pairs; lists of three bytes
already count three towards the tally. Within a list the shared positional bytes of each pair are tallied, pairs below
the minimum are dropped unseen, and only the rest is verified by the Hamming distance. Lists over CHUNK fingerprints are dealt out as pairs of chunks, and a task returns the
spanning forest of the links that it finds, never the pairs, so a dense group costs rows in proportion to its size.

Defined cases: a null text, a text without words and an empty text have fingerprint zero and link to each other and
to anything within d bits of zero; a text of any length is hashed whole, 65,536 shingles at a time; a bit set in exactly half the hashes is 0; a row without doc_id links with nothing and has no component; exact copies share one index entry; repeated doc_ids are one node; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, gathered, materialize, prepare, table

#: Fingerprints of a posting list that one task compares with as many others.
CHUNK = 2048
SEED, BYTES, MAX_BITS, SHINGLE = 42, 8, 4, 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of XXH64 (seed 42) over all word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    h, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, np.int64)
    last = min(shingle, len(words)) - 1
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        hashes = np.fromiter([h(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), (ends[at + last : to + last] - 1).tolist(), strict=True)], np.uint64, to - at)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def position_sets(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any `least` of the eight contain one set. Larger sets make shorter lists."""
    if least >= 4:  # triples within a class, or two of a class and one of the next
        of = [0, 0, 0, 1, 1, 1, 2, 2]
        return [t for t in combinations(range(BYTES), 3) if (c := sorted(of[i] for i in t)) and (len(set(c)) == 1 or any(c.count(k) == 2 and c.count((k + 1) % 3) == 1 for k in range(3)))]
    if least == 3:  # of two classes one holds two of any three
        return [p for half in (range(4), range(4, 8)) for p in combinations(half, 2)]
    return list(combinations(range(BYTES), max(1, least)))


def _byte(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, 56 - 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally: in how many positions the bytes of two fingerprints agree, from their exclusive or."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def close(x: np.ndarray, max_bits: int) -> tuple[np.ndarray, int]:
    """Places of the pairs, given as exclusive ors, that differ in at most max_bits bits; how many the tally let through."""
    counted = np.flatnonzero(shared_bytes(x) >= BYTES - max_bits)
    return counted[np.bitwise_count(x[counted]) <= max_bits], len(counted)


def _links(frames: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Tally, filter and verify all pairs of each run of equal keys; returns the forest of the links of many runs."""
    for f in gathered(frames, ["key", "part"], 100_000):
        key, part, node, fp = (f[c].to_numpy() for c in ("key", "part", "node", "fp"))
        fp = fp.view(np.uint64)
        new = np.ones(len(f), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new) - 1
        a, b = [], []
        own, place = np.unique(node, return_inverse=True)  # a document's entries are one node in all its lists
        at, k, held = np.arange(len(f)), 1, 0
        while len(at := at[at + k < len(f)]) and len(at := at[group[at] == group[at + k]]):
            hit, _ = close(fp[at] ^ fp[at + k], max_bits)
            a.append(place[at[hit]])
            b.append(place[at[hit] + k])
            held += len(a[-1])
            if held > 1_000_000:
                label = forest(np.concatenate(a), np.concatenate(b), len(own))
                a, b = [np.flatnonzero(label != np.arange(len(own)))], [label[label != np.arange(len(own))]]
                held = len(a[0])
            k += 1
        label = forest(np.concatenate(a), np.concatenate(b), len(own)) if a else np.arange(len(own))
        moved = label != np.arange(len(own))
        yield pd.DataFrame({"u": own[moved], "v": own[label[moved]]})


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) between the nodes of classes(node, fp) whose fingerprints differ in at most max_bits bits.

    fp must be distinct; a node may have several. max_bits may be up to 7, the most for which a shared positional byte is guaranteed.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be 0 to 7")
    sets = position_sets(BYTES - max_bits)
    keys = [F.lit(n << 24).cast("long") + sum((F.shiftleft(_byte(F.col("fp"), i), 8 * k) for k, i in enumerate(s)), F.lit(0).cast("long")) for n, s in enumerate(sets)]
    index = classes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    hot = index.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("n"))
    dealt = index.join(hot, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # a row of chunk c goes to the chunk pairs (c, j) for all j; the smaller number comes first
    own = F.when(F.col("n") > 1, F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).otherwise(F.lit(0))
    pairs = F.when(F.col("n") > 1, F.expr("transform(sequence(0, n - 1), j -> cast(least(own, j) as long) * n + greatest(own, j))")).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.withColumn("own", own).select("key", F.explode(pairs).alias("part"), "node", "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(partial(_links, max_bits=max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.keep(fingerprints(docs, shingle), "simhash-fingerprints")
        classes = scratch.keep(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
        found = components(links(classes, max_bits), scratch, "simhash-links")
        named = classes.join(found, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
        # a fingerprint may belong to a third of all documents: its rows may be split, the classes are one row each
        return materialize(fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "simhash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
