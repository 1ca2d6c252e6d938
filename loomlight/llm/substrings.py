"""Exact substring deduplication behind a count-min prefilter.

A window is `width` consecutive words of one document. Every partition sketches its windows' hashes in a count-min
sketch (ROWS rows of saturating counters: none, one, more); the sketches are merged range by range of their cells, by
tasks of the cluster, into one bit per cell that says "two or more". The rows are built in turn, each by a pass over
the windows that the rows before estimate repeated: copies of a window pass or fail together, so an estimate never
falls below the true count, a window met twice always passes, and later rows are nearly empty. The next pass groups
only windows estimated repeated, by a cryptographic digest of their words (BLAKE2b, 128 bits), for which nobody can
make two unlike windows agree; of each group the first start (smallest doc_id, then earliest start) stays. The first starts return to their documents, which are joined by doc_id, so a passage that a
third of the documents share is never gathered. The last pass removes the words under every estimated window that
isn't a first start.

The sketch has a fixed number of bits (a parameter, proven bound of the broadcast: ROWS * 2 ** log2_cells / 8 bytes).
A fuller sketch only sends more windows to the exact grouping; none is lost at any size. Texts of any length are
hashed whole, one at a time if they exceed BLOCK.

Defined cases: a null or empty text has no words, removes nothing and keeps the empty string; shorter documents than
a window keep all words; rows that repeat doc_id and text are one document and are treated alike; rows that share a
doc_id but not the text are documents of their own, in order of a hash of the text; a row without doc_id keeps its
words and removes none; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, prepare, table

WIDTH = 20
#: The sketch: rows, and cells of a row (a power of two). Ranges of cells are merged by separate tasks.
ROWS, LOG2_CELLS, LOG2_RANGE = 2, 28, 16
#: Bytes of text that are hashed at once.
BLOCK = 1 << 19
#: Longer words, in bytes, are hashed one by one.
LONG = 32

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(1)
def _constants() -> tuple[np.ndarray, ...]:
    """A random table of byte values, two odd multipliers and their inverses modulo 2 ** 64."""
    r = np.random.default_rng(20)
    table = r.integers(1, 1 << 63, 256, dtype=np.uint64)
    odd = [int(x) | 1 for x in r.integers(1 << 60, 1 << 62, 2)]
    return table, odd, [pow(x, -1, 1 << 64) for x in odd]


@lru_cache(32)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hash of values[s:e] for each span, by prefix sums modulo 2 ** 64, mixed."""
    n = 1 << max(10, int(len(values) + 1).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[: len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(inverse, n)[starts] + (ends - starts).astype(np.uint64))


class Hashed:
    """Words and window hashes of some documents. The buffer holds their words, each followed by one space."""

    def __init__(self, texts: list[bytes | None], width: int):
        buffer = np.frombuffer(b" ".join([b"", *((t or b"") for t in texts), b""]), np.uint8)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(lengths + 1))) + 1  # where each text begins in the buffer
        space = _SPACE[buffer]
        edges = np.diff(space.view(np.int8))
        starts = np.flatnonzero(edges == -1) + 1
        self.first = np.searchsorted(starts, at)  # first word of each text
        size = np.flatnonzero(edges == 1) + 1 - starts
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] = False
        self.buffer = np.where(space[keep], np.uint8(32), buffer[keep])
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.width, self.n_words = width, np.diff(self.first)
        n_windows = np.maximum(0, self.n_words - width + 1)
        self.doc = np.repeat(np.arange(len(texts)), n_windows)
        self.before = np.concatenate(([0], np.cumsum(n_windows)))
        self.start = np.arange(len(self.doc)) - self.before[self.doc]
        _, odd, inverse = _constants()
        self.word_at = self.first[self.doc] + self.start
        self.hashes = _spans(self.word_hashes(), self.word_at, self.word_at + width, odd[1], inverse[1])

    def word_hashes(self) -> np.ndarray:
        """64 bits of each word; those of long words are no polynomial, since long patterns of letters can cancel in one."""
        table, odd, inverse = _constants()
        out = _spans(table[self.buffer], self.starts, self.ends, odd[0], inverse[0])
        long = np.flatnonzero(self.ends - self.starts > LONG)
        if len(long):
            b = self.buffer
            out[long] = [xxhash.xxh3_64_intdigest(b[s:e].tobytes()) for s, e in zip(self.starts[long], self.ends[long], strict=True)]
        return out

    def digests(self, windows: np.ndarray) -> np.ndarray:
        """128 bits of the words of each of some windows, as two columns."""
        raw = memoryview(self.buffer.tobytes())
        lo, hi = self.starts[self.word_at[windows]], self.ends[self.word_at[windows] + self.width - 1]
        made = b"".join([blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)])
        return np.frombuffer(made, np.int64).reshape(-1, 2)

    def words(self, i: int) -> list[bytes]:
        lo, hi = self.first[i], self.first[i + 1]
        b = self.buffer
        return [b[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True)]


def _cut(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with about BLOCK bytes of text, and their texts."""
    texts, lo, size = b.column("text").to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK or i == len(texts) - 1:
            yield b.slice(lo, i + 1 - lo), texts[lo : i + 1]
            lo, size = i + 1, 0


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Hashed]]:
    for b in batches:
        for some, texts in _cut(b):
            yield some, Hashed(texts, width)


def _cells(h: Hashed, row: int, log2_cells: int) -> np.ndarray:
    """The cell of each window in a row of the sketch."""
    x = h.hashes if row == 0 else _mix(h.hashes + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(64 - log2_cells)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], bits: list[Broadcast], width: int, log2_cells: int) -> Iterator[pa.RecordBatch]:
    """This partition's next row of the sketch: per range of cells, those met once and those met more often.

    Flushed whenever it holds 2 ** 21 windows; merging adds what the flushes say. A range's cells are ascending, so
    their differences are what is written: small numbers, which the shuffle compresses.
    """
    held: list[np.ndarray] = []
    n, row = 0, len(bits)

    def flush() -> Iterator[pa.RecordBatch]:
        cell, count = np.unique(np.concatenate(held), return_counts=True)
        part = (cell >> LOG2_RANGE).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        low = (cell & ((1 << LOG2_RANGE) - 1)).astype(np.int64)
        more = count > 1

        def packed(x: np.ndarray) -> bytes:
            return np.diff(x, prepend=0).astype("<u2").tobytes()

        rows = [(int(part[a]), packed(low[a:b][~more[a:b]]), packed(low[a:b][more[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True)]
        for a in range(0, len(rows), 1024):
            some = rows[a : a + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.binary())], ["part", "once", "more"])

    for _, h in _blocks(batches, width):
        held.append(_cells(h, row, log2_cells)[_estimated(h, bits, log2_cells)].astype(np.uint32))
        n += len(held[-1])
        if n >= 1 << 21:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partitions' sketches of each range of cells (sorted stream) into a bit per cell: two or more."""
    count, at = np.zeros(1 << LOG2_RANGE, np.uint8), None
    out: list[tuple[int, bytes]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "bits"])

    for b in batches:
        for part, once, more in zip(*(b.column(c).to_pylist() for c in ("part", "once", "more")), strict=True):
            if at != part:
                if at is not None:
                    out.append((at, np.packbits(count >= 2).tobytes()))
                    if len(out) >= 256:
                        yield batch()
                        out = []
                at = part
                count[:] = 0
            x = np.cumsum(np.frombuffer(once, "<u2"), dtype=np.int64)
            count[x] = np.minimum(count[x] + 1, 2)
            count[np.cumsum(np.frombuffer(more, "<u2"), dtype=np.int64)] = 2
    if at is not None:
        out.append((at, np.packbits(count >= 2).tobytes()))
    if out:
        yield batch()


def _estimated(h: Hashed, bits: list[Broadcast], log2_cells: int) -> np.ndarray:
    """Whether each window's estimated count is two or more."""
    ok = np.ones(len(h.doc), bool)
    for row, shared in enumerate(bits):
        x, cell = shared.value, _cells(h, row, log2_cells)
        ok &= (x[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _candidates(batches: Iterator[pa.RecordBatch], bits: list[Broadcast], width: int, log2_cells: int) -> Iterator[pa.RecordBatch]:
    for b, h in _blocks(batches, width):
        at = np.flatnonzero(_estimated(h, bits, log2_cells))
        own = (b.column(c).to_numpy(zero_copy_only=False)[h.doc[at]] for c in ("doc_id", "version"))
        digests = h.digests(at)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1)), *(pa.array(x, pa.int64()) for x in own), pa.array(h.start[at].astype(np.int32))], ["h1", "h2", "doc_id", "version", "start"])


def _remove(batches: Iterator[pa.RecordBatch], bits: list[Broadcast], width: int, log2_cells: int, verbatim: bool, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b, h in _blocks(_opened(batches, carry), width):
        late = _estimated(h, bits, log2_cells)
        listed = b.column("firsts")
        offsets, starts = listed.offsets.to_numpy(), listed.values.to_numpy()
        late[np.repeat(h.before[: b.num_rows], np.diff(offsets)) + starts[offsets[0] : offsets[-1]]] = False
        late[np.asarray(b.column("doc_id").is_null())[h.doc]] = False
        at = h.word_at[late]
        depth = np.zeros(len(h.starts) + 1, np.int32)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        n_removed, texts, raw = [], [], h.buffer.tobytes()
        for i in range(b.num_rows):
            lo, hi = h.first[i], h.first[i + 1]
            g = gone[lo:hi]
            n_removed.append(int(g.sum()))
            edge = np.flatnonzero(np.diff(g, prepend=True, append=True))  # runs of kept words lie between
            texts.append(b" ".join([raw[s:e] for s, e in zip(h.starts[lo + edge[::2]].tolist(), h.ends[lo + edge[1::2] - 1].tolist(), strict=True)]) if hi > lo else b"")
        digests = [sha256(t).hexdigest() for t in texts]
        if verbatim:
            texts = [t if n else whole for t, n, whole in zip(texts, n_removed, b.column("text").to_pylist(), strict=True)]
        columns = {"doc_id": b.column("doc_id"), "n_words": pa.array(h.n_words[: b.num_rows].astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()), "kept_sha256": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_arrays([*columns.values(), *(b.column(c) for c in carry)], [*columns, *carry])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts for the way to their first starts."""
    c = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [None if t is None else c.compress(t) for t in b.column("text").to_pylist()]
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _opened(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in batches:
        packed, lo, size = b.column("text"), 0, 0
        texts: list[bytes | None] = []
        for i, t in enumerate(packed):
            texts.append(None if t.as_py() is None else d.decompress(t.as_py()))
            size += len(texts[-1] or b"")
            if size >= BLOCK or i == b.num_rows - 1:
                same = ["doc_id", "firsts", *carry]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, i + 1 - lo) for c in same), pa.array(texts, pa.binary())], [*same, "text"])
                texts, lo, size = [], i + 1, 0


def sketch(docs: DataFrame, width: int, log2_cells: int) -> list[Broadcast]:
    """The merged sketch, a broadcast for each row, a bit per cell. Its size is fixed by the parameters, whatever the input's."""
    spark, step = docs.sparkSession, 1 << LOG2_RANGE >> 3
    bits: list[Broadcast] = []
    with Scratch(spark) as scratch:
        for _ in range(ROWS):
            found = docs.mapInArrow(partial(_sketch, bits=bits, width=width, log2_cells=log2_cells), "part int, once binary, more binary")
            merged = scratch.keep(found.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "part int, bits binary"), "window-sketch")
            row = np.zeros(1 << log2_cells >> 3, np.uint8)
            for r in merged.toLocalIterator():
                row[r.part * step : (r.part + 1) * step] = np.frombuffer(r.bits, np.uint8)
            bits = [*bits, spark.sparkContext.broadcast(row)]
            del row
            scratch.drop("window-sketch")
    return bits


def substring_dedup(docs: DataFrame, width: int = WIDTH, log2_cells: int = LOG2_CELLS, verbatim: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for every row of docs(doc_id, text).

    verbatim: kept_text is the text as it was, white space and null too, where no word is removed. carry: further
    columns of docs that come along, so that nobody has to join the texts back by doc_id.
    """
    if not LOG2_RANGE <= log2_cells <= 31:
        raise ValueError(f"log2_cells must be {LOG2_RANGE} to 31")
    spark = docs.sparkSession
    prepare(spark)
    held = tuple(f"_{k}" for k in range(len(carry)))  # names that clash with none of the operator's own
    kinds = {h: docs.schema[c].dataType.simpleString() for h, c in zip(held, carry, strict=True)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *(F.col(c).alias(h) for h, c in zip(held, carry, strict=True)))
    # version tells apart the texts of one doc_id; it is 0 for nearly all, which costs the shuffles next to nothing
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    docs = docs.join(repeated, "doc_id", "left").select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("version"), "text", *held)
    named = docs.where("doc_id IS NOT NULL").drop(*held)
    bits = sketch(named, width, log2_cells)
    own = {"bits": bits, "width": width, "log2_cells": log2_cells}
    found = named.mapInArrow(partial(_candidates, **own), "h1 long, h2 long, doc_id long, version long, start int")
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"))
    # a document's first starts are at most as many as its words
    by_doc = firsts.select("first.*").groupBy("doc_id", "version").agg(F.collect_list("start").alias("firsts"))
    more = "".join(f", {h} {kind}" for h, kind in kinds.items())
    joined = docs.mapInArrow(_squeezed, f"doc_id long, version long, text binary{more}").join(by_doc, ["doc_id", "version"], "left")
    out = joined.mapInArrow(partial(_remove, **own, verbatim=verbatim, carry=held), f"doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string{more}")
    return out.withColumn("kept_text", F.col("kept_text").cast("string")).withColumnsRenamed(dict(zip(held, carry, strict=True)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
