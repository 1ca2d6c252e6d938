"""Periodic runs of words by block matching: aligned blocks of power-of-two length, searched across their document.

A run is a maximal stretch with smallest period q, at least max(SHORTEST, TIMES * q) words long. With B the power of
two such that B <= q < 2B, the first aligned block of B words inside the run occurs again q words later, still inside
it. So for each scale B the document's aligned blocks become integer-sequence keys of a pyahocorasick automaton (the
numbers of a block's two halves, found at the scale before), which finds every occurrence of every block in one pass
over the document; an occurrence at a distance d of B to 2B - 1 words behind its block is a seed, and a seed is extended
word by word to both sides while words d apart are identical. A stretch that is long enough is a run, once for its
smallest period. (Whole blocks as keys would be walked once for each word of a block where a document repeats one word:
the library follows all failure links.)

Seeds that can't give a new run are passed over, with proof: those inside a run of a smaller scale (whose period then
divides d); those inside a stretch of the same distance already extended; and those whose block and occurrence lie in
two runs of period up to B / 2 that start and end at other distances than d (a stretch of period d that leaves the
first run must leave the second one d words later). So a block has few seeds that are extended, and the work of a scale
grows with the document, also where one word fills it.

Before that, words that no run can hold are taken out, for all documents of a batch at once: within a run every pair of
neighbouring words occurs three times at least, so stretches of pairs that occur so often remain, ROUNDS times anew
within each stretch. This only splits documents into smaller ones to be searched; what remains is searched whole.

Work is by row: no shuffle, no skew. Memory is some hundred bytes a word of the longest document.

Defined cases: a null, empty or blank text has no words and no runs; repeated rows and ids are judged each on their own;
of equally long runs the contract's query names the first to start, then the smaller period; a very long text is one
document like any other; other columns are dropped but the keys; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, prepare, table

#: Least words of a run, least multiple of its period, and rounds of the split by frequent pairs.
SHORTEST, TIMES, ROUNDS = 6, 4, 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"



def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def candidates(code: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which no run has a word. Documents are parts, in turn; they share no codes."""
    often = np.bincount(code)[code] >= TIMES if len(code) else np.zeros(0, bool)
    at = np.flatnonzero(often[:-1] & often[1:] & (part[1:] == part[:-1]))
    pair = _numbered(code[at] * (len(code) + 1) + code[at + 1])
    stretch = np.zeros(len(at), np.int64)
    for _ in range(ROUNDS):
        key = _numbered(stretch * (len(code) + 1) + pair)
        keep = np.bincount(key)[key] >= TIMES - 1 if len(key) else np.zeros(0, bool)
        at, pair = at[keep], pair[keep]
        size = np.diff(np.flatnonzero(np.diff(at, prepend=-2, append=-2) != 1))
        enough = size >= SHORTEST - 1
        at, pair, size = at[np.repeat(enough, size)], pair[np.repeat(enough, size)], size[enough]
        stretch = np.repeat(np.arange(len(size)), size)
    till = np.cumsum(size)
    return list(zip(at[till - size].tolist(), (at[till - 1] + 2).tolist(), strict=True))


class Known:
    """Runs (start, end, period) found so far; says which of them holds a stretch."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        r = np.array(sorted(runs), np.int64).reshape(-1, 3)
        self.start, self.end = r[:, 0], r[:, 1]
        furthest = np.maximum.accumulate(self.end)
        self.best = np.maximum.accumulate(np.where(self.end == furthest, np.arange(len(r)), 0))

    def holder(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A run that holds [a, b), else -1: the one that ends last of those that start by a."""
        if not len(self.start):
            return np.full(len(a), -1)
        at = np.searchsorted(self.start, a, "right") - 1
        run = self.best[np.maximum(at, 0)]
        return np.where((at >= 0) & (self.end[run] >= b), run, -1)


def doubled(here: np.ndarray, block: int) -> np.ndarray:
    """From the aligned block that occurs at each place (0: none of them) to those of twice the length.

    A block is the key of its two halves' numbers. The document is searched in strides of a half, one residue after the
    other, so keys have two letters and every place is searched once.
    """
    n, rows = len(here), -(-len(here) // block)
    aligned = np.arange(0, n - 2 * block + 1, 2 * block)
    automaton, number = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    for key in zip(here[aligned].tolist(), here[aligned + block].tolist(), strict=True):
        if key not in number:
            automaton.add_word(key, number.setdefault(key, len(number) + 1))
    automaton.make_automaton()
    strides = np.zeros((block, rows + 1), np.int64)  # a 0 after each, which no key has
    strides[:, :rows] = np.pad(here, (0, rows * block - n)).reshape(rows, block).T
    hits = np.fromiter((v for hit in automaton.iter(tuple(strides.ravel().tolist())) for v in hit), np.int64).reshape(-1, 2)
    residue, step = np.divmod(hits[:, 0], rows + 1)
    out = np.zeros(n, np.int64)
    out[(step - 1) * block + residue] = hits[:, 1]
    return out


def seeds(here: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, d): the aligned block at p occurs again at p + d, block <= d < 2 * block."""
    x = block + np.flatnonzero(here[block:])
    p = (x // block - 1) * block
    ok = here[p] == here[x]
    return p[ok], (x - p)[ok]


def extend(code: np.ndarray, p: int, d: int, block: int) -> tuple[int, int]:
    """The stretch [a, b) in which words d apart are identical, around the block at p."""
    a, b, last, step = p, p + block, len(code) - d, 16
    while b < last:
        z = min(b + step, last)
        differ = np.flatnonzero(code[b:z] != code[b + d : z + d])
        if len(differ):
            b += int(differ[0])
            break
        b, step = z, step * 2
    step = 16
    while a > 0:
        y = max(a - step, 0)
        differ = np.flatnonzero(code[y:a] != code[y + d : a + d])
        if len(differ):
            a = y + int(differ[-1]) + 1
            break
        a, step = y, step * 2
    return a, b + d


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's word numbers, by start, then period."""
    code = _numbered(words)
    here, block, found = code + 1, 1, {}
    while len(code) >= max(SHORTEST, TIMES * block):
        if block > 1:
            here = doubled(here, block // 2)
        p, d = seeds(here, block)
        new = Known([(*at, q) for at, q in found.items()]).holder(p, p + d + block) < 0
        p, d = p[new], d[new]
        small = Known([(*at, q) for at, q in found.items() if 2 * q <= block])
        one, two = small.holder(p, p + block), small.holder(p + d, p + d + block)
        if len(small.start):
            apart = (small.start[two] - small.start[one] != d) & (small.end[two] - small.end[one] != d)
            new = ~((one >= 0) & (two >= 0) & apart)
            p, d = p[new], d[new]
        order = np.lexsort((p, d))
        of, till = 0, 0
        for at, distance in zip(p[order].tolist(), d[order].tolist(), strict=True):
            if distance == of and at + block + of <= till:
                continue
            of, (a, till) = distance, extend(code, at, distance, block)
            if till - a >= max(SHORTEST, TIMES * of):
                found.setdefault((a, till), of)
        block *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [(text or "").encode().split() for text in b.column("text").to_pylist()]
        codes, n = [np.zeros(0, np.int64)], 0
        for of in words:
            seen: dict[bytes, int] = {}
            codes.append(np.fromiter([seen.setdefault(w, n + len(seen)) for w in of], np.int64, len(of)))
            n += len(seen)
        code, size = np.concatenate(codes), np.array([len(of) for of in words], np.int64)
        first = np.cumsum(size) - size
        found: dict[int, list[tuple[int, int, int]]] = {}
        part = np.repeat(np.arange(len(words)), size)
        for a, z in candidates(code, part):
            found.setdefault(int(part[a]), []).extend((a - int(first[part[a]]) + s, length, q) for s, length, q in runs_of(code[a:z]))
        for doc, runs in found.items():
            gone = np.zeros(len(words[doc]) + 1, np.int64)
            for s, length, q in runs:
                gone[s + q] += 1
                gone[s + length] -= 1
            words[doc] = [w for w, g in zip(words[doc], np.cumsum(gone).tolist(), strict=False) if not g]
        n_runs = [len(found.get(doc, ())) for doc in range(len(words))]
        columns = list(zip(*(r for doc in range(len(words)) for r in found.get(doc, ())), strict=True)) or [()] * 3
        structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))), pa.int32()), structs)
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists, pa.array([b" ".join(of).decode() for of in words], pa.string())], [*names, "runs", "collapsed"])


def runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys of docs, the runs of its column text by start and period, and the text with each run cut to one period.

    collapsed: the words that no run holds after its first period, joined by one space.
    """
    prepare(docs.sparkSession)
    some = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{n}` {some.schema[n].dataType.simpleString()}" for n in keys)
    return some.mapInArrow(_runs, f"{schema}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text); of a document in ten, by its id's hash, the words from some place on repeat a first few."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    d = d.select("doc_id", "text", "g", "w", F.size("w").cast("long").alias("n")).select("*", F.expr("CASE WHEN n > 0 THEN g % n END AS a"))
    d = d.select("*", F.expr("1 + (n - a) div (3 + g % 8) AS p"))
    again = "slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))"
    return d.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN array_join(concat(slice(w, 1, int(a)), {again}), ' ') ELSE text END AS text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runs(planted(table(spark, sf_dir, "documents")))
    d = d.select("doc_id", "runs", "collapsed", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))) AS longest"))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-longest.start AS start"),
        F.expr("longest.length AS length"),
        F.expr("-longest.period AS period"),
        F.expr("1000 * longest.length div -longest.period AS exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) AS runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
