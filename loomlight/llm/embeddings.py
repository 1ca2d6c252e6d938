"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed random rotation, which spreads any difference evenly over the
coordinates. Cosine >= c means a squared distance of at most T = 2 - 2c. The rotated vector is cut into BLOCKS
low-dimensional blocks; by the pigeonhole principle some block holds at most its proportional share, T / BLOCKS, of
the squared distance. Each block is range-joined under that budget by a grid whose cells are twice the budget's radius
wide: every vector is stored in one cell and asked for in each cell that its ball touches. The union of candidates is
verified exactly, by cosine in double precision on the original vectors. A pair is counted in the first block that
meets the budget only, so counts need no distinct over pairs.

The grid works at two levels. Within a task it runs over all coordinates of a block, so the comparisons of a task grow
far more slowly than the square of its vectors. Between tasks a label's vectors are dealt out by counted size: up to
LEVELS[0] vectors as pairs of chunks, a row a chunk, with all blocks joined in the task; beyond that by cells over as
many coordinates as LEVELS says, a row for each cell asked for. (Rows are what costs: one carries a whole vector.)

No join sends a table that grows with the input to all tasks, whatever its compressed size says: only labels' levels and
cells' sizes, while they are few. So the driver holds no rows.

Exact copies collapse into one class first. Dense cells are dealt out as pairs of chunks; tasks return a count per
vector and the spanning forest of the links, never the pairs, so no link is lost and rows stay in proportion.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
label or vec_id, link with nothing (n_links 0, component of their own); vectors of unlike length never link; repeated vec_ids
are copies of one another when label and vector agree; components of any finite size are compared, since vectors are
scaled first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, gathered, materialize, prepare, sent, shuffled, table

MIN_COSINE, BLOCKS, CHUNK = 0.98, 8, 4096
#: Coordinates of a block that the cells between tasks use, by the number of a label's vectors.
LEVELS = {1 << 18: 0, 1 << 22: 4, 1 << 62: 8}
#: Parts of fewer comparisons than this are compared all to all; candidates that are verified at once.
SMALL, SLICE = 1 << 15, 1 << 19
#: Multiplier of the cells' numbers: cells that share a number by chance cost comparisons, never a pair.
PRIME = 0x9E3779B97F4A7C15 - (1 << 64)
#: Widens every budget a little, so that rounding can't lose a pair; the exact check decides.
SLACK = 1e-6


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(unit: np.ndarray, blocks: int) -> list[np.ndarray]:
    return np.array_split(unit @ rotation(unit.shape[1]), min(blocks, unit.shape[1]), axis=1)


def _radius(budget: float, block: int, dims: int) -> float:
    return float(np.sqrt(budget * block / dims)) + SLACK


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _homes(y: np.ndarray, radius: float) -> np.ndarray:
    """Number of each row's cell in the grid over all columns of y."""
    key = np.zeros(len(y), np.int64)
    for d in range(y.shape[1]):
        key = key * PRIME + np.floor(y[:, d] / (2 * radius)).astype(np.int64)
    return key


def _asks(y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for all cells that the ball around each row touches; cells are as wide as the ball.

    Coordinates are taken in turn; a cell is given up as soon as its distance exceeds the radius.
    """
    row, key, far = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
    for d in range(y.shape[1]):
        at = y[row, d] / (2 * radius)
        cell = np.floor(at).astype(np.int64)
        low, high = (at - cell) * 2 * radius, (cell + 1 - at) * 2 * radius
        rows, keys, fars = [row], [key * PRIME + cell], [far]
        for gap, by in ((low, -1), (high, 1)):
            to = far + gap * gap
            there = to <= radius * radius
            rows.append(row[there])
            keys.append((key * PRIME + cell + by)[there])
            fars.append(to[there])
        row, key, far = np.concatenate(rows), np.concatenate(keys), np.concatenate(fars)
    return row, key


def _cells(frames: Iterator[pd.DataFrame], budget: float, blocks: int) -> Iterator[pd.DataFrame]:
    """Store each class in one cell of each block, and ask for it in all cells that its ball touches."""
    for f in frames:
        for (size, level), g in f.groupby([f["v"].map(len), "level"]):
            label, node = g["label"].to_numpy(), g["node"].to_numpy()
            out = []
            for b, y in enumerate(_blocks(_unit(_vectors(g["v"])), blocks)):
                radius, y = _radius(budget, y.shape[1], size), y[:, :level]
                row, key = _asks(y, radius)
                out.append(pd.DataFrame({"label": label[row], "block": b, "cell": key, "stored": key == _homes(y, radius)[row], "node": node[row]}))
            yield pd.concat(out, ignore_index=True)


def _join(frames: Iterator[pd.DataFrame], budget: float, min_cosine: float, blocks: int) -> Iterator[pd.DataFrame]:
    """Compare the stored and asking vectors of each part; a row per link of the forest, and per vector its count."""
    keys = ["label", "block", "cell", "part"]
    for f in gathered(frames, keys, CHUNK):
        for (_, block, _, _), g in f.groupby(keys, sort=False):
            if len(g) < 2 or not g["stored"].any():
                continue
            for _, h in g.groupby(g["v"].map(len)):
                yield from _part(h, int(block), budget, min_cosine, blocks)


def candidates(y: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices (p, q) of pairs of i and j that hold all pairs of rows of y within the radius: those of a cell."""
    if len(i) * len(j) <= SMALL:
        yield np.repeat(i, len(j)), np.tile(j, len(i))
        return
    home = _homes(y[i], radius)
    order = np.argsort(home, kind="stable")
    home, i = home[order], i[order]
    slot = lambda key: (key * PRIME >> 46) & 0x3FFFF
    taken = np.zeros(1 << 18, bool)  # most cells asked for hold nothing
    taken[slot(home)] = True
    for at in range(0, len(j), CHUNK // 4):
        some = j[at : at + CHUNK // 4]
        row, key = _asks(y[some], radius)
        held = taken[slot(key)]
        row, key = row[held], key[held]
        lo = np.searchsorted(home, key, "left")
        n = np.searchsorted(home, key, "right") - lo
        row, lo, n = row[n > 0], lo[n > 0], n[n > 0]
        cut = 0
        ends = np.cumsum(n)
        while cut < len(n):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + SLICE, "right")))
            k = n[cut:to]
            first = np.repeat(lo[cut:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            yield i[first], np.repeat(some[row[cut:to]], k)
            cut = to


def _part(g: pd.DataFrame, block: int, budget: float, min_cosine: float, blocks: int) -> Iterator[pd.DataFrame]:
    left, right, node, size = g["stored"].to_numpy() & g["left"].to_numpy(), g["right"].to_numpy(), g["node"].to_numpy(), g["size"].to_numpy()
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    if not len(i) or not len(j):
        return
    x = _vectors(g["v"])
    x /= np.abs(x).max(axis=1, keepdims=True)
    y = _blocks(_unit(x), blocks)
    shares = [_radius(budget, z.shape[1], x.shape[1]) ** 2 for z in y]

    def squared(b: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = y[b][p] - y[b][q]
        return np.einsum("ij,ij->i", d, d)

    length = np.sqrt((x * x).sum(axis=1))
    n, label = np.zeros(len(g), np.int64), np.arange(len(g))
    for b in range(len(y)) if block < 0 else [block]:
        for p, q in candidates(y[b], i, j, np.sqrt(shares[b])):
            keep = node[p] < node[q]
            p, q = p[keep], q[keep]
            keep = squared(b, p, q) <= shares[b]
            p, q = p[keep], q[keep]
            for c in range(b):  # counted there already
                keep = squared(c, p, q) > shares[c]
                p, q = p[keep], q[keep]
            keep = (x[p] * x[q]).sum(axis=1) / (length[p] * length[q]) >= min_cosine
            p, q = p[keep], q[keep]
            np.add.at(n, p, size[q])
            np.add.at(n, q, size[p])
            new = label[p] != label[q]
            if new.any():
                label = forest(np.concatenate((np.arange(len(g)), p[new])), np.concatenate((label, q[new])), len(g))
    hit = np.flatnonzero(n)
    if len(hit):
        yield pd.DataFrame({"u": node[hit], "v": node[label[hit]], "n": n[hit]}).groupby(["u", "v"], as_index=False).sum()


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, blocks: int = BLOCKS, levels: dict[int, int] = LEVELS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    budget = 2 - 2 * min_cosine
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", "label", F.when(sound, F.col("v")).alias("v"))
    with Scratch(vectors.sparkSession) as scratch:
        classes = scratch.keep(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "vector-classes")
        kind = classes.schema["label"].dataType.simpleString()
        level = F.coalesce(*(F.when(F.col("c") <= most, level) for most, level in sorted(levels.items())))
        counted = classes.groupBy("label").agg(F.count("*").alias("c")).select("label", level.alias("level"))
        leveled = classes.join(sent(scratch.keep(counted, "vector-levels")), "label")
        gridded = leveled.where("level > 0").select("label", "v", "node", "level").mapInPandas(partial(_cells, budget=budget, blocks=blocks), f"label {kind}, block int, cell long, stored boolean, node long")
        whole = leveled.where("level = 0").select("label", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("stored"), "node")
        cells = scratch.keep(whole.unionAll(gridded), "vector-cells")
        where = ["label", "block", "cell"]
        sizes = cells.groupBy(where).agg(F.count("*").alias("c"), F.max("stored").alias("any")).where("any AND c > 1").select(*where, F.ceil(F.col("c") / CHUNK).cast("int").alias("n"))
        sizes = scratch.keep(sizes, "vector-sizes")
        # chunk pairs (i, j): chunk i's stored vectors meet all vectors of chunk j
        own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
        dealt = cells.join(sent(sizes), where).withColumn("own", own)
        parts = F.expr("array_distinct(flatten(transform(sequence(0, n - 1), j -> IF(stored, array(own * n + j, j * n + own), array(j * n + own)))))")
        dealt = dealt.withColumn("part", F.explode(parts)).select(*where, "part", "stored", "node", (F.expr("part div n") == F.col("own")).alias("left"), (F.col("part") % F.col("n") == F.col("own")).alias("right"))
        dealt = dealt.join(shuffled(classes.select("node", "v", "size")), "node")
        found = scratch.keep(dealt.repartition(*where, "part").sortWithinPartitions(*where, "part").mapInPandas(partial(_join, budget=budget, min_cosine=min_cosine, blocks=blocks), "u long, v long, n long"), "vector-links")
        named = components(found.select("u", "v"), scratch, "vector-components")
        counts = found.groupBy("u").agg(F.sum("n").alias("n"))
        per_class = classes.join(shuffled(counts), F.col("node") == F.col("u"), "left").drop("u").join(shuffled(named), "node", "left").select("label", "v", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
        out = rows.join(shuffled(per_class), ["label", "v"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
        return materialize(out, "near-vectors")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
