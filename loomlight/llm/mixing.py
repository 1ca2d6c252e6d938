"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words
once at no cost and again at rising (convex) costs, up to MAX_COPIES times; each source asks for its quota. A min-cost
flow over patterns and sources, whose size is that of the pattern table, routes the capacity with the fewest
repetitions. A pattern's flow then becomes whole passes over its documents and a rest, for which documents are taken
in a seeded order; the last one is taken in part, so that quotas are met to the word.

The seeded order is cut without sorting a source: hashes are counted in two levels of BUCKETS buckets, pre-aggregated,
and only documents within the one bucket that holds the cut are ordered. The driver sees a row per source and
pattern, never documents; more than MAX_PATTERNS patterns raise an error.

Defined cases: a null text has size 0 and is never taken; null sources are one source, last in order; a source of
size 0 has target 0; repeated rows are documents of their own; ties of the order fall to the smaller size; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, materialize, table

WEIGHTS, MAX_COPIES, SEED, LOG2_BUCKETS, MAX_PATTERNS = (5, 2, 1), 3, 42, 12, 20_000


def targets(sizes: list[int], total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> list[float]:
    """Shares of total by repeating weights; none above `most` times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        unit = rest / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ -= over
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MAX_COPIES) -> list[int]:
    """Words to take of each pattern (sources, size): a min-cost flow by successive shortest paths."""
    n, p = len(quotas), len(patterns)
    source, sink = n + p, n + p + 1
    graph: list[list[int]] = [[] for _ in range(n + p + 2)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, k in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(k)

    layers = []
    for k, (members, size) in enumerate(patterns):
        layers.append(len(to))
        for copy in range(most):
            edge(source, n + k, size, copy * copy)
        for s in members:
            edge(n + k, s, most * size, 0)
    for s, q in enumerate(quotas):
        edge(s, sink, q, 0)
    while True:
        best, by = {source: 0}, {}
        queue, queued = deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if room[e] and best[a] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], by[to[e]] = best[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if sink not in best:
            break
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = to[by[a] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return [sum(room[e + 2 * c + 1] for c in range(most)) for e in layers]


def mix(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, sources, source_size, target, taken) for every row of docs(doc_id, text, source).

    members: array of the sources that a document belongs to; its own source where not given. source_size and target
    are those of the first member. carry: columns of docs that come along as fields of a column `row`; docs, a table,
    is then read again for them, so that no text is shuffled.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(members).alias("sources"), key.alias("h"), "text", *[F.struct(*carry).alias("row")] * bool(carry))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    with Scratch(docs.sparkSession) as scratch:
        sizes = scratch.keep(rows.select("doc_id", size.alias("size"), "sources", "h"), "mix-sizes")
        plan = _plan(sizes, weights, most)
        return _taken(rows, size, plan, ["row"]) if carry else materialize(_taken(sizes, F.col("size"), plan, []), "mix")


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - (level + 1) * LOG2_BUCKETS).bitwiseAND(F.lit((1 << LOG2_BUCKETS) - 1))


def _planned(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """rows with the facts of their pattern; the plan has a row for each, MAX_PATTERNS at most."""
    facts = rows.sparkSession.createDataFrame(plan, "of array<string>, source_size long, target double, passes long, rest long, c0 long, c1 long")
    return rows.join(F.broadcast(facts), F.col("sources").eqNullSafe(F.col("of"))).drop("of")


def _plan(sizes: DataFrame, weights: tuple[int, ...], most: int) -> list[tuple]:
    """For each pattern: sources, source_size, target, whole passes, and for the rest the two buckets in which it ends and what is left of it there."""
    found = sizes.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in found for s in r.sources if s is not None}, key=lambda s: s.encode()) + [None] * any(None in r.sources for r in found)
    number = {s: i for i, s in enumerate(names)}
    total = [0] * len(names)
    for r in found:
        for s in r.sources:
            total[number[s]] += r["size"]
    goal = targets(total, sum(r["size"] for r in found), weights, most)
    flow = route([(tuple(number[s] for s in r.sources), r["size"]) for r in found], [round(t) for t in goal], most)
    plan = []
    for r, f in zip(found, flow, strict=True):
        s = number[r.sources[0]] if r.sources else None
        q, rest = divmod(f, r["size"]) if r["size"] else (0, 0)
        plan.append((r.sources, total[s] if s is not None else 0, goal[s] if s is not None else 0.0, q, rest, None, None))

    # cut the order by buckets of the hash, then the bucket of the cut by finer ones
    before = F.sum("words").over(Window.partitionBy("sources").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    for level in (0, 1):
        some = _planned(sizes, plan).where("rest > 0" if not level else F.col("c0") == _bucket(0))
        sums = some.groupBy("sources", _bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        cut = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest AND before + words >= rest")
        ends = {tuple(r.sources): (r.b, r.rest - r.before) for r in cut.collect()}
        for i, row in enumerate(plan):
            if end := ends.get(tuple(row[0])):
                plan[i] = (*row[:4], end[1], *((end[0], None) if not level else (row[5], end[0])))
    return plan


def _taken(rows: DataFrame, size: Column, plan: list[tuple], carry: list[str]) -> DataFrame:
    """What each row gives. Rows outside the bucket of their pattern's cut need no other row, so only those inside are ordered."""
    placed = _planned(rows, plan)
    b0, b1, c0, c1 = _bucket(0), _bucket(1), F.col("c0"), F.col("c1")
    at_cut = F.coalesce((b0 == c0) & (b1 == c1), F.lit(False))
    early = F.coalesce((b0 < c0) | ((b0 == c0) & (b1 < c1)), F.lit(False))
    outside = placed.where(~at_cut).withColumn("size", size).withColumn("extra", F.when(early, F.col("size")).otherwise(F.lit(0)))
    inside = placed.where(at_cut).withColumn("size", size)
    before = F.sum("size").over(Window.partitionBy("sources").orderBy("h", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(before, F.lit(0)))))
    taken = (F.col("passes") * F.col("size") + F.col("extra")).alias("taken")
    return outside.select("doc_id", "size", "sources", "source_size", "target", taken, *carry).unionAll(inside.select("doc_id", "size", "sources", "source_size", "target", taken, *carry))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("sources")
