"""The content-hash cache over an endless stream: state that is capped, expires and is evicted.

Paths are dealt out to groups by hash, and each group keeps a map of its entries: the stored hash, whether it is still
valid, its hits, and when it was last used. A check of a path that was never stored leaves no entry. An entry that isn't
used for ttl_ms is dropped by the state store; a group over its cap evicts the entries used longest ago, as the batch
cache does. So the state is at most groups * rows entries, whatever number of paths comes by.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass. With a time to live Spark runs batches
without rows for as long as the query lives, so a trigger of what is available now doesn't end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cache import CACHE_ROWS

OUT = "path string, seq long, action string, status string, hits long"
ENTRY = "stored string, live boolean, hits long, at long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class CacheGroup(StatefulProcessor):
    """The entries of a group of paths."""

    def __init__(self, rows: int, ttl_ms: int | None):
        self.rows, self.ttl_ms = rows, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "path string", ENTRY, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        d = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        held, out = {}, []
        for path in d["path"].unique():
            held[path] = self.entries.getValue((path,)) if self.entries.containsKey((path,)) else None
        for path, seq, action, digest in zip(d["path"], d["seq"], d["action"], d["hash"], strict=True):
            digest = None if pd.isna(digest) else digest
            stored, live, hits, _ = held[path] or (None, False, 0, 0)
            if action == "store":
                stored, live, hits, status = digest, True, 0, "stored"
            elif not live:
                status = "miss"
            elif stored is not None and digest is not None and stored != digest:
                live, status = False, "update"
            else:
                hits, status = hits + 1, "hit"
            if held[path] is not None or action == "store":
                held[path] = (stored, live, hits, int(seq))
            out.append((path, seq, action, status, hits))
        for path, entry in held.items():
            if entry is not None:
                self.entries.updateValue((path,), tuple(entry))
        ages = sorted((entry[3], path[0]) for path, entry in self.entries.iterator())
        for _, path in ages[: max(0, len(ages) - self.rows)]:
            self.entries.removeKey((path,))
        yield pd.DataFrame(out, columns=["path", "seq", "action", "status", "hits"])

    def close(self) -> None:
        """Nothing to close."""


def replay_bounded(trace: DataFrame, rows: int = CACHE_ROWS, groups: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """A streaming trace(seq, action, path, hash) plus (status, hits); a batch is replayed in order of seq.

    rows: entries of all groups together; each keeps its share. While nothing is evicted the result is that of
    operators.cache.replay; what is evicted is a miss until it is stored again.
    """
    if "RocksDB" not in (trace.sparkSession.conf.get(PROVIDER, None) or ""):
        raise ValueError(f"{PROVIDER} must name the RocksDB provider")
    d = trace.select(F.pmod(F.xxhash64("path"), F.lit(groups)).alias("group"), "path", "seq", "action", "hash")
    share = max(1, rows // groups)
    return d.groupBy("group").transformWithStateInPandas(CacheGroup(share, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
