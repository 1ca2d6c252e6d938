"""The content-hash cache over a stream of reads and stores: state per path, in time order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "path string, seq long, action string, status string, hits long"
STATE = "stored string, hits long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stored, hits = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, action, digest in zip(rows["seq"], rows["action"], rows["hash"], strict=True):
        if action == "store":
            stored, hits, status = digest, 0, "stored"
        elif stored is None:
            status = "miss"
        elif stored == digest:
            hits, status = hits + 1, "hit"
        else:
            stored, status = None, "update"
        out.append((key[0], seq, action, status, hits))
    state.update((stored, hits))
    yield pd.DataFrame(out, columns=["path", "seq", "action", "status", "hits"])


def replay_stream(trace: DataFrame) -> DataFrame:
    """A streaming trace(seq, action, path, hash) plus (status, hits); a batch is replayed in order of seq."""
    return trace.groupBy("path").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
