"""Where results go: the Markdown report of a benchmark, error envelopes, and the log."""

from __future__ import annotations

import json
import logging
import os
import sys
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import scores as V

#: Files of a report, and rows that one answer may hold.
TOP, MOST_ROWS = 10, 10_000


def _table(df: DataFrame, titles: list[str]) -> list[str]:
    return [f"| {' | '.join(titles)} |", "|" + "---|" * len(titles), *(f"| {' | '.join(map(str, r))} |" for r in df.collect())]


def benchmark_report(measured: DataFrame, target: str, seconds: float) -> str:
    """A Markdown report of measured(path, language, original_tokens, optimized_tokens).

    Savings in all and their price, those of each language, and the TOP files by size. Only aggregates reach the driver.
    """
    t = V.totals(measured).first()
    shown = lambda c: M.human_tokens(F.col(c)).alias(c)
    sized = ["original_tokens", "optimized_tokens"]
    percent = F.concat(M.percent_saved(F.col(sized[0]), F.col(sized[1])).cast("string"), F.lit("%")).alias("saved")
    whole = V.totals(measured).select(*map(shown, sized), percent)
    by_language = V.rollup(measured).orderBy(F.desc("original_tokens"), "language").select("language", "files", *map(shown, sized), percent)
    largest = measured.orderBy(F.desc("original_tokens"), "path").limit(TOP).select("path", "language", *map(shown, sized), percent)
    prices = [f"- {name}: ${price} per million tokens, ${t[f'saved_{name}']:.4f} saved" for name, price in M.PRICES.items()]
    rate = t.files / seconds if seconds > 0 else 0
    parts = [
        ["# Compression benchmark", "", f"Target: `{target}`", f"Files: {t.files}", f"Wall time: {seconds * 1000:.0f} ms ({rate:.0f} files a second)"],
        ["## Savings", "", *_table(whole, ["Original tokens", "Compressed tokens", "Saved"]), "", *prices],
        ["## Languages", "", *_table(by_language, ["Language", "Files", "Original tokens", "Compressed tokens", "Saved"])],
        [f"## The {TOP} largest files", "", *_table(largest, ["File", "Language", "Original tokens", "Compressed tokens", "Saved"])],
    ]
    return "\n\n".join("\n".join(p) for p in parts) + "\n"


def write_report(text: str, out: str | None = None) -> None:
    """To a file, or to standard output where none is named."""
    if out is None:
        sys.stdout.write(text)
        return
    with open(os.path.expanduser(out), "w", encoding="utf-8") as f:
        f.write(text)


def _rows(result: DataFrame, most: int) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in result.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the result has more than {most} rows; write it as a table instead")
    return rows


def envelope(call: Callable[[], object], most: int = MOST_ROWS) -> Mapping[str, object]:
    """What a client gets of a call: its result as text, or its error, marked as one.

    A frame is evaluated here, so its failures are answers too. One of more than `most` rows is an error, never cut.
    """
    try:
        result = call()
        if isinstance(result, DataFrame):
            result = _rows(result, most)
    except Exception as e:  # noqa: BLE001  any failure is the client's answer
        return {"content": json.dumps({"error": str(e)}), "is_error": True}
    return {"content": result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, default=str), "is_error": False}


def logger(level: str = "info", quiet: bool = False) -> logging.Logger:
    """The library's log on standard error, at debug, info, warn or error; quiet suppresses all of it."""
    out = logging.getLogger("loomlight")
    for h in list(out.handlers):
        out.removeHandler(h)
    handler = logging.NullHandler() if quiet else logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("[loomlight] %(levelname)s %(message)s"))
    out.addHandler(handler)
    out.propagate = False
    out.setLevel({"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}[level])
    return out
