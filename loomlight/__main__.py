"""Commands: `python -m loomlight validate ROOT` checks how much meaning compressed views of a folder's files keep.

The exit status is 0 if the mean score reaches the least one, 1 if it doesn't, 2 if the check can't be made.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scores as V
from .sources import sinks
from .sources.files import MAX_BYTES, read_files
from .sources.shared import cut


def _arguments(given: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomlight", description=__doc__.split("\n")[0])
    v = p.add_subparsers(dest="command", required=True).add_parser("validate", help="score compressed views")
    v.add_argument("root", help="a source file, or a folder that driver and executors see")
    how = v.add_mutually_exclusive_group()
    how.add_argument("--provider", choices=sorted(V.PROVIDERS), default="mock", help="who answers the questions")
    how.add_argument("--answers", help="a JSON-lines file or folder of path, prompt_id and text to score instead")
    how.add_argument("--prompts", help="write the questions to this folder as JSON lines, and score nothing")
    v.add_argument("--least", type=int, default=V.VERDICTS[2][0], help="the mean score that passes")
    v.add_argument("--json", action="store_true", help="a report in JSON instead of text")
    v.add_argument("--out", help="write the report to this file instead of standard output")
    v.add_argument("--scores", help="write the scores of every file to this folder as Parquet")
    return p.parse_args(given)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a folder's source files, or of one file."""
    path = os.path.abspath(os.path.expanduser(root))
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} doesn't exist")
    if os.path.isdir(path):
        return read_files(spark, path, most=None).select("path", "content").where("content IS NOT NULL")
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    return spark.read.text(f"file://{path}", wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("content"))


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    truth = cut(V.ground_truth(_files(spark, a.root)), "ground-truth")
    if a.prompts:
        V.questions(truth).write.json(a.prompts)
        return 0
    if a.answers:
        given = spark.read.schema("path string, prompt_id string, text string").json(a.answers)
        scored = V.validate(truth, "score", given)
    else:
        scored = V.validate(truth, "run", by=a.provider)
    scored = cut(scored, "scores")
    if a.scores:
        scored.write.parquet(a.scores)
    if a.json:
        tokens = truth.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_tokens", "view_tokens")]).first()
        report = {"root": a.root, "provider": "answers" if a.answers else a.provider, **tokens.asDict(), **V.summary(scored, a.least)}
        text, status = json.dumps(report, ensure_ascii=False, indent=2), int(not report["passed"])
    else:
        text, status = V.report(scored, a.least)
    sinks.write_report(text + "\n", a.out)
    return status


def main(given: list[str] | None = None) -> int:
    a = _arguments(given)
    spark = SparkSession.builder.appName("loomlight").getOrCreate()
    try:
        return validate(spark, a)
    except (OSError, ValueError) as e:
        sinks.logger().error("%s", e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
