"""Health and help: what is installed, what the operators are for, and what each query is for."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

# The topics of the help.
HELP = {
    "compress": "A source file as its signature, structure, summary or whole text, with the tokens saved.",
    "clean": "A JSON text as a table, in compact form, or with listed fields only.",
    "cache": "Views kept by content hash: store, check, statistics, clear.",
    "memory": "Keys and values that outlast a session: read, write, delete, list, clear.",
    "graph": "A symbol graph of a corpus: search, symbols of files, dependencies, dependents, statistics.",
    "report": "A graph report as hubs, map or search results, and whether it is stale.",
    "catalog": "Tools of servers in one line each; whole descriptions on demand.",
    "call": "Responses of calls, compressed where that is smaller.",
    "image": "Pictures as recognised text or in a smaller size.",
    "validate": "How much meaning a compressed view keeps: prompts, scores, a provider's answers.",
    "fidelity": "The share of exported symbols that a compressed view still names.",
    "health": "What is installed, and where tables are kept.",
}


def health(spark: SparkSession) -> DataFrame:
    """(component, status) of the session and of optional libraries."""
    rows = [("spark", spark.version), ("shared folder", spark.conf.get("spark.checkpoint.dir", None) or "none named")]
    rows += [(m, "present" if importlib.util.find_spec(m) else "absent") for m in ("pyarrow", "pandas", "numpy", "tiktoken", "tokenizers", "zstandard", "xxhash")]
    return spark.createDataFrame(rows, "component string, status string")


def help_on(spark: SparkSession, topic: str | None = None) -> DataFrame:
    """(topic, summary) of all topics, or of one; of one that isn't known, a row that lists those that are."""
    rows = list(HELP.items()) if topic is None else [(topic, HELP.get(topic.strip().lower(), f"No such topic. Known are {', '.join(HELP)}."))]
    return spark.createDataFrame(rows, "topic string, summary string")


def topics(spark: SparkSession, queries: dict) -> DataFrame:
    """(topic, summary): the first line of what each query says of itself."""
    rows = [(n, (q.__doc__ or q.__name__.replace("_", " ")).strip().split("\n")[0]) for n, q in sorted(queries.items())]
    return spark.createDataFrame(rows, "topic string, summary string")


def shutdown(spark: SparkSession) -> None:
    """Cancel what runs and end the session."""
    spark.sparkContext.cancelAllJobs()
    spark.stop()
