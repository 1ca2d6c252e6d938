"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Results are written and reread between the stages, so each starts from a table and a lost executor costs
a re-read only.

Defined cases are those of the operators: null texts fail the quality base; documents without doc_id, to which no
decision can refer, leave with the near copies; rows that repeat a doc_id are one document from the first stage on,
the smallest by text, language, source and length, a null text last; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.llm import mixing, near_copies, packing, quality, substrings
from loomlight.llm.common import Scratch, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the learned rules nor the packing.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _one_row(docs: DataFrame) -> DataFrame:
    """One row for each doc_id; only the rows of repeated ones are shuffled."""
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    order = F.struct(F.col("text").isNull(), "text", "lang", "source", "n_chars")
    rows = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(order).alias("row"))
    return _columns(docs.join(repeated, "doc_id", "left_anti")).unionByName(_columns(rows.select("doc_id", "row.*")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned decision list keep."""
    docs = _one_row(docs)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.judge(docs, rules).where("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies."""
    groups = near_copies.near_copies(docs)
    return _columns(_columns(docs).join(groups.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start earlier; a document that loses all its words goes."""
    kept = substrings.substring_dedup(docs, verbatim=True, carry=("lang", "source")).where("kept_text <> '' OR n_removed = 0")
    return _columns(kept.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one document of a source that is taken in part, if over half."""
    taken = mixing.mix(docs, carry=tuple(COLUMNS))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    taken = taken.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select("row.*")


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_sources),
    ("packing", packing_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ""
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(before)
            before = f"pipeline-{name}"
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
