"""Costly columns are made once a row, by enough tasks, whatever is asked of them afterwards."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomlight.functions.scanners import scan
from loomlight.functions.signatures import by_lines, structure_view
from loomlight.operators import scores as V
from loomlight.plans import catalogue, code
from loomlight.sources import shared

PARTS = 6000


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A table of one split whose rows are worth more than one task."""
    at = tmp_path_factory.mktemp("many")
    n = range(PARTS)
    pq.write_table(pa.table({"p_partkey": list(n), "p_name": ["a b"] * PARTS, "p_type": ["T"] * PARTS, "p_size": pa.array([i % 50 for i in n], pa.int32())}), at / "part.parquet")
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["long_structure_views", "worst_fidelity", "recall_histogram", "symbol_fidelity", "fidelity_gate", "line_signatures", "function_names", "parsed_imports", "language_rollup", "scan_typescript", "scan_python", "scan_javascript", "scan_csharp", "scan_html", "scan_java", "cleaned_toon"])
def test_rows_are_spread_before_costly_work(spark, many, name):
    text = plan(catalogue.QUERIES[name](spark, many))
    reads = text[text.rindex("hashpartitioning(p_partkey") :]
    assert "FileScan" in reads and not re.search(r"Generate|_scanned|regexp", reads)
    assert text.count("ArrowEvalPython") <= 1


def test_a_graph_is_built_from_spread_rows(spark, many):
    assert spark.read.parquet(f"{many}/part.parquet").rdd.getNumPartitions() == 1
    assert code.files(spark, many).rdd.getNumPartitions() == -(-PARTS // shared.LEAST)


def test_filters_do_not_repeat_what_they_judge(spark, many):
    text = plan(V.fidelity(code.files(spark, many).withColumn("compressed", F.lit("x"))).where("recall < 1"))
    assert not [line for line in text.splitlines() if "Filter" in line and "regexp_extract_all" in line]


def test_spread_keeps_every_row(spark):
    d = spark.range(7 * shared.LEAST)
    assert shared.spread(d, "id").distinct().count() == 7 * shared.LEAST and shared.spread(spark.range(3)).rdd.getNumPartitions() == d.rdd.getNumPartitions()


def test_views_name_their_parts_once(spark):
    text = plan(spark.createDataFrame([("a: 1",)], "c string").select(structure_view(F.col("c"), F.lit("yaml"), by_lines(F.col("c"), F.lit("yaml")))))
    assert len(text) < 20_000


def test_declarations_in_any_statement():
    source = "try:\n    import a\nexcept E:\n    from b import c\nelse:\n    def f(x): pass\nfinally:\n    class K: pass\nmatch y:\n    case 1:\n        async def g(): return lambda: 0\nfor i in z:\n    with w:\n        if i:\n            pass\n        else:\n            def h(): pass\n"
    assert scan(source, "python") == {"imports": ["import a", "from b import c"], "exports": [], "functions": ["def f(x)", "def g()", "def h()"], "classes": ["class K"]}
