"""The validation command and its exit status; answers of bounded size."""

from __future__ import annotations

import json

from loomlight.__main__ import main
from loomlight.sources import sinks


def test_validate(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"m{i}.ts").write_text(f"export function alpha{i}() {{ return 1; }}\nexport class Beta{i} {{}}\nexport const gamma{i} = 2;\n")
    (src / "empty.ts").write_text("")
    out, table = tmp_path / "r.json", tmp_path / "scores"
    assert main(["validate", str(src), "--json", "--out", str(out), "--scores", f"file://{table}"]) == 0
    r = json.loads(out.read_text())
    assert r["files"] == 4 and r["passed"] and r["provider"] == "mock" and len(r["lowest"]) == 4 and r["raw_tokens"] > 0
    assert spark.read.parquet(f"file://{table}").count() == 4
    assert main(["validate", str(src / "m0.ts"), "--provider", "faulty"]) == 1
    assert "score:" in capsys.readouterr().out
    asked = tmp_path / "asked"
    assert main(["validate", str(src), "--prompts", f"file://{asked}"]) == 0
    questions = spark.read.json(f"file://{asked}")
    assert questions.count() == 16
    questions.selectExpr("path", "prompt_id", "'nothing' AS text").write.json(f"file://{tmp_path}/answers")
    assert main(["validate", str(src), "--answers", f"file://{tmp_path}/answers", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["score"] < 60
    assert main(["validate", str(tmp_path / "none")]) == 2
    assert main(["validate", str(src), "--least", "101"]) == 1


def test_an_answer_is_whole_or_an_error(spark):
    assert len(json.loads(sinks.envelope(lambda: spark.range(5), most=5)["content"])) == 5
    said = sinks.envelope(lambda: spark.range(6), most=5)
    assert said["is_error"] and "more than 5 rows" in said["content"]
    failed = sinks.envelope(lambda: spark.range(1).selectExpr("raise_error('late') AS x"))
    assert failed["is_error"] and "late" in failed["content"]
