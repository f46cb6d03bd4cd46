"""Documents as a source, run artefacts as a sink."""

import json
import os

import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims as claim_rows
from claimloom.sources import files


def test_document_files(spark, tmp_path):
    root = tmp_path / "docs"
    for folder in ("a/b", "node_modules", ".git"):
        (root / folder).mkdir(parents=True)
    for name, data in {"a/one.md": b"One.", "a/b/two.txt": b"bad \xff", "a/three.py": b"code", "node_modules/four.md": b"x", ".git/five.md": b"x", "six.rst": "é".encode(), "md": b"no suffix"}.items():
        (root / name).write_bytes(data)
    (root / "gone.md").symlink_to(root / "nowhere.md")
    (root / "again.md").symlink_to(root / "a" / "one.md")
    read = lambda *paths, **kw: {os.path.relpath(r["path"], root): (r["text"], r["error"]) for r in files.document_files(spark, *map(str, paths), **kw).collect()}
    got = read(root, root / "a", f"file:{root}/six.rst", files=2)
    assert got.pop("nowhere.md")[0] is None and got == {"a/one.md": ("One.", None), "a/b/two.txt": ("bad �", None), "six.rst": ("é", None)}
    assert files.document_files(spark, str(root), str(root)).count() == 4
    assert read(root / "a" / "three.py") == {"a/three.py": ("code", None)}  # named, so read whatever its suffix
    assert read(root / "a", strict=True)["a/b/two.txt"] == (None, "not UTF-8 at byte 4")
    assert "FileNotFoundError" in files.document_files(spark, str(root)).where("error is not null").first()["error"]
    assert read(root / "a", suffixes=("py",)) == {"a/three.py": ("code", None)}
    assert read(root / "node_modules" / ".." / ".git", suffixes=("none",)) == {}
    with pytest.raises(Exception, match="missing"):
        read(root, tmp_path / "missing")


def test_run_artefacts(spark, tmp_path):
    path = str(tmp_path / "runs")
    verdicts = spark.createDataFrame([("r1", "HOLD", ["why", 'q"']), ("r2", "PASS", []), ("r 3", "PASS", None)], "run_id string, verdict string, reasons array<string>").withColumn("ts", F.lit("2024-01-01T00:00:00Z"))
    docs = spark.createDataFrame([("r1", "Revenue rose 12% in 2019. It must cost 5 million.")], "run_id string, text string")
    found = claim_rows.pipeline_claims(docs, "run_id")
    violations = spark.createDataFrame([("r1", 1, "b", "block", 2, "x|é"), ("r1", 0, "a", "hold", 1, "y")], "run_id string, pos int, rule_id string, severity string, line_number int, matched_text string")
    footers = spark.createDataFrame([("r2", "## Overrides\n")], "run_id string, footer string")
    rows = files.assembled(verdicts, found, violations, footers=footers).withColumn("cbom", F.when(F.col("run_id") == "r1", F.lit('{"b": 1, "a": [2]}')))
    files.write_artefacts(rows, path)
    assert sorted(os.listdir(path)) == ["r 3", "r1", "r2"]
    assert sorted(os.listdir(f"{path}/r1")) == ["boundary.json", "cbom.json", "claims.json", "context_items.json", "verdict.json", "verifier.json"]
    assert sorted(os.listdir(f"{path}/r2")) == ["boundary.json", "claims.json", "context_items.json", "footer.md", "verdict.json", "verifier.json"]
    assert open(f"{path}/r1/cbom.json").read() == json.dumps({"a": [2], "b": 1}, indent=2, sort_keys=True)
    boundary = json.load(open(f"{path}/r1/boundary.json"))
    assert boundary["verdict"] == "fail" and [v["rule_id"] for v in boundary["violations"]] == ["a", "b"] and boundary["violations"][1]["matched_text"] == "x|é"
    said = json.load(open(f"{path}/r1/claims.json"))
    assert [c["sentence"] for c in said] == [r["sentence"] for r in found.orderBy("pos").collect()] and said[0]["citation"] is None
    os.remove(f"{path}/r2/claims.json")
    with open(f"{path}/r2/verdict.json", "w") as f:
        f.write("{broken")
    got = {r["run_id"]: r for r in files.read_artefacts(spark, path).collect()}
    assert set(got) == {"r1", "r2", "r 3"} and got["r2"]["claims"] is None and json.loads(got["r2"]["verdict"]) == {"error": "json decode failed"}
    assert json.loads(got["r1"]["verdict"]) == {"run_id": "r1", "verdict": "HOLD", "reasons": ["why", 'q"'], "ts": "2024-01-01T00:00:00Z"}
    assert got["r2"]["footer_md"] == "## Overrides\n" and got["r1"]["footer_md"] is None and got["r2"]["cbom"] is None
    files.write_artefacts(rows.where("run_id = 'r2'").drop("footer_md"), path)  # written again: replaced as a whole
    assert "footer.md" not in os.listdir(f"{path}/r2") and "claims.json" in os.listdir(f"{path}/r2")


def test_a_failed_write_leaves_no_stray_file(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("run_id"), F.when(F.col("id") == 33, "{broken").otherwise("{}").alias("verdict")).repartition(4)
    with pytest.raises(Exception):
        files.write_artefacts(rows, path)
    shown = lambda: [x for x in os.listdir(path) if not x.startswith("_")]  # noqa: E731  tasks that Spark gives up end in their own time
    assert shown() == []
    for bad in ("../x", "", "_staged"):
        with pytest.raises(Exception, match="no name of a run"):
            files.write_artefacts(spark.createDataFrame([(bad, "{}")], "run_id string, verdict string"), path)
    files.write_artefacts(rows.where("run_id <> 'r33'"), path)
    assert len(shown()) == 39 and files.read_artefacts(spark, path).count() == 39
