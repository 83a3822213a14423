"""Readers, writers, the detector registry and the trend stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.operators import checkpoints
from quillmill.operators.lexical import paragraphs
from quillmill.plans import detectors
from quillmill.sources import sinks, tables
from quillmill.streaming import trend


def test_readers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("one\ntwo")
    (tmp_path / "a" / "b" / "y.txt").write_text("é")
    (tmp_path / "a" / "z.csv").write_text("q")
    assert sorted(r.text for r in tables.texts(spark, f"file://{tmp_path}/a").collect()) == ["one\ntwo", "é"]
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a":\n{"a": 4}\n')
    assert sorted(r.a for r in tables.json_lines(spark, f"file://{tmp_path}/ok.jsonl", "a long").collect()) == [1, 2]
    with pytest.raises(Exception):
        tables.json_lines(spark, f"file://{tmp_path}/bad.jsonl", "a long").collect()
    assert sorted(r.a for r in tables.json_lines_until_bad(spark, f"file://{tmp_path}/bad.jsonl", "a long").collect()) == [1, 2]
    (tmp_path / "words.txt").write_text(" Foo \n\nbar\nfoo\n")
    assert sorted(r.word for r in tables.word_list(spark, f"file://{tmp_path}/words.txt").collect()) == ["bar", "foo"]
    (tmp_path / "d.csv").write_text("verb,category\nrun,high\n")
    assert tables.csv_dimension(spark, f"file://{tmp_path}/d.csv", ["verb"]).count() == 1
    with pytest.raises(ValueError):
        tables.csv_dimension(spark, f"file://{tmp_path}/d.csv", ["other"])
    assert [(r.category, r.zipf) for r in tables.csv_dimension(spark, f"file://{tmp_path}/d.csv", ["verb"], {"category": 2.5, "zipf": 1.0}).collect()] == [(2.5, 1.0)]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.texts(spark, f"file://{tmp_path}/none")
    assert tables.first_existing(spark, [f"file://{tmp_path}/missing", f"file://{tmp_path}/a"]) == f"file://{tmp_path}/a"
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [f"file://{tmp_path}/missing"])
    for run, at in (("r2", "2030"), ("r1", "2031"), ("r0", "2030")):
        (tmp_path / "runs" / run / "diagnostics").mkdir(parents=True)
        (tmp_path / "runs" / run / "diagnostics" / "diagnostics_bundle.json").write_text(json.dumps({"run_id": run, "created_at": at}))
    assert [r.run_id for r in tables.history(spark, f"file://{tmp_path}/runs", "run_id string, created_at string").collect()] == ["r0", "r2", "r1"]
    for name in "ab":
        (tmp_path / f"{name}_edits.json").write_text(json.dumps({"items": [1, 2]}))
    found = tables.json_documents(spark, f"file://{tmp_path}/*_edits.json", "items array<long>")
    assert found.count() == 2 and tables.first_files(found, 1).count() == 1


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("=x", 0.5), ("y", float("nan"))], "name string, s double")
    sinks.csv_table(frame, f"file://{tmp_path}/c", ["s"])
    assert sorted(r.s for r in spark.read.option("header", True).csv(f"file://{tmp_path}/c").collect()) == ["0.500000", "nan"]
    with pytest.raises(ValueError):
        sinks.json_document(frame, f"file://{tmp_path}/j")
    sinks.json_document(frame.filter("name = '=x'"), f"file://{tmp_path}/j")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/j").collect()))["name"] == "=x"
    assert sorted(r.v for r in frame.select(sinks.safe_cell(frame.name).alias("v")).collect()) == ["'=x", "y"]
    assert sinks.markdown_lines(frame, frame.name, [("score", frame.s)]).first().value == "## =x\n\n- score: 0.5\n"
    stored = spark.createDataFrame([("y", 1.0)], "name string, s double")
    assert sinks.append_new(stored, frame, ["name"], f"file://{tmp_path}/p").count() == 1


def test_detectors(spark):
    rows = paragraphs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found = detectors.sweep(rows)
    assert found.columns == detectors.ISSUE and found.count() > 0
    assert {r.detector for r in found.select("detector").distinct().collect()} <= set(detectors.names())
    assert detectors.run_tool("density", rows).columns == detectors.ISSUE
    with pytest.raises(KeyError):
        detectors.run_tool("nothing", rows)

    @detectors.annotator("lacking")
    def lacking(x):
        return x.selectExpr("doc_id")

    with pytest.raises(ValueError):
        detectors.annotated(rows, "lacking")
    assert detectors.diagnostics(rows).count() == rows.select("manuscript_id").distinct().count()


def test_trend_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda k, name, run: (tmp_path / "in" / name).write_text(json.dumps({"run_id": run, "created_at": "2030-01-01", "document_entropy": k}))
    where = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check")]
    put(1.0, "a.json", "r1")
    trend.keep_trend(spark, *where).awaitTermination()
    put(2.0, "b.json", "r2")
    put(9.0, "c.json", "r1")  # known already
    trend.keep_trend(spark, *where).awaitTermination()
    assert sorted((r.run_id, r.document_entropy) for r in spark.read.parquet(where[1]).collect()) == [("r1", 1.0), ("r2", 2.0)]


def test_saved_rows_are_compressed(spark):
    checkpoints.saved(spark.range(1))
    shared = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    kept = checkpoints.saved(spark.range(20_000).select("id", F.array_repeat(F.lit("the same words"), 20).alias("words")))
    assert size() - before < 400_000 and kept.agg(F.sum("id"), F.sum(F.size("words"))).first()[:] == (199_990_000, 400_000)
    checkpoints.drop(kept)
    assert size() == before
