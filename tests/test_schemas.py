"""Schemas compiled to columns, split line scans, flattening, and objects in noise."""

import json

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import findings
from quillmill.sources import schemas, tables

#: In the manner of an issue payload: nested objects, arrays, enumerations, bounds, a reference, closed and open objects.
ISSUES = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["schema_version", "manuscript_id", "items"], "additionalProperties": False,
    "properties": {
        "schema_version": {"type": "string", "const": "1.0"}, "manuscript_id": {"type": "string", "minLength": 1}, "created_at": {"type": ["string", "null"], "format": "date-time"},
        "items": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/item"}}, "scores": {"type": "object", "additionalProperties": {"type": "number", "maximum": 1}},
    },
    "$defs": {"item": {
        "type": "object", "required": ["issue_id", "location"],
        "properties": {
            "issue_id": {"type": "string"}, "status": {"type": "string", "enum": ["open", "resolved"]},
            "location": {"type": "object", "required": ["paragraph_id"], "additionalProperties": False, "properties": {"paragraph_id": {"type": "string"}, "char_range": {"type": "object", "properties": {"start": {"type": "integer", "minimum": 0}}}}},
        },
    }},
}


def good(**more):
    return {"schema_version": "1.0", "manuscript_id": "m", "items": [{"issue_id": "i", "status": "open", "location": {"paragraph_id": "p", "char_range": {"start": 0, "end": 9}}}]} | more


def item(**more):
    return good(items=[good()["items"][0], {"issue_id": "j", "location": {"paragraph_id": "q"}} | more])


CASES = [
    (good(), []), (good(created_at=None, scores={"a": 0.5, "b": 1}), []), (item(extra=[1]), []), (item(location={"paragraph_id": "q", "char_range": {"start": 3.0}}), []),
    ({}, [("$.items", "required"), ("$.manuscript_id", "required"), ("$.schema_version", "required")]), ([], [("$", "type")]), (None, [("$", "type")]), (good(manuscript_id=""), [("$.manuscript_id", "minLength")]),
    (good(manuscript_id=None), [("$.manuscript_id", "type")]), (good(items=[]), [("$.items", "minItems")]), (good(items={}), [("$.items", "type")]), (good(other=1), [("$.other", "additionalProperties")]), (good(schema_version="2"), [("$.schema_version", "const")]),
    (good(scores={"a": 2, "b": "x"}), [("$.scores.a", "maximum"), ("$.scores.b", "type")]), (item(status="new"), [("$.items[1].status", "enum")]), (item(status=3), [("$.items[1].status", "enum"), ("$.items[1].status", "type")]),
    (item(location={"paragraph_id": "q", "char_range": {"start": -1}}), [("$.items[1].location.char_range.start", "minimum")]), (item(location={"paragraph_id": "q", "char_range": {"start": 1.5}}), [("$.items[1].location.char_range.start", "type")]),
    (item(location={"x": 1}), [("$.items[1].location.paragraph_id", "required"), ("$.items[1].location.x", "additionalProperties")]), (good(items=[1, {"issue_id": "i"}]), [("$.items[0]", "type"), ("$.items[1].location", "required")]), (good(created_at=5), [("$.created_at", "type")]),
]


def test_errors_by_path(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(CASES)] + [(len(CASES), "{no json"), (len(CASES) + 1, None)], "i int, j string")
    found = {r.i: sorted((e.path, e.code) for e in r.errors) for r in schemas.checked(rows, "j", ISSUES).select("i", "errors").collect()}
    assert found == {i: sorted(e) for i, (_, e) in enumerate(CASES)} | {len(CASES): [("$", "json")], len(CASES) + 1: [("$", "json")]}


def test_bad_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(good()), "", json.dumps({}), "{", json.dumps(item())]))
    path = f"file://{tmp_path}/x.jsonl"
    assert sorted(r.line for r in schemas.load_lines(spark, path, ISSUES, f"file://{tmp_path}/bad").collect()) == [1, 5]
    bad = {r.line: [e.code for e in r.errors] for r in spark.read.parquet(f"file://{tmp_path}/bad").collect()}
    assert bad == {3: ["required"] * 3, 4: ["json"]}
    with pytest.raises(Exception, match="x.jsonl:3: required at"):
        schemas.load_lines(spark, path, ISSUES).collect()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(good(), indent=1))
    assert schemas.load_documents(spark, f"file://{tmp_path}/docs", ISSUES).count() == 1
    (tmp_path / "docs" / "b.json").write_text(json.dumps({}))
    assert schemas.load_documents(spark, f"file://{tmp_path}/docs", ISSUES, f"file://{tmp_path}/bad2").count() == 1 == spark.read.parquet(f"file://{tmp_path}/bad2").count()


@pytest.mark.parametrize("bad", [None, 1, 700, 1_900])
def test_a_split_file_is_cut_at_the_same_line(spark, tmp_path, bad):
    """A file of many blocks, read by several tasks, is numbered and cut as a plain reader does it."""
    lines = [json.dumps({"a": i, "text": "x" * (i % 90)}) if i % 11 else "" for i in range(1, 2_001)]
    lines[5] = "[1]"
    if bad:
        lines[bad - 1] = '{"a": '
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    want = []
    for n, line in enumerate(lines, 1):
        if not line:
            continue
        try:
            x = json.loads(line)
        except ValueError:
            break
        if isinstance(x, dict):
            want.append((n, x["a"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = f"file://{tmp_path}/big.jsonl"
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert sorted((r.line, r.value) for r in tables.numbered_lines(spark, path).collect()) == list(enumerate(lines, 1))
        assert sorted((r.line, r.a) for r in tables.json_lines_until_bad(spark, path, "a long").collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_flattening_has_no_depth(spark):
    deep = {"n": 1, "flag": True, "list": [1], "text": "x", "none": None}
    want = {"n": 1.0, "flag": 1.0}
    for k in range(40):
        deep = {f"k{k}": deep, "m": k}
        want = {f"k{k}.{p}": v for p, v in want.items()} | {"m": float(k)}
    rows = spark.createDataFrame([("a", json.dumps(deep)), ("b", '{"x": {}}'), ("c", "no json"), ("d", None)], "id string, j string")
    assert {r.path: r.value for r in findings.flattened_numbers(rows, "id", "j").collect()} == want


def test_the_first_object_in_noise(spark):
    cases = {
        '{a} then {"b": 1}': '{"b": 1}', 'see { x {"b": {"c": "}"}} }': '{"b": {"c": "}"}}', 'it\'s "so" {"k": "a\\"}"} and {"l": 2}': '{"k": "a\\"}"}', ' {"a": 1} ': '{"a": 1}', "[1, 2]": "[1, 2]", "none": None, "": None, "{": None, "{" * 2_000: None,
        'x {"a": 1': None, '```json\n{"a": [1, {"b": 2}]}\n```': '{"a": [1, {"b": 2}]}',
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.j for r in rows.select("t", tx.json_in(F.col("t")).alias("j")).collect()} == cases | {None: None}


def test_a_click_is_checked_once(spark, tmp_path):
    """No filter brings the whole check along a second time; clicks without errors give no rows."""
    from quillmill.plans import search_queries

    rows = [(1, '{"k": 1, "device": {"os": "ios"}}'), (2, '{"k": 91, "device": {}, "tags": ["c"]}'), (3, None), (4, "{")]
    spark.createDataFrame(rows, "click_id long, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    found = search_queries.schema_errors(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(2, "$.device.os", "required"), (2, "$.k", "maximum"), (2, "$.tags[0]", "enum"), (3, "$", "json"), (4, "$", "json")]
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line and "enum" in line]
