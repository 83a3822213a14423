"""JSON schemas compiled to columns: what is wrong with a document, by path, and loads that set bad ones apart.

A schema becomes one expression over VARIANT, so checking a table is one projection. Known keywords: type (one or
several), required, properties, additionalProperties (false, true or a schema), items, enum, const, minimum, maximum, minLength,
minItems, and $ref within the schema. Others say nothing about validity here (title, description, format, $id and the like).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.tables import numbered_lines

_ERRORS = "array<struct<path: string, code: string>>"
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$" if not name else f"$['{name}']", kind)


def _is(kind: Column, v: Column, name: str) -> Column:
    number = kind.rlike(_NUMBER)
    of = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": number,
        "integer": number & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))),
    }
    return of[name]


def _json(v: Column) -> Column:
    return F.to_json(v)


def errors(v: Column, schema: dict, path: Column | None = None, root: dict | None = None) -> Column:
    """An array of (path, code) for a variant: codes are the keywords that it breaks, paths as ``$.items[0].type``.

    A required member that lacks is reported at its own path. What has the wrong type isn't looked into.
    """
    root = schema if root is None else root
    path = F.lit("$") if path is None else path
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#").strip("/").split("/") if schema["$ref"] != "#" else []:
            target = target[step]
        return errors(v, target, path, root)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    found: list[Column] = []

    def broken(test: Column, code: str, at: Column = path) -> None:
        found.append(F.array_compact(F.array(F.when(F.coalesce(test, F.lit(False)), F.struct(at.alias("path"), F.lit(code).alias("code"))))))

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for name in kinds:
            fits = fits | F.coalesce(_is(kind, v, name), F.lit(False))
        broken(~fits, "type")
    if "enum" in schema:
        broken(~_json(v).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]), "enum")
    if "const" in schema:
        broken(_json(v) != json.dumps(schema["const"], ensure_ascii=False, separators=(",", ":")), "const")
    number = F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double"))
    if "minimum" in schema:
        broken(number < float(schema["minimum"]), "minimum")
    if "maximum" in schema:
        broken(number > float(schema["maximum"]), "maximum")
    if "minLength" in schema:
        broken((kind == "STRING") & (F.length(F.try_variant_get(v, "$", "string")) < schema["minLength"]), "minLength")
    is_array, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    none = F.array().cast(_ERRORS)
    if "minItems" in schema or "items" in schema:
        each = F.when(is_array, F.try_variant_get(v, "$", "array<variant>"))
        if "minItems" in schema:
            broken(F.size(each) < schema["minItems"], "minItems")
        if isinstance(schema.get("items"), dict):
            inner = F.transform(each, lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), root))
            found.append(F.coalesce(F.flatten(inner), none))
    own, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    members = F.when(is_object, F.try_variant_get(v, "$", "map<string,variant>"))
    for name in schema.get("required", []):
        broken(is_object & ~F.array_contains(F.map_keys(members), name), "required", F.concat(path, F.lit(f".{name}")))
    for name, inner in own.items():
        there = F.array_contains(F.map_keys(members), name)
        found.append(F.when(F.coalesce(there, F.lit(False)), errors(_at(v, name), inner, F.concat(path, F.lit(f".{name}")), root)).otherwise(none))
    if more is not True:
        others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(list(own)) if own else F.lit(True))
        at = lambda e: F.concat(path, F.lit("."), e["key"])
        if more is False:
            found.append(F.coalesce(F.transform(others, lambda e: F.struct(at(e).alias("path"), F.lit("additionalProperties").alias("code"))), none))
        else:
            found.append(F.coalesce(F.flatten(F.transform(others, lambda e: errors(e["value"], more, at(e), root))), none))
    return F.concat(none, *found)


def checked(rows: DataFrame, text: str, schema: dict) -> DataFrame:
    """``rows`` with ``v``, their JSON as a variant, and ``errors``; what is no JSON has the error (``$``, ``json``)."""
    parsed = rows.withColumn("v", F.try_parse_json(text))
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("code"))).cast(_ERRORS)
    return parsed.withColumn("errors", F.when(F.col("v").isNull(), bad).otherwise(errors(F.col("v"), schema)))


def load_lines(spark: SparkSession, path: str, schema: dict, quarantine: str | None = None) -> DataFrame:
    """The good lines of JSON lines files: file, line (from 1), v. Bad ones go to the table ``quarantine`` with their errors, or raise.

    Blank lines count as lines and are left out.
    """
    found = checked(numbered_lines(spark, path).filter(F.trim("value") != ""), "value", schema)
    return _parted(found, ["file", "line"], quarantine)


def load_documents(spark: SparkSession, path: str, schema: dict, quarantine: str | None = None) -> DataFrame:
    """The good documents of files of one JSON document each: file, v."""
    found = checked(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), "value", schema)
    return _parted(found, ["file"], quarantine)


def _parted(found: DataFrame, at: list[str], quarantine: str | None) -> DataFrame:
    bad = found.filter(F.size("errors") > 0).select(*at, "value", "errors")
    if quarantine:
        bad.write.mode("append").parquet(quarantine)
        return found.filter(F.size("errors") == 0).select(*at, "v")
    where = F.concat_ws(":", *[F.col(c).cast("string") for c in at])
    said = F.concat(where, F.lit(": "), F.array_join(F.transform("errors", lambda e: F.concat(e["code"], F.lit(" at "), e["path"])), ", "))
    return found.filter(F.when(F.size("errors") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).select(*at, "v")
