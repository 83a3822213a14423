"""Writers: JSON lines and documents, CSV tables, Markdown reports, resumable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, path: str) -> None:
    """One row as one pretty JSON document; several rows are an error."""
    if df.limit(2).count() > 1:
        raise ValueError("a JSON document has one row")
    one = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(one.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def score(x: Column) -> Column:
    """Six places; NaN as 'nan'."""
    return F.when(F.isnan(x), "nan").otherwise(F.format_string("%.6f", x))


def csv_table(df: DataFrame, path: str, scores: list[str] = ()) -> None:
    df.withColumns({c: score(F.col(c)) for c in scores}).write.mode("overwrite").option("header", True).csv(path)


def safe_cell(x: Column) -> Column:
    """A value that no spreadsheet takes for a formula."""
    return F.regexp_replace(x, r"^([=+\-@])", "'$1")


def markdown_lines(df: DataFrame, heading: Column, points: list[tuple[str, Column]]) -> DataFrame:
    """A Markdown section for each row: a heading and its points."""
    lines = [F.concat(F.lit("## "), heading), F.lit(""), *[F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("n/a"))) for name, value in points], F.lit("")]
    return df.select(F.concat_ws("\n", *lines).alias("value"))


def append_new(stored: DataFrame, rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Append the rows whose keys aren't stored; writing the same rows again adds nothing."""
    fresh = rows.join(stored.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh
