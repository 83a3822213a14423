"""Readers: driver tables, texts, JSON lines, JSON documents, CSV dimensions, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each .md and .txt file below a folder, or of one file."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    if found.isEmpty():
        raise FileNotFoundError(f"no .md or .txt files in {path}")
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1.

    Large files stay split. A line's number is its place in its block of the file plus the lines of the blocks before; one
    row for each block passes through a window.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def json_lines_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows before the first line of each file that isn't JSON, in the file's order, as a resumed writer reads its own output.

    Only the first bad line's number of each file is joined back; blank lines and values that are no objects are left out.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    first = lines.filter("v IS NULL").groupBy("file").agg(F.min("line").alias("bad"))
    kept = lines.join(first, "file", "left").filter(F.col("bad").isNull() | (F.col("line") < F.col("bad"))).filter(F.schema_of_variant("v").startswith("OBJECT"))
    return kept.select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def first_files(documents: DataFrame, most: int | None) -> DataFrame:
    """The rows of the first ``most`` files by name."""
    if most is None:
        return documents
    first = documents.select("path").distinct().orderBy("path").limit(most)
    return documents.join(F.broadcast(first) if most <= 100_000 else first, "path", "left_semi")


def csv_dimension(spark: SparkSession, path: str, required: list[str], numbers: dict[str, float] | None = None) -> DataFrame:
    """A CSV table with the columns that it must have; ``numbers`` are columns read as doubles, with what stands for those that can't be."""
    found = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in found.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return found.withColumns({c: F.coalesce(F.col(c).try_cast("double") if c in found.columns else F.lit(None), F.lit(default)) for c, default in (numbers or {}).items()})


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of the paths that exists, in any file system that Spark reaches."""
    for path in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of {candidates} exists")


def history(spark: SparkSession, folder: str, schema: str, name: str = "diagnostics_bundle.json") -> DataFrame:
    """The bundles of all runs below a folder (``run``/diagnostics/``name``), by time and run."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/diagnostics/{name}").orderBy("created_at", "run_id")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()
