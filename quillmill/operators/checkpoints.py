"""Cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _set(spark: SparkSession) -> None:
    """A temporary folder where all runs in one process; elsewhere the session must name a shared one."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillmill-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again; a checkpoint's rows would lie there uncompressed."""
    to = folder(df.sparkSession, "saved")
    df.write.option("compression", "zstd").parquet(to)
    back = df.sparkSession.read.schema(df.schema).parquet(to)
    back._quillmill_path = to
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._quillmill_path)


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in that folder, for tables and streams that Spark writes by name; it is deleted when the driver's process ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        _set(spark)
    made = f"{context.getCheckpointDir().rstrip('/')}/quillmill-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, made))
    return made


_made: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, at: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, at in _made:
        with contextlib.suppress(Exception):
            _delete(spark, at)
