"""Work tables in the folder that all executors share.

Lineage is cut by writing a table, never by a local checkpoint, so that a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or where that is unset and all runs in one process a temporary folder set as such."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; it is deleted when the driver's process ends."""
    if not _written:
        atexit.register(_sweep)
    made = f"{root(spark)}/quillmill-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, made))
    return made


def put(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table and read again."""
    spark = df.sparkSession
    to = path(spark, tag)
    df.write.option("compression", "zstd").parquet(to)
    back = spark.read.schema(df.schema).parquet(to)
    back._quillmill_path = to
    return back


def put_parts(df: DataFrame, tag: str, column: str, values: list[str]) -> list[DataFrame]:
    """``df`` written once as one table for each of the values of a text column, which they lack; each can be dropped by itself."""
    spark = df.sparkSession
    to = path(spark, tag)
    df.write.option("compression", "zstd").partitionBy(column).parquet(to)
    out, schema = [], df.drop(column).schema
    for value in values:
        at = f"{to}/{column}={value}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        back = spark.read.schema(schema).parquet(at) if there else spark.createDataFrame([], schema)
        back._quillmill_path = at
        out.append(back)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``put`` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._quillmill_path)


def mark() -> int:
    """A place in the sequence of tables written, for ``sweep``."""
    return len(_written)


def sweep(since: int, *keep: DataFrame) -> None:
    """Delete the tables written after a mark, but for those that a result will still read."""
    kept = {table._quillmill_path for table in keep}
    for spark, at in _written[since:]:
        if at not in kept:
            _delete(spark, at)
    _written[since:] = [x for x in _written[since:] if x[1] in kept]


#: Ids of which a hash table is sent to every executor: some tens of MB at most.
FEW = 1_000_000


def among(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """A left_semi or left_anti join of wide ``rows`` with a written table of distinct longs.

    Up to ``FEW`` ids, which are counted, are broadcast, so that the rows stay where they are; beyond that both sides
    are shuffled. The result is the same.
    """
    few = ids.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete(spark: SparkSession, at: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(conf).delete(where, True)


def _sweep() -> None:
    for spark, at in _written:
        with contextlib.suppress(Exception):
            _delete(spark, at)
