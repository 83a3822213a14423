"""A stream of run metrics kept as a trend table, each run once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run_id STRING, created_at STRING, document_entropy DOUBLE, mean_surprisal DOUBLE, average_lexical_density DOUBLE"


def keep_trend(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True):
    """Follow a folder of JSON bundles; a run that the table has already is skipped, also when a batch comes again."""
    bundles = spark.readStream.schema(SCHEMA).json(source)

    def upsert(batch: DataFrame, epoch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates(["run_id"])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(SCHEMA).parquet(target).select("run_id"), "run_id", "left_anti")
        fresh.write.mode("append").parquet(target)

    writer = bundles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def item_states(transitions: DataFrame) -> DataFrame:
    """The latest state of each item of a run (run_id, item_id, state, updated_at)."""
    from pyspark.sql import functions as F

    return transitions.groupBy("run_id", "item_id").agg(F.max_by("state", "updated_at").alias("state"), F.max("updated_at").alias("updated_at"))
