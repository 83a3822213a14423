"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row for each digest, sort-merge
anti-joined with the index, and what is new is appended. Texts themselves are never shuffled, only digests.

Defined results for odd rows: a null text counts as empty; a null doc_id sorts after all others; of rows equal in
text, length and doc_id any one stays and the rest go; an empty table gives an empty result; columns besides
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import work

WHITE = " \t\n\x0b\x0c\r"
_FIELDS = "digest BINARY, keep_id BIGINT, keep_len INT, keep_row BIGINT, batch STRING"


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; byte-wise replacement is several times faster here than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A digest index kept at ``location`` as a table of ``buckets`` buckets; the same location may be reopened later."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = location or work.path(spark, "digests")
        self.buckets = buckets or work.partitions(spark)
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({_FIELDS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def known(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table's name out of the session's catalogue; the files stay and may be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self, location: str | None = None) -> DigestIndex:
        """The same index as one sorted file for each bucket at another place, after many batches have left many; this one is closed."""
        out = DigestIndex(self.spark, location, self.buckets)
        out._append(self.known())
        self.close()
        return out

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        dealt.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.location).saveAsTable(self.table)

    def add(self, docs: DataFrame, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
        """Deduplicate ``docs`` against the index and itself, and append what is new; with ``numbered`` its column row numbers the rows.

        Returns (rows, verdicts): one row for each of ``docs`` (row, doc_id, len, digest), and one verdict for each
        digest (digest, keep_id, keep_len, keep_row, group_size, fresh). ``fresh`` is false if an earlier batch had it.
        """
        batch = uuid.uuid4().hex
        row = F.col("row") if numbered else F.monotonically_increasing_id().alias("row")
        rows = work.put(
            docs.select(
                row,
                F.col("doc_id").cast("long").alias("doc_id"),
                F.char_length(F.coalesce("text", F.lit(""))).alias("len"),
                digest(F.col("text")).alias("digest"),
            ),
            "rows",
        )
        best = F.min(F.struct((-F.col("len")).alias("less"), F.isnull("doc_id").alias("none"), "doc_id", "row"))
        mine = work.put(rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "batch")
        fresh = mine.join(self.known().select("digest").hint("merge"), "digest", "left_anti")
        new = fresh.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_len"), F.col("best.row").alias("keep_row"), F.lit(batch).alias("batch"))
        self._append(new)
        verdicts = mine.select("digest", "group_size").join(self.known().hint("merge"), "digest")
        return rows, work.put(verdicts.withColumn("fresh", F.col("batch") == batch).drop("batch"), "verdicts")


def annotate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    ``rows`` and ``verdicts`` are both written tables: a digest that holds a third of all rows is then a skewed
    partition of a plain join, which Spark splits.
    """
    rows, verdicts = (index or DigestIndex(docs.sparkSession)).add(docs)
    return rows.join(verdicts.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    Rows are written with a number of their own, so only digests and the numbers of the rows that go are shuffled.
    """
    since = work.mark()
    own = work.put(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), "numbered")
    used = index or DigestIndex(docs.sparkSession)
    rows, verdicts = used.add(own.select("row", "d.doc_id", "d.text"), numbered=True)
    both = rows.join(verdicts.select("digest", "fresh", "keep_row").hint("merge"), "digest")
    gone = work.put(both.filter(~F.col("fresh") | (F.col("row") != F.col("keep_row"))).select("row"), "gone")
    if index is None:
        used.close()
    work.sweep(since, own, gone)
    return work.among(own, gone, "row", "left_anti").select("d.*")
