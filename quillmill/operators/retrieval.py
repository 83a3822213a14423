"""Search by words (BM25), by vectors, and by both.

The inverted index deals texts, in their order, into blocks of ``BLOCK``; for each term and block it has the texts with
their counts and lengths, and beside them the greatest share of a score that the block can give. A query adds these bounds
up for each block, opens the most promising blocks first, and then only those whose bound reaches its k-th score so far.
The result is that of scoring every text. A block is scored where its texts' counts lie, for all queries that open it, and only
its best texts for each of them leave it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.operators import vector_index
from quillmill.operators.checkpoints import saved

#: Texts of a block, and blocks that a query opens before any is ruled out.
BLOCK, FIRST = 200, 4
#: Queries, about, that are scored against a block at once.
BUNCH = 1_000
# fixed values: the weights of BM25, and the constant of reciprocal ranks
K1, B, RANKS = 1.2, 0.75, 60.0
#: What bounds allow for rounding.
SLACK = 1e-6


class RetrievalError(ValueError):
    """Neither words nor vectors can be searched."""


@dataclass
class TextIndex:
    postings: DataFrame  #: term, block, docs (array of doc_id, count, length), bound; written
    terms: DataFrame  #: term, idf
    texts: int
    mean_length: float


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def _share(count, length, mean_length: float):
    """A term's share of a score but for its idf; it grows with the count and falls with the length."""
    return count / (count + K1 * (1 - B + B * length / mean_length))


def build(texts: DataFrame, item: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of all texts. A null text has no terms; an item that comes several times is several texts."""
    own = texts.select(F.col(item).alias("doc_id"), F.col(text).alias("text"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts are cut into terms only after the exchange, in as many tasks as there are ranges, however few files there are
    ranged = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ranged = saved(ranged.select("doc_id", terms_of(F.col("text")).alias("own"), F.monotonically_increasing_id().alias("at")))
    whole = ranged.agg(F.count("*").alias("n"), F.avg(F.size("own")).alias("mean")).first()
    mean = float(whole["mean"] or 0.0) or 1.0
    low = (1 << 33) - 1
    block = F.shiftright("at", 33) * F.lit(1 << 33) + F.floor(F.col("at").bitwiseAND(F.lit(low)) / BLOCK)  # texts of one block lie in one range
    # a text's terms are counted where it lies
    own = ranged.select("at", "doc_id", block.cast("long").alias("block"), F.size("own").alias("length"), F.array_sort("own").alias("own")).filter("length > 0")
    own = own.withColumn("first", F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i == 0) | (F.get("own", i) != F.get("own", i - 1))))
    each = F.zip_with("first", F.concat(F.slice("first", F.lit(2), F.size("first")), F.array("length")), lambda a, b: F.struct(F.get("own", a).alias("term"), (b - a).alias("count")))
    counted = own.select("at", "doc_id", "block", "length", F.inline(each))
    docs = F.collect_list(F.struct("doc_id", "at", "count", "length"))  # at most BLOCK texts
    postings = saved(counted.groupBy("term", "block").agg(docs.alias("docs"), F.max(_share(F.col("count"), F.col("length"), mean)).alias("bound")))
    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    terms = saved(df.select("term", F.log(1 + (whole["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    return TextIndex(postings, terms, whole["n"], mean)


def search(index: TextIndex, queries: DataFrame, k: int, query: str = "query", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query, item, score, rank) of the k best texts of each query, and (query, blocks, opened): how many blocks hold one of its terms, and how many were opened.

    A query is the set of its terms; a score is rounded to 6 places and ties go to the lesser item. Queries without a known term give no rows.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term")).join(index.terms, "term")
    asked = saved(asked)
    bounds = asked.join(index.postings.select("term", "block", "bound"), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("bound")).alias("bound"))
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    bounds = saved(bounds.withColumn("place", F.row_number().over(best)))

    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query",)} | {"item": index.postings.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()}
    bunches = max(1, -(-asked.select("query").distinct().count() // BUNCH))
    bunch = F.pmod(F.xxhash64("query"), F.lit(bunches)).cast("int").alias("bunch")
    known = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    mean = index.mean_length

    def best_of(posts: pa.Table, asks: pa.Table) -> pa.Table:
        """Of a block's texts those that can be among a query's k best in it, with their scores."""
        fields = [("query", asks.schema.field("query").type), ("item", posts.schema.field("docs").type.value_type.field("doc_id").type), ("at", pa.int64()), ("score", pa.float64())]
        if not posts.num_rows or not asks.num_rows:
            return pa.schema(fields).empty_table()
        posts, asks = posts.combine_chunks(), asks.combine_chunks()
        ends = np.cumsum(pc.list_value_length(posts.column("docs")).to_numpy())
        place = {t: (a, b) for t, a, b in zip(posts.column("term").to_pylist(), np.concatenate([[0], ends[:-1]]), ends)}
        docs = pc.list_flatten(posts.column("docs")).combine_chunks()
        docs = docs if isinstance(docs, pa.StructArray) else docs.chunk(0)
        count, length, at = (docs.field(c).to_numpy(zero_copy_only=False) for c in ("count", "length", "at"))
        share = _share(count, length, mean)
        texts, first, text = np.unique(at, return_index=True, return_inverse=True)
        queries = pc.unique(asks.column("query"))
        rows = pc.index_in(asks.column("query"), queries).to_numpy()
        score = np.zeros((len(queries), len(texts)))
        for q, t, idf in zip(rows, asks.column("term").to_pylist(), asks.column("idf").to_numpy()):
            if t in place:
                a, b = place[t]
                score[q, text[a:b]] += idf * share[a:b]
        n = len(texts)
        kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(queries))
        q, i = np.nonzero((score > 0) & (score >= kth[:, None] - 2 * SLACK))  # what rounding may bring level stays
        return pa.table([queries.take(pa.array(q)), docs.field("doc_id").take(pa.array(first[i])), pa.array(texts[i]), pa.array(score[q, i])], schema=pa.schema(fields))

    def scored(blocks: DataFrame) -> DataFrame:
        asks = blocks.select("query", "block").join(asked, "query").select("block", bunch, "query", "term", "idf")
        posts = known.join(blocks.select("block").distinct(), "block", "left_semi").select("block", F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))).alias("bunch"), "term", "docs")
        found = posts.groupBy("block", "bunch").cogroup(asks.groupBy("block", "bunch")).applyInArrow(best_of, f"query {kinds['query']}, item {kinds['item']}, at long, score double")
        return found.withColumn("score", F.round("score", 6))

    ranks = Window.partitionBy("query").orderBy(F.desc("score"), "item", "at")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(ranks).cast("long")).filter(F.col("rank") <= k)
    first = saved(ranked(scored(bounds.filter(F.col("place") <= FIRST))))
    kth = first.filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    rest = bounds.filter(F.col("place") > FIRST).join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
    rest = saved(rest.select("query", "block"))
    found = ranked(first.drop("rank").unionByName(scored(rest))).select("query", "item", "score", "rank")
    more = rest.groupBy("query").agg(F.count("*").alias("more"))
    opened = bounds.groupBy("query").agg(F.count("*").alias("blocks")).join(more, "query", "left")
    return found, opened.select("query", "blocks", (F.least("blocks", F.lit(FIRST)) + F.coalesce("more", F.lit(0))).alias("opened"))


def hybrid(queries: DataFrame, k: int, words: TextIndex | None, vectors: vector_index.Index | None, depth: int | None = None) -> DataFrame:
    """(query, item, score, text_score, cosine, mode, rank): the k best items of queries (query, text, v) by both searches.

    Each search gives its ``depth`` best (k if not given); an item's score is the sum of 1 / (60 + rank) over those that
    found it. If one index is missing, the other one's results stand alone, with a warning and a ``mode`` that says so
    (``text only``, ``vector only``); without both, it is an error.
    """
    if words is None and vectors is None:
        raise RetrievalError("neither a text index nor a vector index")
    depth = depth or k
    mode = "hybrid" if words and vectors else "text only" if words else "vector only"
    if mode != "hybrid":
        warnings.warn(f"degraded retrieval: {mode}", stacklevel=2)
    sides = []
    if words:
        found, _ = search(words, queries, depth)
        sides.append(found.select("query", "item", F.col("score").alias("text_score"), F.lit(None).cast("double").alias("cosine"), (1 / (RANKS + F.col("rank"))).alias("part")))
    if vectors:
        found = vector_index.top(vectors, queries, "query", "v", depth)
        sides.append(found.select("query", "item", F.lit(None).cast("double").alias("text_score"), "cosine", (1 / (RANKS + F.col("rank"))).alias("part")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    merged = both.groupBy("query", "item").agg(F.round(F.sum("part"), 9).alias("score"), F.max("text_score").alias("text_score"), F.max("cosine").alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return merged.withColumn("mode", F.lit(mode)).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
