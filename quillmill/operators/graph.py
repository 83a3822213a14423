"""Property-graph tables: upserts, state history, event chains, entity resolution and checks.

An upsert is a full outer join of the stored table with a batch reduced to one row a key; results are new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: names that stand for someone unnamed
GENERIC_NAMES = "he she they them him her person man woman boy girl stranger".split()


def first_wins(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert in which a stored value stays, and an unset one takes the batch's first by ``order``."""
    names = [c for c in old.columns if c != key]
    batch = new.groupBy(key).agg(*[F.min_by(c, order).alias(f"new_{c}") for c in names])
    return old.join(batch, key, "full_outer").select(key, *[F.coalesce(c, f"new_{c}").alias(c) for c in names])


def entity_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (uuid, name, aliases, baseline_state): a stored name or state stays; aliases are taken only where none are stored.

    Of a uuid that a batch (with position) has several times, the first set value counts.
    """
    none = F.array().cast("array<string>")
    filled = F.size(F.coalesce("aliases", none)) > 0
    first = lambda c, given: F.min_by(c, F.when(given, F.col("position"))).alias(f"new_{c}")
    batch = new.groupBy("uuid").agg(first("name", F.col("name").isNotNull()), first("aliases", filled), first("baseline_state", F.col("baseline_state").isNotNull()))
    aliases = F.when(filled, F.col("aliases")).otherwise(F.coalesce("new_aliases", none))
    both = old.join(batch, "uuid", "full_outer")
    return both.select("uuid", F.coalesce("name", "new_name").alias("name"), aliases.alias("aliases"), F.coalesce("baseline_state", "new_baseline_state").alias("baseline_state"))


def add_label(labels: Column, label: Column) -> Column:
    return F.array_union(F.coalesce(labels, F.array().cast("array<string>")), F.array(label))


def promote_name(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """Entities with new names (uuid, new_name); the old name becomes an alias, and the text of the latest one."""
    old = F.trim(F.coalesce("name", F.lit("")))
    kept = F.col("new_name").isNull() | (F.col("new_name") == F.col("name")) | (old == "")
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    aliases = F.when(kept, known).otherwise(F.array_union(known, F.array("name")))
    return entities.join(renames, "uuid", "left").select("uuid", F.coalesce("new_name", "name").alias("name"), aliases.alias("aliases"), F.when(~kept, F.col("name")).alias("aliases_text"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``; partial aggregation keeps frequent keys small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def state_history(changes: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Each change with the time at which the next change of its key closes it; the last one stays open.

    A change that comes again (same key, time and tie) is one, so taking in the same changes twice alters nothing.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    own = changes.dropDuplicates([*keys, at, tie])
    return own.withColumn("valid_until", F.lead(at).over(w)).withColumnRenamed(at, "valid_from").withColumn("is_open", F.col("valid_until").isNull())


def event_chain(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return events.select(key, F.col(name).alias("source_id"), F.lead(name).over(w).alias("target_id")).filter("target_id is not null")


def label_counts(labels: DataFrame) -> DataFrame:
    """(label, count) of rows with an array ``labels``."""
    return labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count"))


def violations(name: str, rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """(rule, count) of the rows whose ``key`` isn't among ``known``."""
    missing = rows.select(F.col(key).alias("k")).filter("k is not null").join(known.select(F.col(known_key).alias("k")).distinct(), "k", "left_anti")
    return missing.groupBy(F.lit(name).alias("rule")).agg(F.count("*").alias("violations"))


def exact_resolution(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions (temp_id, name) by name or alias of entities (uuid, name, aliases, position); a later entity wins."""
    keys = F.array_distinct(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda k: k.isNotNull() & (k != "")))
    index = entities.select("uuid", "position", F.explode(keys).alias("k")).groupBy(F.lower("k").alias("k")).agg(F.max_by("uuid", "position").alias("uuid"))
    return mentions.withColumn("k", F.lower(F.trim("name"))).join(index, "k", "left").select("temp_id", "name", "uuid", F.when(F.col("uuid").isNotNull(), "ontology").otherwise("none").alias("match_source"))


def is_generic(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return n.isin(GENERIC_NAMES) | n.startswith("the ")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), by a bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best Indel ratio of the common words and the common words with either rest."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left, right = (f"{common} {' '.join(sorted(r))}".strip() for r in (x - y, y - x))
    if common and (not x - y or not y - x):
        return 100.0
    return max(indel_ratio(left, right), *(indel_ratio(common, s) for s in (left, right) if common)) if common else indel_ratio(left, right)


def partial_ratio(a: str, b: str) -> float:
    """The best Indel ratio of the shorter text with a window of its size, also cut by an end, in the longer.

    Of texts of one size either may be the shorter.
    """
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)
    best = lambda x, y: max(indel_ratio(x, y[max(0, i) : i + n]) for i in range(1 - n, len(y)))
    return max(best(short, long_), best(long_, short)) if n == len(long_) else best(short, long_)
