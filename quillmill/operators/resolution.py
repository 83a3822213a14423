"""Resolution of names against known entities, as one cascade over tables.

A mention is tried by exact name or alias, then as the specific name of the only unnamed entity of its type, then by
the nearest name; what is left is new. All steps are joins; names are compared only where they can be near enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import vector_index
from quillmill.operators.graph import exact_resolution, indel_ratio, is_generic


class ResolutionConflict(ValueError):
    """Some names are near a known one but not equal to it; ``conflicts`` has their rows."""

    def __init__(self, conflicts: list):
        super().__init__("Conflict detected during resolution")
        self.conflicts = conflicts


def _characters(name: Column) -> Column:
    """A name's characters, each with how often it came before: two names share as many as any common subsequence has."""
    chars = F.split(name, "")
    return F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c))).alias("times"), c.alias("c")))


def near_names(mentions: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """(temp_id, uuid, score): of each mention (temp_id, name) the nearest entity (uuid, name, position), if its ratio is ``threshold`` or more.

    A ratio of t between lengths a and b needs t (a + b) / 2 common characters, which is at least a t / (2 - t); so two
    names must share one of the first characters of both in any one order (prefix filtering), and be of like length. No
    pair that is near enough is lost. Of equal scores, the entity that comes first is nearest. Empty names are near none.
    """
    part = threshold / (2 - threshold)

    def keyed(rows: DataFrame, keep: list[str]) -> DataFrame:
        own = rows.select(*keep, F.lower("name").alias("low")).filter(F.length("low") > 0).withColumn("n", F.length("low"))
        prefix = F.slice(F.array_sort(_characters(F.col("low"))), F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(part) - 1e-9).cast("int") + 1)
        return own.withColumn("key", F.explode(prefix))

    a = keyed(mentions, ["temp_id"]).select("temp_id", F.col("low").alias("a"), F.col("n").alias("na"), "key")
    b = keyed(entities, ["uuid", "position"]).select("uuid", "position", F.col("low").alias("b"), F.col("n").alias("nb"), "key")
    fit = 2 * F.least("na", "nb") >= F.lit(threshold) * (F.col("na") + F.col("nb"))
    pairs = a.join(b, "key").filter(fit).select("temp_id", "uuid", "position", "a", "b").distinct()

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[indel_ratio(x, y) for x, y in zip(batch["a"], batch["b"])])[["temp_id", "uuid", "position", "score"]]

    rated = pairs.mapInPandas(rate, "temp_id long, uuid string, position long, score double")
    best = rated.groupBy("temp_id").agg(F.max(F.struct("score", (-F.col("position")).alias("p"), "uuid")).alias("r"))
    return best.select("temp_id", "r.uuid", "r.score").filter(F.col("score") >= threshold * 100)


def promotes(current: Column, proposed: Column) -> Column:
    """Whether a specific name takes the place of one for someone unnamed."""
    a, b = F.trim(F.coalesce(current, F.lit(""))), F.trim(F.coalesce(proposed, F.lit("")))
    return (a != "") & (b != "") & (F.lower(a) != F.lower(b)) & is_generic(a) & ~is_generic(b)


def resolve(mentions: DataFrame, ontology: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row for each mention (temp_id, name, type, is_new) against entities (uuid, name, type, aliases, position).

    outcome: ontology, generic_placeholder_upgrade, fuzzy_generic_upgrade, conflict or new; uuid: the entity that it is,
    or conflicts with; old_name: the name that it promotes, else null; is_new_mismatch: an exact match that was called
    new; score: of a fuzzy match, else null. A ``position`` of the mentions, their place in the payload, is kept.
    """
    place = ["position"] if "position" in mentions.columns else []
    known = ontology.select(F.col("uuid").alias("known"), F.col("name").alias("known_name"))
    exact = exact_resolution(mentions, ontology).filter("uuid is not null").select("temp_id", F.col("uuid").alias("exact"))
    type_of = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    unnamed = ontology.filter(is_generic(F.col("name"))).groupBy(type_of(F.col("type")).alias("t"))
    unnamed = unnamed.agg(F.count("*").alias("n"), F.min("uuid").alias("unnamed")).filter("n = 1").select("t", "unnamed")
    own = mentions.join(exact, "temp_id", "left").withColumn("t", type_of(F.coalesce("type", F.lit("Entity")))).join(unnamed, "t", "left")
    by_type = F.col("exact").isNull() & F.col("unnamed").isNotNull() & ~is_generic(F.col("name"))
    own = own.withColumn("by_type", by_type)
    near = near_names(own.filter("exact is null AND NOT by_type"), ontology, threshold)
    own = own.join(near.select("temp_id", F.col("uuid").alias("near"), "score"), "temp_id", "left")
    own = own.withColumn("known", F.coalesce("exact", F.when(F.col("by_type"), F.col("unnamed")), "near")).join(known, "known", "left")
    change = promotes(F.col("known_name"), F.col("name"))
    outcome = F.when(F.col("exact").isNotNull(), "ontology").when(F.col("by_type"), "generic_placeholder_upgrade").when(F.col("near").isNull(), "new").when(change, "fuzzy_generic_upgrade").otherwise("conflict")
    promoted = F.when(F.col("by_type") | ((outcome != "conflict") & change), F.col("known_name"))
    return own.select(
        "temp_id", *place, "name", "type", outcome.alias("outcome"), F.col("known").alias("uuid"), promoted.alias("old_name"),
        (F.col("exact").isNotNull() & F.coalesce("is_new", F.lit(False))).alias("is_new_mismatch"), F.round("score", 4).alias("score"),
    )


def metrics(resolved: DataFrame) -> DataFrame:
    """One row of counts over the outcomes."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return resolved.agg(
        is_("ontology").alias("exact_resolved"), F.count_if("is_new_mismatch").alias("auto_corrected_is_new"), is_("conflict").alias("fuzzy_conflicts"),
        is_("new").alias("created_new"), F.count_if(F.col("old_name").isNotNull()).alias("name_promotions"),
    )


def checked(resolved: DataFrame) -> DataFrame:
    """``resolved``, or a ``ResolutionConflict`` that has all conflicts; only conflicts reach the driver."""
    conflicts = resolved.filter("outcome = 'conflict'").select("temp_id", "name", "uuid", "score").collect()
    if conflicts:
        raise ResolutionConflict(conflicts)
    return resolved


def vector_conflicts(mentions: DataFrame, entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(temp_id, name, uuid, known_name, score, must_ask) of mentions (temp_id, name, type, is_new, v) that are called new and lie near a known entity (uuid, name, type, v).

    The nearest entity by cosine counts, if its cosine is ``threshold`` or more and the types, where both are given, are
    equal. Someone unnamed who lies that near to a known name is for a person to decide (``must_ask``).
    """
    called = mentions.filter(F.coalesce("is_new", F.lit(False)))
    near = vector_index.top(vector_index.build(entities, "uuid", "v"), called, "temp_id", "v", 1).filter(F.col("cosine") >= threshold)
    known = entities.select(F.col("uuid").alias("item"), F.col("name").alias("known_name"), F.col("type").alias("known_type"))
    met = near.join(known, "item").join(called.select(F.col("temp_id").alias("query"), "name", "type"), "query")
    fits = F.lower("type").isNull() | F.lower("known_type").isNull() | (F.lower(F.trim("type")) == F.lower(F.trim("known_type")))
    must_ask = is_generic(F.col("name")) & ~is_generic(F.col("known_name"))
    return met.filter(fits).select(F.col("query").alias("temp_id"), "name", F.col("item").alias("uuid"), "known_name", F.col("cosine").alias("score"), must_ask.alias("must_ask"))
