"""Events, their links and the states that they set, as tables with deterministic ids.

Every operator takes the stored table and a batch, and returns the table as it then is; applying a batch twice gives the
same table as applying it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as tx
from quillmill.operators.graph import first_wins

# fixed values: namespaces of name-based UUIDs
DNS, URL = "6ba7b8109dad11d180b400c04fd430c8", "6ba7b8119dad11d180b400c04fd430c8"
EVENT_TYPE = "GENERIC"


def event_rows(batch: DataFrame) -> DataFrame:
    """Nodes of a batch (chapter_id, event_id, position, description): uuid, type, description, timestamp, sequence, chapter_id."""
    uuid = tx.uuid5(F.lit(DNS), F.concat_ws(":", "chapter_id", "event_id"))
    none = F.lit(None).cast("string")
    return batch.select(uuid.alias("uuid"), F.lit(EVENT_TYPE).alias("type"), F.coalesce("description", F.lit("")).alias("description"), none.alias("timestamp"), F.col("position").alias("sequence"), "chapter_id")


def upsert_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """A stored value stays; an unset one takes the batch's, of repeated events the first by sequence."""
    return first_wins(stored, event_rows(batch), "uuid", "sequence")


def merged(stored: DataFrame, links: DataFrame) -> DataFrame:
    """An edge table of distinct edges with those that are new."""
    return stored.unionByName(links).distinct()


def documented_by(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """(event_uuid, chunk_hash): each event with its chapter's first chunk (chapter_id, position, hash), whichever it stands in."""
    first = chunks.groupBy("chapter_id").agg(F.min_by("hash", "position").alias("chunk_hash"))
    return events.select(F.col("uuid").alias("event_uuid"), "chapter_id").join(first, "chapter_id").select("event_uuid", "chunk_hash").distinct()


def occurred_in(events: DataFrame, places: DataFrame, entities: DataFrame) -> DataFrame:
    """(event_uuid, location_uuid) of places (event_uuid, location_uuid) whose entity (uuid, labels) exists and is a Location."""
    locations = entities.filter(F.array_contains("labels", "Location")).select(F.col("uuid").alias("location_uuid"))
    found = places.join(events.select(F.col("uuid").alias("event_uuid")), "event_uuid", "left_semi")
    return found.join(locations, "location_uuid", "left_semi").select("event_uuid", "location_uuid").distinct()


def participated_in(stored: DataFrame, batch: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_uuid, event_uuid, role, intent): a batch's last role takes the stored one's place, an unset intent leaves it.

    The batch has a position; both ends must exist.
    """
    keys = ["entity_uuid", "event_uuid"]
    own = batch.join(events.select(F.col("uuid").alias("event_uuid")), "event_uuid", "left_semi").join(entities.select(F.col("uuid").alias("entity_uuid")), "entity_uuid", "left_semi")
    new = own.groupBy(*keys).agg(F.max_by("role", "position").alias("new_role"), F.max_by("intent", F.when(F.col("intent").isNotNull(), F.col("position"))).alias("new_intent"), F.lit(True).alias("is_new"))
    both = stored.join(new, keys, "full_outer")
    return both.select(*keys, F.when(F.col("is_new"), F.col("new_role")).otherwise(F.col("role")).alias("role"), F.coalesce("new_intent", "intent").alias("intent"))


def next_events(events: DataFrame) -> DataFrame:
    """(from_uuid, to_uuid) of a chapter's events in their sequence."""
    w = Window.partitionBy("chapter_id").orderBy("sequence", "uuid")
    return events.select(F.col("uuid").alias("from_uuid"), F.lead("uuid").over(w).alias("to_uuid")).filter("to_uuid is not null")


def apply_states(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """States (uuid, entity_uuid, attribute, value, valid_from, valid_until, closed_at, created_at) after a batch.

    The batch (entity_uuid, attribute, event_id, value, position, at) closes each open state of its entity and attribute
    at its first event, and each of its own at its next; a state's id is made of entity, attribute and event, so one
    that is stored already is not made again and closes nothing.
    """
    keys = ["entity_uuid", "attribute"]
    uuid = tx.uuid5(F.lit(URL), F.concat_ws(":", "entity_uuid", "attribute", F.coalesce("event_id", F.lit(""))))
    own = batch.withColumn("uuid", uuid)
    own = own.groupBy("uuid").agg(F.min_by(F.struct(*batch.columns), "position").alias("r")).select("uuid", "r.*")
    own = own.join(stored.select("uuid"), "uuid", "left_anti")
    w = Window.partitionBy(*keys).orderBy("position", "uuid")
    own = own.withColumn("until", F.lead("event_id").over(w)).withColumn("closed", F.lead("at").over(w))
    made = own.select("uuid", *keys, "value", F.col("event_id").alias("valid_from"), F.col("until").alias("valid_until"), F.col("closed").alias("closed_at"), F.col("at").alias("created_at"))
    first = own.groupBy(*keys).agg(F.min_by("event_id", "position").alias("until"), F.min_by("at", "position").alias("closed"))
    old = stored.join(first, keys, "left")
    closes = F.col("valid_until").isNull() & F.col("until").isNotNull()
    old = old.withColumn("closed_at", F.when(closes, F.col("closed")).otherwise(F.col("closed_at"))).withColumn("valid_until", F.coalesce("valid_until", "until"))
    return old.select(made.columns).unionByName(made)


def logged(events: DataFrame, actors: DataFrame, characters: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges (kind, source, target, role) of logged events (uid, timestamp, location_name, parent_uid).

    To its year and its place, from actors (event_uid, uid, role) that exist among characters (uid), and to its parent if
    that is among ``parents`` (uid). A timestamp that is neither a year nor a date is an error.
    """
    year = F.when(F.col("timestamp").isNull(), None).otherwise(F.coalesce(tx.year_of(F.col("timestamp")), F.raise_error(F.concat(F.lit("Unsupported timestamp format: "), "timestamp")).cast("int")))
    none = F.lit(None).cast("string").alias("role")
    edge = lambda kind, source, target, role=none: [F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), role]
    out = events.select(*edge("OCCURRED_IN", F.col("uid"), year.cast("string"))).filter("target is not null")
    out = out.unionByName(events.select(*edge("TOOK_PLACE_AT", F.col("uid"), F.col("location_name"))).filter("target is not null"))
    known = actors.join(characters.select("uid"), "uid", "left_semi").join(events.select(F.col("uid").alias("event_uid")), "event_uid", "left_semi")
    out = out.unionByName(known.select(*edge("PARTICIPATED", F.col("uid"), F.col("event_uid"), F.col("role"))))
    caused = events.join(parents.select(F.col("uid").alias("parent_uid")), "parent_uid", "left_semi")
    return out.unionByName(caused.select(*edge("CAUSED_BY", F.col("uid"), F.col("parent_uid")))).distinct()
