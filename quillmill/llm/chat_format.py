"""Multi-party perspective rotation: each conversation once for each participant, who speaks as the assistant.

Others are users by name, system turns stay system turns. A mask gives the character spans on which to train: the
participant's own texts with their end marks. A dialogue of up to ``WHOLE`` turns is one row for each participant,
whatever its turns' numbers. A longer one would make a row without bound: it comes in parts, by equal ranges of turn
numbers that hold ``PART`` turns if these spread evenly, and its opening system turns (those before any other turn)
begin every part. A part that holds over ``WHOLE`` turns all the same, as repeated or clustered turn numbers can bring
about, is split by turn, and a turn's rows into slots by their digest. Each row says its part, split and slot.

Turns are ordered by turn, then role, then text; a null turn comes last. A null role is a participant named 'unknown',
a null text an empty turn. Repeated rows are repeated turns. A conversation of system turns only gives no rows; one
with a null id is a conversation. An empty table gives an empty result. Marks inside a text are broken by a space.
Columns besides ``conv_id``, ``turn``, ``role`` and ``text`` are ignored. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import work

WHOLE, PART = 4_096, 1_024
SYSTEM = ("system",)
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LAST = (1 << 63) - 1


def _header(role: Column, speaker: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(role.isin(*SYSTEM), "system").when(role == speaker, "assistant").otherwise(F.concat(F.lit("user:"), role)), F.lit("\n"))


def _slot(rows: Column) -> Column:
    """One of so many slots that each holds a quarter of WHOLE rows, by a digest of role and text."""
    digest = F.md5(F.concat_ws("\n", "role", "text"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.ceil(4 * rows / WHOLE)).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with part, and split and slot, which are 0 but in crowded parts."""
    zero = F.lit(0).cast("long")
    at, same = F.coalesce("turn", F.lit(LAST)), lambda a, b: F.col(a).eqNullSafe(F.col(b))
    system = F.col("role").isin(*SYSTEM)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.min(F.when(~system, at)).alias("speaks"))
    long_ = work.put(sizes.filter(F.col("n") > WHOLE).withColumnRenamed("conv_id", "c"), "long")
    if long_.isEmpty():
        return turns.withColumn("part", zero).withColumn("split", zero).withColumn("slot", zero)
    turns = turns.join(long_, same("conv_id", "c"), "left")
    width = F.ceil((F.col("high").cast("double") - F.col("low") + 1) * PART / F.col("n"))
    part = F.when(F.col("turn").isNull(), F.ceil(F.col("n") / PART) + 1).otherwise(F.floor((F.col("turn").cast("double") - F.col("low")) / width)).cast("long")
    turns = turns.withColumn("part", F.when(F.col("n").isNull(), zero).otherwise(part))
    crowds = turns.filter("n is not null").groupBy("conv_id", "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > WHOLE)
    crowds = work.put(crowds.withColumnsRenamed({"conv_id": "c2", "part": "p2"}), "crowds")
    turns = turns.join(crowds, same("conv_id", "c2") & (F.col("part") == F.col("p2")), "left")
    many = F.col("rows").isNotNull()
    turns = turns.withColumn("split", F.when(many, at).otherwise(zero)).withColumn("slot", F.when(many, _slot(F.col("rows"))).otherwise(zero))
    keys = ["conv_id", "part", "split", "slot"]
    opening = turns.filter(F.col("n").isNotNull() & system & (at < F.col("speaks"))).select("conv_id", "turn", "role", "text", *[F.col(k).alias(f"own_{k}") for k in keys[1:]])
    parts = turns.filter("n is not null").select(*keys).distinct().withColumnRenamed("conv_id", "c3")
    again = opening.join(parts, same("conv_id", "c3")).filter("part <> own_part OR split <> own_split OR slot <> own_slot")
    names = ["conv_id", "turn", "role", "text", "part", "split", "slot"]
    return turns.select(names).unionByName(again.select(names))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, participant and part.

    conv_id, speaker, part, split, slot, n_turns, text, mask (array of structs start, end: characters from 0, end
    exclusive).
    """
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), clean.alias("text")
    )
    speakers = turns.filter(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    order = F.struct(F.isnull("turn").alias("none"), "turn", "role", "text")
    parts = _numbered(turns).groupBy("conv_id", "part", "split", "slot").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    told = parts.join(work.put(speakers, "speakers"), F.col("conv_id").eqNullSafe(F.col("c")))

    def piece(t: Column) -> Column:
        head = _header(t["role"], F.col("speaker"))
        body = F.concat(t["text"], F.lit(CLOSE))
        mine = (t["role"] == F.col("speaker")) & ~t["role"].isin(*SYSTEM)
        return F.struct(F.concat(head, body).alias("all"), F.char_length(head).cast("long").alias("head"), F.char_length(body).cast("long").alias("body"), mine.alias("mine"))

    told = told.withColumn("pieces", F.transform("turns", piece))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    span = lambda s, p: F.array(F.struct((s["at"] + p["head"]).alias("start"), (s["at"] + p["head"] + p["body"]).alias("end")))
    step = lambda s, p: F.struct((s["at"] + p["head"] + p["body"]).alias("at"), F.when(p["mine"], F.concat(s["mask"], span(s, p))).otherwise(s["mask"]).alias("mask"))
    mask = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("mask")), step, lambda s: s["mask"])
    text = F.concat_ws("", F.transform("pieces", lambda p: p["all"]))
    return told.select("conv_id", "speaker", "part", "split", "slot", F.size("turns").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def query(conversations: DataFrame) -> DataFrame:
    """The rotation with the mask as text, 'start-end' joined by commas."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), ",")
    return rotate(conversations).select("conv_id", "speaker", "part", "split", "slot", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask"))
