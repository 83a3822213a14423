"""Review tables: rubric scores, final texts, roll-ups, maps of lines, sign-ups, contexts of directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as tx

# fixed values: the rubric of a review, and what a review may decide
RUBRIC = [
    "intent_and_contract", "voice_and_style", "character_integrity", "dialogue_realism", "culture_and_references", "continuity", "meaning_precision", "sensitive_content", "typography_and_format", "edge_cases",
]
DECISIONS = ("accept", "minor_rewrite", "major_rewrite")
# fixed values: fields of a deletion payload, what it may delete, and the confidence from which it is taken
PAYLOAD = ["line_id", "line_start", "line_end", "matched_source_span", "deletion_type", "delete_text", "reason_summary", "metric_tags", "confidence", "ambiguity_flags"]
DELETION_TYPES = ["phrase", "clause", "sentence", "full_sentence"]
CONFIDENT = 0.7


def rubric_scores(reviews: DataFrame, keys: list[str] = RUBRIC) -> DataFrame:
    """Scores kept within 0 to 5, what can't be read as 0, and their total."""
    out = reviews.select("paragraph_id", *[tx.clamp_score(F.col(k)).alias(k) for k in keys])
    return out.withColumn("total_score", sum((F.col(k) for k in keys), F.lit(0)))


def paragraph_ids(rows: DataFrame) -> DataFrame:
    """Rows (group_id, position, paragraph_id) in which a missing id is made of the place, from 1."""
    w = Window.partitionBy("group_id").orderBy("position")
    return rows.withColumn("paragraph_id", F.coalesce("paragraph_id", F.format_string("paragraph_%04d", F.row_number().over(w))))


def final_texts(translated: DataFrame, source: DataFrame, reviews: DataFrame) -> DataFrame:
    """The text that a review's decision leaves: the revision for a rewrite, if there is one, else the translation."""
    own = translated.join(source, "paragraph_id", "left").join(reviews, "paragraph_id", "left")
    revised = F.trim(F.coalesce(F.when(F.col("revised") != "", F.col("revised")), F.col("translation")))
    final = F.when(F.col("decision").isin("minor_rewrite", "major_rewrite"), tx.first_filled(revised, F.col("translation"))).otherwise(F.col("translation"))
    return own.select("paragraph_id", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("decision", F.lit("missing")).alias("decision"), final.alias("final_text"))


def failed_review(paragraph_id: Column, keys: list[str] = RUBRIC) -> list[Column]:
    """The row that stands for a review that failed: zero scores and a major rewrite."""
    return [paragraph_id.alias("paragraph_id"), *[F.lit(0).alias(k) for k in keys], F.lit("major_rewrite").alias("decision")]


def mapped(candidates: DataFrame, typography: DataFrame, rework_required: bool) -> DataFrame:
    """Every candidate with its typography row, or 'missing', and the one roll-up of the critics."""
    out = candidates.select("paragraph_id").join(typography, "paragraph_id", "left")
    return out.select("paragraph_id", F.coalesce("decision", F.lit("missing")).alias("decision"), F.coalesce("hard_fail", F.lit(False)).alias("hard_fail"), F.lit(0 if rework_required else 1).cast("long").alias("critics_pass"))


def critics_rollup(critics: DataFrame, by: str) -> DataFrame:
    """Of critics (by, critic_id, verdict, fundamental): whether rework is required, and counts."""
    rework = F.col("verdict") == "rework"
    failing = F.array_join(F.sort_array(F.collect_set(F.when(rework, F.col("critic_id")))), ",")
    return critics.groupBy(by).agg(
        F.bool_or(rework | F.col("fundamental")).alias("rework_required"), F.count_if("fundamental").alias("fundamental_problems"), F.count("*").alias("critics"), F.count_if(~rework).alias("passing"), F.count_if(rework).alias("failing"), failing.alias("failing_critics")
    )


def line_map(rows: DataFrame) -> DataFrame:
    """First and last line of each paragraph of a text in which one blank line parts them."""
    w = Window.partitionBy("manuscript_id").orderBy("doc_id")
    n = rows.select("manuscript_id", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    start = F.coalesce(F.sum(F.col("lines") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return n.select("manuscript_id", "doc_id", start.alias("start_line"), (start + F.col("lines") - 1).alias("end_line"))


def new_signups(stored: DataFrame, signups: DataFrame) -> DataFrame:
    """Sign-ups (lang, email, ts) that aren't stored, one of each pair, first by time, safe for spreadsheets."""
    first = signups.groupBy("lang", "email").agg(F.min("ts").alias("ts"))
    fresh = first.join(stored.select("lang", "email"), ["lang", "email"], "left_anti")
    return fresh.select("lang", F.regexp_replace("email", r"^([=+\-@])", "'$1").alias("email"), "ts")


def context_top(items: DataFrame, sentences: DataFrame, k: int = 8) -> DataFrame:
    """For each item (group_id, item_id, text) the k sentences (group_id, position, text) that share the most terms, the earliest of equals.

    An item that shares a term with none gets the first k. ``place`` is a sentence's place among them in the text's order.
    """
    a = items.select("group_id", "item_id", F.explode(tx.search_terms(F.col("text"))).alias("term"))
    b = sentences.select("group_id", "position", F.explode(tx.search_terms(F.col("text"))).alias("term"))
    shared = a.join(b, ["group_id", "term"]).groupBy("group_id", "item_id", "position").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("group_id", "item_id")
    best = shared.withColumn("n", F.row_number().over(w.orderBy(F.desc("shared"), F.asc("position")))).filter(F.col("n") <= k)
    first = sentences.select("group_id", "position").withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy("position"))).filter(F.col("n") <= k)
    rest = items.select("group_id", "item_id").join(best.select("group_id", "item_id").distinct(), ["group_id", "item_id"], "left_anti").join(first, "group_id")
    out = best.unionByName(rest.select("group_id", "item_id", "position", F.lit(0).cast("long").alias("shared"), "n"))
    return out.select("group_id", "item_id", "position", "shared", F.row_number().over(w.orderBy("position")).cast("long").alias("place"))


def context_band(items: DataFrame, sentences: DataFrame, width: int) -> DataFrame:
    """For items (group_id, item_id, start, end) the sentences from ``width`` before to ``width`` after."""
    met = items.join(sentences.select("group_id", "position"), "group_id")
    return met.filter((F.col("position") >= F.coalesce("start", "end") - width) & (F.col("position") <= F.coalesce("end", "start") + width)).select("group_id", "item_id", "position")


_BULLET = r"^([-*]|\d+[.)])\s+"


def directives(lines: DataFrame) -> DataFrame:
    """Items of a directive text (doc_id, text): bullets, numbers and lines that start with cull or delete, headings aside; without any, all lines but headings."""
    each = lines.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("i", "raw"))
    each = each.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("value")).filter(~F.col("value").rlike("^(#|$)"))
    each = each.withColumn("marked", F.col("value").rlike(_BULLET) | F.lower("value").rlike("^(cull|delete)"))
    any_ = each.groupBy("doc_id").agg(F.max("marked").alias("any_marked"))
    kept = each.join(any_, "doc_id").filter(F.col("marked") | ~F.col("any_marked"))
    return kept.select("doc_id", F.format_string("item_%04d", "line").alias("item_id"), F.when(F.col("marked"), F.regexp_replace("value", _BULLET, "")).otherwise(F.col("value")).alias("item"))


def applied_edit(text: Column, excerpt: Column, sentence: Column, correction: Column) -> Column:
    """Struct mode, text: the first excerpt replaced; else the whole text, if it is the issue's sentence or as a last resort."""
    stripped = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    part, whole, new = stripped(excerpt), stripped(sentence), F.coalesce(correction, F.lit(""))
    out = lambda mode, value: F.struct(F.lit(mode).alias("mode"), value.alias("text"))
    put = F.overlay(text, new, F.instr(text, part), F.char_length(part))
    is_sentence = (whole != "") & (stripped(text) == whole)
    return (
        F.when((part != "") & F.contains(text, part), out("replaced_excerpt", put))
        .when(is_sentence & (new != "") & (new != whole), out("replaced_whole_sentence", new))
        .when(~is_sentence & (new != "") & (new != text), out("fallback_replaced_whole_sentence", new))
        .otherwise(out("no_change", text))
    )


def payload_errors(payload: Column) -> Column:
    """What is wrong with a deletion payload (a JSON object as text): missing fields in their order, then invalid ones."""
    v = F.try_parse_json(payload)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(field(name)), F.lit("VOID"))
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    number = F.when(kind("confidence") == "BOOLEAN", F.try_variant_get(v, "$.confidence", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$.confidence", "double"))
    numeric = kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$") & number.between(0, 1)
    codes = [F.when(~F.coalesce(F.array_contains(F.json_object_keys(payload), name), F.lit(False)), f"missing:{name}") for name in PAYLOAD]
    codes.append(F.when(~((kind("deletion_type") == "STRING") & F.coalesce(text("deletion_type").isin(DELETION_TYPES), F.lit(False))), "invalid:deletion_type"))
    codes += [F.when(~kind(name).isin("BIGINT", "BOOLEAN", "VOID"), f"invalid:{name}") for name in ("line_start", "line_end")]
    codes.append(F.when(~F.coalesce(numeric, F.lit(False)), "invalid:confidence"))
    codes += [F.when(~kind(name).startswith("ARRAY"), f"invalid:{name}") for name in ("metric_tags", "ambiguity_flags")]
    codes += [F.when(kind(name) != "STRING", f"invalid:{name}") for name in ("matched_source_span", "delete_text", "reason_summary")]
    return F.when(v.isNull(), F.array(F.lit("invalid_json"))).otherwise(F.array_compact(F.array(*codes)))


def accepted_attempts(attempts: DataFrame, threshold: float = CONFIDENT) -> DataFrame:
    """For each item of attempts (item_id, attempt, payload): the first without errors and sure enough, else none and a manual review.

    low_confidence says whether an attempt failed for its confidence alone.
    """
    sure = F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.confidence", "double"), F.lit(0.0))
    each = attempts.withColumn("valid", F.size(payload_errors(F.col("payload"))) == 0).withColumn("sure", sure)
    good = F.col("valid") & (F.col("sure") >= threshold)
    out = each.groupBy("item_id").agg(F.min(F.when(good, F.col("attempt"))).alias("attempt"), F.bool_or(F.col("valid") & (F.col("sure") < threshold)).alias("low_confidence"))
    return out.withColumn("manual_review", F.col("attempt").isNull())


def in_reading_order(rows: DataFrame) -> DataFrame:
    """Rows (manuscript_id, sentence_index, position) numbered by sentence; equal ones keep the order in which they came."""
    w = Window.partitionBy("manuscript_id").orderBy("sentence_index", "position")
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def released(results: DataFrame, group: str = "run_id") -> DataFrame:
    """The results (run_id, position from 0) that can be written in order: those before the first that is still missing."""
    w = Window.partitionBy(group).orderBy("position")
    return results.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") == F.col("position")).drop("_n")


def objectives(issues: DataFrame) -> DataFrame:
    """For each issue (issue_id, issue_type, anchor_text, source_tool) its objective and the pending proposal for it."""
    # fixed values: what every objective asks for
    text = F.col("anchor_text")
    hard = F.when(F.length(text) > 0, text).otherwise("Preserve anchored entities and claims.")
    kind = F.coalesce(F.when(F.col("issue_type") != "", F.col("issue_type")), F.lit("style"))
    soft = F.array(F.lit("Maintain original authorial voice."), F.lit("Prefer concise, direct phrasing."), F.concat(F.lit("Prioritize improvements for issue type '"), kind, F.lit("'.")))
    targets = F.struct(
        F.struct(F.lit(0.2).alias("min"), F.lit(0.8).alias("max")).alias("surprisal_range"),
        F.struct(F.lit(-0.15).alias("min"), F.lit(0.25).alias("max")).alias("entropy_delta_bounds"),
        F.struct(F.lit(5).alias("target_min"), F.lit(35).alias("target_max")).alias("repetition_reduction_pct"),
    )
    accept = F.struct(F.lit(3).alias("min_required_metrics"), F.array(F.lit("hard_constraints_preserved"), F.lit("surprisal_range")).alias("must_pass"))
    rollback = F.array(F.lit("Any hard constraint is violated."), F.lit("Entropy delta drops below lower bound."), F.lit("Repetition increases relative to baseline."))
    return issues.select(
        "issue_id", F.concat(F.lit("objective-"), "issue_id").alias("objective_id"), F.concat(F.lit("proposal-"), "issue_id").alias("proposal_id"), F.lit("pending").alias("status"),
        F.struct(F.lit("entity").alias("type"), hard.alias("value")).alias("hard_constraint"), soft.alias("soft_constraints"), targets.alias("metric_targets"), accept.alias("acceptance"),
        rollback.alias("rollback_criteria"), kind.alias("issue_type"), "source_tool",
    )


def coloured(resolved: DataFrame, extracted: DataFrame, warnings: int = 5) -> DataFrame:
    """Rows (colour, summary, details) of a plan: green what is new, yellow its first warnings, red its first conflict.

    ``resolved`` is the outcome of name resolution; ``extracted`` has position, kind (event, state or relationship) and details.
    First is what comes first in the payload: by ``position``, or by temp_id if ``resolved`` has none.
    """
    order = "position" if "position" in resolved.columns else "temp_id"
    new = resolved.filter("outcome = 'new'").select(F.lit("green").alias("colour"), F.lit("New entity").alias("summary"), F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("details"))
    kind = F.when(F.col("kind") == "event", "New event").when(F.col("kind") == "state", "State change").otherwise("Relationship")
    out = new.unionByName(extracted.select(F.lit("green").alias("colour"), kind.alias("summary"), "details"))
    # fixed values: the sentences of warnings and conflicts
    promoted = (
        F.when(F.col("outcome") == "ontology", F.format_string("Promote canonical name from '%s' to '%s'.", "old_name", "name"))
        .when(F.col("outcome") == "generic_placeholder_upgrade", F.format_string("Upgrading generic placeholder '%s' to specific name '%s'.", "old_name", "name"))
        .otherwise(F.format_string("Fuzzy match %s%% from generic '%s' to specific '%s'.", F.format_number("score", 1), "old_name", "name"))
    )
    warning = lambda given, name, text: F.when(given, F.struct(F.lit(name).alias("summary"), text.alias("details")))
    warned = F.array_compact(F.array(warning(F.col("old_name").isNotNull(), "name_promotion", promoted), warning(F.col("is_new_mismatch"), "is_new_mismatch", F.lit("Extractor flagged is_new=true but ontology had an exact match."))))
    first = resolved.select(order, F.posexplode(warned).alias("i", "x")).orderBy(order, "i").limit(warnings)
    out = out.unionByName(first.select(F.lit("yellow").alias("colour"), "x.summary", "x.details"))
    conflict = resolved.filter("outcome = 'conflict'").orderBy(order).limit(1)
    reason = F.concat(F.lit("Fuzzy match score "), F.format_number("score", 1), F.lit("% exceeds threshold"))
    return out.unionByName(conflict.select(F.lit("red").alias("colour"), F.lit("Conflicts").alias("summary"), reason.alias("details")))
