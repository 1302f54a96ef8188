"""Events and relationships of passages with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lexicons import EVENT_RULES, RELATION_RULES
from loreweave.functions.text import any_case, digest


def _first_of(rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.col("text").rlike(any_case(pattern)), F.lit(name)).otherwise(out)
    return out


def event_class(passages: DataFrame) -> DataFrame:
    return passages.withColumn("event_type", _first_of(EVENT_RULES)).where(F.col("event_type").isNotNull())


def relationship_class(passages: DataFrame) -> DataFrame:
    return passages.withColumn("relation_type", _first_of(RELATION_RULES)).where(F.col("relation_type").isNotNull())


def participants(linked: DataFrame) -> DataFrame:
    """passage_id and its entities in order of position, then id; its first place by id."""
    return linked.groupBy("passage_id").agg(F.array_sort(F.collect_set(F.struct("position", "entity_id", "canonical_name"))).alias("who"), F.min(F.when(F.col("entity_type") == "place", F.struct("entity_id", "canonical_name"))).alias("place"))


def event_obligations(events: DataFrame, obliged: DataFrame) -> DataFrame:
    """event_id, obligation_ids (sorted): obligations that share an anchor with the event, by an equi-join on anchors."""
    shared = events.select("event_id", F.explode("anchor_ids").alias("anchor_id")).join(obliged.select("obligation_id", F.explode("evidence_anchor_ids").alias("anchor_id")), "anchor_id")
    return shared.groupBy("event_id").agg(F.array_sort(F.collect_set("obligation_id")).alias("obligation_ids"))


def events(passages: DataFrame, linked: DataFrame, by_passage: DataFrame, obliged: DataFrame) -> DataFrame:
    """A row per passage with an event class and evidence. related_obligation_ids share an anchor with it."""
    e = event_class(passages).join(by_passage, "passage_id").join(participants(linked), "passage_id", "left")
    label = F.initcap(F.regexp_replace("event_type", "_", " "))
    title = F.when(F.col("place").isNull(), label).when(F.col("event_type") == "battle", F.concat(F.lit("Battle of "), F.col("place.canonical_name"))).otherwise(F.concat(label, F.lit(" at "), F.col("place.canonical_name")))
    e = e.withColumn("title", title).withColumn("event_id", digest("evt_", 12, F.col("event_type"), F.col("passage_id"), F.col("anchor_ids")[0], F.col("title")))
    e = e.join(event_obligations(e, obliged), "event_id", "left")
    none = F.array().cast("array<string>")
    return e.select("event_id", "event_type", "title", F.col("text").alias("description"), F.coalesce(F.transform("who", lambda w: w["entity_id"]), none).alias("participant_entity_ids"), F.col("place.entity_id").alias("location_entity_id"), F.coalesce("obligation_ids", none).alias("related_obligation_ids"), F.col("anchor_ids").alias("evidence_anchor_ids"), *_story())


def _story() -> list[Column]:
    text = lambda: F.lit(None).cast("string")
    return [F.struct(F.lit("unknown").alias("time_label"), text().alias("time_start"), text().alias("time_end")).alias("story_time"), F.struct(F.col("paragraph_index").alias("order_index"), F.col("passage_id").alias("order_label"), "source_id", "passage_id").alias("story_order")]


def relationships(passages: DataFrame, linked: DataFrame, by_passage: DataFrame) -> DataFrame:
    """A row per passage with a relation class, evidence and two entities: the first two by position."""
    r = relationship_class(passages).join(by_passage, "passage_id").join(participants(linked), "passage_id").where(F.size("who") >= 2)
    a, b = F.col("who")[0], F.col("who")[1]
    text = F.concat(F.initcap("relation_type"), F.lit(" between "), a["canonical_name"], F.lit(" and "), b["canonical_name"], F.lit("."))
    return r.select(digest("rel_", 12, F.col("relation_type"), F.col("passage_id"), F.col("anchor_ids")[0], a["entity_id"], b["entity_id"]).alias("relationship_id"), "relation_type", a["entity_id"].alias("source_entity_id"), b["entity_id"].alias("target_entity_id"), text.alias("description"), F.col("anchor_ids").alias("evidence_anchor_ids"), *_story())
