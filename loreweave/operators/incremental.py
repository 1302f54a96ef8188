"""What a change of sources touches, and how stores take it in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched(changed: DataFrame, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each table that changed sources (source_id) touch: their passages, the anchors of these, obligations
    last seen there or with such an anchor, events and relationships of the source, passage, anchor or obligation, and
    entities that any of these name or that were first seen there. Semi-joins all the way."""
    c, semi, each = F.col, "left_semi", F.explode
    passages = t["passages"].join(changed, "source_id", semi)
    at = passages.select("passage_id")
    anchors = t["anchors"].join(at, "passage_id", semi)
    known = anchors.select("anchor_id").distinct()

    def holding(rows: DataFrame, key: str, *ids: DataFrame) -> DataFrame:
        found = reduce(DataFrame.unionByName, ids).distinct()
        return rows.join(found, key, semi)

    def by(rows: DataFrame, key: str, array: str, hits: DataFrame, name: str) -> DataFrame:
        return rows.select(key, each(array).alias(name)).join(hits, name, semi).select(key)

    o = t["obligations"]
    obligations = holding(o, "obligation_id", o.join(at, c("last_seen_passage_id") == c("passage_id"), semi).select("obligation_id"), by(o, "obligation_id", "evidence_anchor_ids", known, "anchor_id"))
    story = lambda rows, key: rows.select(key, c("story_order.source_id").alias("source_id"), c("story_order.passage_id").alias("passage_id"))
    e, r = t["events"], t["relationships"]
    of = obligations.select("obligation_id")
    events = holding(e, "event_id", story(e, "event_id").join(changed, "source_id", semi).select("event_id"), story(e, "event_id").join(at, "passage_id", semi).select("event_id"), by(e, "event_id", "evidence_anchor_ids", known, "anchor_id"), by(e, "event_id", "related_obligation_ids", of, "obligation_id"))
    relationships = holding(r, "relationship_id", story(r, "relationship_id").join(changed, "source_id", semi).select("relationship_id"), story(r, "relationship_id").join(at, "passage_id", semi).select("relationship_id"), by(r, "relationship_id", "evidence_anchor_ids", known, "anchor_id"))
    names = [obligations.select(each("related_entity_ids").alias("entity_id")), events.select(each("participant_entity_ids").alias("entity_id")), events.select(c("location_entity_id").alias("entity_id")), relationships.select(c("source_entity_id").alias("entity_id")), relationships.select(c("target_entity_id").alias("entity_id"))]
    n = t["entities"]
    entities = holding(n, "entity_id", *names, n.join(at, c("first_seen_passage") == c("passage_id"), semi).select("entity_id"))
    return {"passages": passages, "anchors": anchors, "obligations": obligations, "events": events, "relationships": relationships, "entities": entities}


def payload(changed: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """store, id of every touched row."""
    ids = {"passages": "passage_id", "anchors": "anchor_id", "obligations": "obligation_id", "events": "event_id", "relationships": "relationship_id", "entities": "entity_id"}
    rows = touched(changed, t)
    return reduce(DataFrame.unionByName, [rows[k].select(F.lit(k).alias("store"), F.col(v).alias("id")).distinct() for k, v in ids.items()])


def updated(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """A store by source after a change: rows of other sources as they were, those of changed sources anew."""
    return stored.join(changed, "source_id", "left_anti").unionByName(fresh)
