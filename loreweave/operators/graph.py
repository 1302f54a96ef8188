"""The property graph: nodes, edges and its queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import digest
from loreweave.sources.keyed_log import KeyedLog

#: Temporal properties of a node; null where a row has no place in the story.
TEMPORAL = {"story_time_label": "story_time.time_label", "story_time_start": "story_time.time_start", "story_time_end": "story_time.time_end", "story_order_index": "story_order.order_index", "story_order_label": "story_order.order_label", "story_order_source_id": "story_order.source_id", "story_order_passage_id": "story_order.passage_id"}


def _nodes(rows: DataFrame, label: str, node_id: str, temporal: bool, *own: str) -> DataFrame:
    """label, node_id, story columns, properties: JSON of the row's own columns with nulls, keys in order, and write: where in
    its table the row was written, if the table tells (order_hint)."""
    story = [F.col(p).alias(k) if temporal else F.lit(None).cast("int" if k.endswith("index") else "string").alias(k) for k, p in TEMPORAL.items()]
    return rows.select(F.lit(label).alias("label"), F.col(node_id).alias("node_id"), *story, F.to_json(F.struct(*sorted(own)), {"ignoreNullFields": "false"}).alias("properties"), (F.col("order_hint").cast("long") if "order_hint" in rows.columns else F.lit(0).cast("long")).alias("write"))


def graph_nodes(passages: DataFrame, anchors: DataFrame, named: DataFrame, obliged: DataFrame, happened: DataFrame, related: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    time = F.struct(nothing.alias("time_label"), nothing.alias("time_start"), nothing.alias("time_end"))
    placed = passages.withColumn("story_time", time).withColumn("story_order", F.struct(F.col("paragraph_index").alias("order_index"), nothing.alias("order_label"), "source_id", "passage_id"))
    every = [
        _nodes(placed, "Passage", "passage_id", True, "source_id", "paragraph_index", "text", "char_start", "char_end"),
        _nodes(anchors, "EvidenceAnchor", "anchor_id", False, "passage_id", "char_start", "char_end", "excerpt"),
        _nodes(named, "Entity", "entity_id", False, "canonical_name", "entity_type", "first_seen_passage", "mention_count"),
        _nodes(obliged, "Obligation", "obligation_id", False, "category", "description", "last_seen_passage_id", "confidence", "is_resolved", "resolution_passage_id"),
        _nodes(happened, "Event", "event_id", True, "event_type", "title", "description"),
        _nodes(related, "Relationship", "relationship_id", True, "relation_type", "source_entity_id", "target_entity_id", "description"),
    ]
    written = [rows.withColumn("seq", F.struct(F.lit(i).alias("table"), "write", "properties")) for i, rows in enumerate(every)]
    return latest(reduce(DataFrame.unionByName, written), ["label", "node_id"], "seq").drop("seq", "write")


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row per key, that with the largest by, which numbers the writes: an upsert in which the last write wins."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*key, "r.*").select(rows.columns)


def _edges(rows: DataFrame, kind: str, source: str, source_id: Column, target: str, target_id: Column) -> DataFrame:
    e = rows.select(source_id.alias("source_id"), target_id.alias("target_id")).where("source_id is not null and target_id is not null").distinct()
    return e.select(digest("edge_", 16, kind, source, F.col("source_id"), target, F.col("target_id")).alias("edge_id"), F.lit(kind).alias("rel_type"), F.lit(source).alias("source_label"), "source_id", F.lit(target).alias("target_label"), "target_id")


def graph_edges(anchors: DataFrame, named: DataFrame, obliged: DataFrame, happened: DataFrame, related: DataFrame) -> DataFrame:
    c, each = F.col, F.explode
    every = [
        _edges(anchors, "APPEARS_IN", "EvidenceAnchor", c("anchor_id"), "Passage", c("passage_id")),
        _edges(named, "APPEARS_IN", "Entity", c("entity_id"), "Passage", c("first_seen_passage")),
        _edges(obliged, "APPEARS_IN", "Obligation", c("obligation_id"), "Passage", c("last_seen_passage_id")),
        _edges(obliged, "RELATES_TO", "Obligation", c("obligation_id"), "Entity", each("related_entity_ids")),
        _edges(obliged, "SUPPORTED_BY", "Obligation", c("obligation_id"), "EvidenceAnchor", each("evidence_anchor_ids")),
        _edges(happened, "APPEARS_IN", "Event", c("event_id"), "Passage", c("story_order.passage_id")),
        _edges(happened, "PARTICIPATES_IN", "Entity", each("participant_entity_ids"), "Event", c("event_id")),
        _edges(happened, "LOCATED_AT", "Event", c("event_id"), "Entity", c("location_entity_id")),
        _edges(happened, "RESOLVES", "Event", c("event_id"), "Obligation", each("related_obligation_ids")),
        _edges(happened, "SUPPORTED_BY", "Event", c("event_id"), "EvidenceAnchor", each("evidence_anchor_ids")),
        _edges(related, "APPEARS_IN", "Relationship", c("relationship_id"), "Passage", c("story_order.passage_id")),
        _edges(related, "RELATES_TO", "Relationship", c("relationship_id"), "Entity", each(F.array("source_entity_id", "target_entity_id"))),
        _edges(related, "SUPPORTED_BY", "Relationship", c("relationship_id"), "EvidenceAnchor", each("evidence_anchor_ids")),
    ]
    return reduce(DataFrame.unionByName, every)


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("label").alias(f"{end}_label"), F.col("node_id").alias(f"{end}_id")), [f"{end}_label", f"{end}_id"], "left_semi")
    return edges


class GraphLog:
    """Nodes and edges that are written again and again: a key's last write counts, and an edge counts while both its ends are there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.nodes, self.edges = KeyedLog(spark, f"{root}/nodes", ["label", "node_id"]), KeyedLog(spark, f"{root}/edges", ["edge_id"])

    def upsert(self, sequence: int, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes.write(sequence, nodes, ["properties"])
        self.edges.write(sequence, edges, ["edge_id"])

    def read(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.nodes.read()
        return nodes, connected_edges(self.edges.read(), nodes)


def entity_context(happened: DataFrame, related: DataFrame, obliged: DataFrame, entity_id: str | None = None) -> DataFrame:
    """entity_id, kind (event, relationship, obligation), item_id: what takes an entity in; of one entity or all."""
    row = lambda rows, entity, kind, item: rows.select(entity.alias("entity_id"), F.lit(kind).alias("kind"), F.col(item).alias("item_id"))
    every = row(happened, F.explode("participant_entity_ids"), "event", "event_id")
    every = every.unionByName(row(related, F.explode(F.array("source_entity_id", "target_entity_id")), "relationship", "relationship_id"))
    every = every.unionByName(row(obliged, F.explode("related_entity_ids"), "obligation", "obligation_id")).where("entity_id is not null")
    return (every if entity_id is None else every.where(F.col("entity_id") == entity_id)).distinct()


def uniqueness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key, n of labels with ids, and edge ids, that are there more than once."""
    n = nodes.groupBy(F.col("label").alias("kind"), F.col("node_id").alias("key")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.col("rel_type").alias("kind"), F.col("edge_id").alias("key")).agg(F.count("*").alias("n"))
    return n.unionByName(e).where("n > 1")


def events_for_entity(edges: DataFrame, happened: DataFrame, entity_id: str | None = None) -> DataFrame:
    """entity_id, event_id, title, event_type, story_time_label, story_order_index, location_entity_id; of one entity or all."""
    e = edges.where("rel_type = 'PARTICIPATES_IN'").select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("event_id"))
    e = e if entity_id is None else e.where(F.col("entity_id") == entity_id)
    place = edges.where("rel_type = 'LOCATED_AT'").select(F.col("source_id").alias("event_id"), F.col("target_id").alias("location_entity_id"))
    out = e.join(happened, "event_id").select("entity_id", "event_id", "title", "event_type", F.col("story_time.time_label").alias("story_time_label"), F.col("story_order.order_index").alias("story_order_index"))
    return out.join(place, "event_id", "left").orderBy(F.asc_nulls_last("story_order_index"), "event_id", "entity_id")


def active_during(related: DataFrame, time: str) -> DataFrame:
    """Relationships whose story time is labelled time or includes it; times compare as strings."""
    label, start, end = (F.col(f"story_time.time_{x}") for x in ("label", "start", "end"))
    held = (label == time) | ((start <= time) & (end >= time)) | ((start <= time) & end.isNull())
    return related.where(held).select("relationship_id", "relation_type", "source_entity_id", "target_entity_id", label.alias("story_time_label"), start.alias("story_time_start"), end.alias("story_time_end"), F.col("story_order.order_index").alias("story_order_index")).orderBy(F.asc_nulls_last("story_order_index"), "relationship_id")


def obligations_resolved(edges: DataFrame, obliged: DataFrame, event_id: str | None = None) -> DataFrame:
    e = edges.where("rel_type = 'RESOLVES'").select(F.col("source_id").alias("event_id"), F.col("target_id").alias("obligation_id"))
    e = e if event_id is None else e.where(F.col("event_id") == event_id)
    return e.join(obliged, "obligation_id").select("event_id", "obligation_id", "category", "description", "confidence", "is_resolved").orderBy("event_id", "obligation_id")


def evidence_for_relationship(edges: DataFrame, anchors: DataFrame, passages: DataFrame, relationship_id: str | None = None) -> DataFrame:
    e = edges.where("rel_type = 'SUPPORTED_BY' and source_label = 'Relationship'").select(F.col("source_id").alias("relationship_id"), F.col("target_id").alias("anchor_id"))
    e = e if relationship_id is None else e.where(F.col("relationship_id") == relationship_id)
    seen = edges.where("rel_type = 'APPEARS_IN' and source_label = 'EvidenceAnchor'").select(F.col("source_id").alias("anchor_id"), F.col("target_id").alias("passage_id"))
    out = e.join(seen, "anchor_id").join(anchors.select("anchor_id", "excerpt"), "anchor_id").join(passages.select("passage_id", "source_id", "paragraph_index"), "passage_id")
    return out.select("relationship_id", "anchor_id", "excerpt", "passage_id", "source_id", "paragraph_index").orderBy("source_id", "paragraph_index", "anchor_id", "relationship_id")


def timeline(edges: DataFrame, happened: DataFrame, related: DataFrame, entity_id: str | None = None) -> DataFrame:
    """entity_id, item_type, item_id, label, story_time_label, story_order_index over events and relationships."""
    story = lambda rows, key, label, kind: rows.select(F.col(key).alias("item_id"), F.lit(kind).alias("item_type"), F.col(label).alias("label"), F.col("story_time.time_label").alias("story_time_label"), F.col("story_order.order_index").alias("story_order_index"))
    part = edges.where("rel_type = 'PARTICIPATES_IN'").select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("item_id"))
    linked = edges.where("rel_type = 'RELATES_TO' and source_label = 'Relationship'").select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("item_id"))
    out = part.join(story(happened, "event_id", "title", "event"), "item_id").unionByName(linked.join(story(related, "relationship_id", "description", "relationship"), "item_id"))
    out = out if entity_id is None else out.where(F.col("entity_id") == entity_id)
    return out.select("entity_id", "item_type", "item_id", "label", "story_time_label", "story_order_index").orderBy(F.asc_nulls_last("story_order_index"), "item_id", "entity_id")


#: Queries by name with the parameter that each needs.
QUERIES = {"events_for_entity": "entity_id", "relationships_active_during": "time_value", "obligations_resolved_by_event": "event_id", "evidence_for_relationship": "relationship_id", "timeline_for_entity": "entity_id"}


def query_graph(name: str, tables: dict[str, DataFrame], **parameters: str) -> DataFrame:
    if name not in QUERIES:
        raise ValueError(f"no query named {name}")
    if not (value := parameters.get(QUERIES[name])):
        raise ValueError(f"{name} needs {QUERIES[name]}")
    t = tables
    return {
        "events_for_entity": lambda: events_for_entity(t["edges"], t["events"], value),
        "relationships_active_during": lambda: active_during(t["relationships"], value),
        "obligations_resolved_by_event": lambda: obligations_resolved(t["edges"], t["obligations"], value),
        "evidence_for_relationship": lambda: evidence_for_relationship(t["edges"], t["anchors"], t["passages"], value),
        "timeline_for_entity": lambda: timeline(t["edges"], t["events"], t["relationships"], value),
    }[name]()
