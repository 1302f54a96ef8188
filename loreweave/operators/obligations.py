"""Narrative obligations with their evidence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lexicons import CATEGORIES, OBLIGATION_RULES, ObligationRule
from loreweave.functions.text import any_case, digest, spans


def obligation_matches(passages: DataFrame, rules: Iterable[ObligationRule] = OBLIGATION_RULES) -> DataFrame:
    """A row per match of a rule, before equal ids meet: category, family, pattern_seq, description, confidence, link,
    passage columns and offsets in the passage. All rules run in one pass over a passage."""
    rules = tuple(rules)
    questions = [spans(F.col("text"), any_case(p)) for r in rules for p in r.patterns if r.category == "mystery" and r.family == 1]
    asked = F.concat(*questions) if questions else F.array().cast("array<struct<start:int,end:int,excerpt:string>>")
    p = passages.withColumn("asked", asked)
    each = []
    for r in rules:
        for i, pattern in enumerate(r.patterns):
            found = spans(F.col("text"), any_case(pattern))
            if r.fragment:
                found = F.filter(found, lambda s: ~F.exists("asked", lambda q: (q["start"] <= s["start"]) & (s["end"] <= q["end"])))
            each.append(F.transform(found, _row(r, i)))
    return p.select("passage_id", "source_id", "order_hint", "paragraph_index", "text", F.explode(F.concat(*each)).alias("o")).select("passage_id", "source_id", "order_hint", "paragraph_index", "text", "o.*")


def _row(r: ObligationRule, i: int):
    def row(s: Column) -> Column:
        return F.struct(
            F.lit(r.category).alias("category"), F.lit(CATEGORIES.index(r.category)).alias("category_seq"), F.lit(r.family).alias("family"), F.lit(i).alias("pattern_seq"),
            F.concat(F.lit(f"{r.head}: '"), s["excerpt"], F.lit("'")).alias("description"), F.lit(r.confidence).alias("confidence"), F.lit(r.link).cast("string").alias("link"),
            s["start"].alias("char_start"), s["end"].alias("char_end"), s["excerpt"].alias("excerpt"),
        )

    return row


def with_ids(found: DataFrame) -> DataFrame:
    """Adds obligation_id, by category, passage and matched text in lower case, and anchor_id, by passage and offsets."""
    return found.withColumn("obligation_id", digest("obl_", 12, F.col("category"), F.col("passage_id"), F.lower("excerpt"), by=":")).withColumn("anchor_id", digest("anc_", 12, F.col("passage_id"), F.col("char_start"), F.col("char_end"), by=":"))


def obligations(matches: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per obligation_id, of matches with ids: equal ids become one row whose evidence is all their anchors in order of offset.

    linked: passage_id, entity_id, entity_type of entities in a passage; a rule relates those of its type, by id.
    """
    order = F.struct("category_seq", "order_hint", "source_id", "paragraph_index", "family", "pattern_seq", "char_start")
    first = F.struct("category", "category_seq", "description", "confidence", "link", "passage_id")
    o = matches.groupBy("obligation_id").agg(F.min_by(first, order).alias("f"), F.min(order).alias("seq"), F.array_sort(F.collect_set(F.struct("char_start", "char_end", "anchor_id"))).alias("a"))
    o = o.select("obligation_id", "f.*", "seq", F.transform("a", lambda x: x["anchor_id"]).alias("anchors"))
    own = linked.select("passage_id", F.col("entity_type").alias("link"), "entity_id").groupBy("passage_id", "link").agg(F.array_sort(F.collect_set("entity_id")).alias("related"))
    o = o.join(own, ["passage_id", "link"], "left")
    return o.select("obligation_id", "category", "description", F.array_distinct("anchors").alias("evidence_anchor_ids"), F.col("passage_id").alias("last_seen_passage_id"), "confidence", F.lit(False).alias("is_resolved"), F.lit(None).cast("string").alias("resolution_passage_id"), F.coalesce("related", F.array().cast("array<string>")).alias("related_entity_ids"), "seq")


def obligation_anchors(matches: DataFrame) -> DataFrame:
    return matches.select("anchor_id", "passage_id", "char_start", "char_end", "excerpt").distinct()


def evidence_index(obliged: DataFrame) -> DataFrame:
    """index_id, target_type, target_id, anchor_ids (joined by ;) of obligations with evidence."""
    return obliged.where(F.size("evidence_anchor_ids") > 0).select(digest("idx_", 16, "obligation", F.col("obligation_id")).alias("index_id"), F.lit("obligation").alias("target_type"), F.col("obligation_id").alias("target_id"), F.array_join("evidence_anchor_ids", ";").alias("anchor_ids"))


def anchors_by_passage(anchors: DataFrame) -> DataFrame:
    """passage_id and its anchor ids, sorted, repeats kept."""
    return anchors.groupBy("passage_id").agg(F.array_sort(F.collect_list("anchor_id")).alias("anchor_ids"))


def resolve_evidence(obliged: DataFrame, anchors: DataFrame) -> DataFrame:
    """obligation_id, position, anchor_id, passage_id, excerpt: evidence in its order, without anchors that do not exist."""
    e = obliged.select("obligation_id", F.posexplode("evidence_anchor_ids").alias("position", "anchor_id"))
    return e.join(anchors.select("anchor_id", "passage_id", "excerpt"), "anchor_id").select("obligation_id", "position", "anchor_id", "passage_id", "excerpt")
