"""Mentions, entities, aliases and their evidence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lexicons import COMMON_WORDS, MENTION_RULES, PLACES, VEHICLE_WORDS, MentionRule
from loreweave.functions.text import folded_digest, led, spans

CONTEXT = 100
MENTIONS = "array<struct<rule_seq:int,pattern_seq:int,canonical_name:string,entity_type:string,char_start:int,char_end:int,excerpt:string>>"


def _of_rule(rule: MentionRule, ordinal: int) -> Column:
    """What one rule finds in a passage, as (rule_seq, pattern_seq, name, kind, start, end, excerpt)."""
    found = spans(F.col("text"), "(?U)" + led(rule.pattern))
    if rule.kind == "vehicle":
        near = lambda s: F.lower(F.concat(F.substring("text", F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT))), F.lit(" "), s["excerpt"], F.lit(" "), F.substring("text", s["end"] + 1, F.lit(CONTEXT))))
        found = F.filter(found, lambda s: near(s).rlike("|".join(VEHICLE_WORDS)))
    if rule.seq == 6:
        first = lambda s: F.split(s["excerpt"], r"(?U)\s+")[0]
        found = F.filter(found, lambda s: ~first(s).isin(*COMMON_WORDS) & ~s["excerpt"].startswith("House "))

    def mention(s: Column) -> Column:
        name = F.concat(F.lit("The "), F.substring(s["excerpt"], F.lit(5), F.length(s["excerpt"]))) if rule.kind == "vehicle" else s["excerpt"]
        kind = F.when(s["excerpt"].isin(*PLACES), F.lit("place")).otherwise(F.lit(rule.kind)) if rule.seq == 6 else F.lit(rule.kind)
        return F.struct(F.lit(rule.seq).alias("rule_seq"), F.lit(ordinal).alias("pattern_seq"), name.alias("canonical_name"), kind.alias("entity_type"), s["start"].alias("char_start"), s["end"].alias("char_end"), s["excerpt"].alias("excerpt"))

    return F.transform(found, mention)


def mentions(passages: DataFrame, rules: Iterable[MentionRule] = MENTION_RULES, ignored: DataFrame | None = None) -> DataFrame:
    """A row per mention: the passage's id and order, rule_seq, pattern_seq, name, type, offsets in the passage, excerpt.

    All rules run in one pass over a passage. ignored: names (canonical_name) that are no mentions.
    """
    numbered = list(enumerate(rules))
    fixed = [(i, r) for i, r in numbered if r.seq <= 4]  # most passages hold none of their words: one search tells
    each = [_of_rule(r, i) for i, r in numbered if r.seq > 4]
    if fixed:
        some = F.concat(*[_of_rule(r, i) for i, r in fixed])
        each.append(F.when(F.col("text").rlike("(?U)" + led("|".join(r.pattern for _, r in fixed))), some).otherwise(F.array().cast(MENTIONS)))
    found = F.concat(*each)
    out = passages.select("passage_id", "source_id", "order_hint", "paragraph_index", F.explode(found).alias("m")).select("passage_id", "source_id", "order_hint", "paragraph_index", "m.*")
    return out if ignored is None else out.join(ignored.select("canonical_name"), "canonical_name", "left_anti").select(out.columns)


#: Where a mention stands in the order of all, and behind that what its name is if it is the first.
FIRST_MENTION = ("order_hint", "source_id", "paragraph_index", "rule_seq", "pattern_seq", "char_start", "entity_type", "passage_id")


def entities(found: DataFrame, vehicle_min: int = 3, forced: DataFrame | None = None) -> DataFrame:
    """entity_id, canonical_name, entity_type, first_seen_passage, mention_count: one row per name.

    Type and passage are those of the first mention; a name first seen as a vehicle needs vehicle_min mentions, or to be
    in forced (canonical_name, entity_id), whose ids win.
    """
    e = found.groupBy("canonical_name").agg(F.min(F.struct(*FIRST_MENTION)).alias("first"), F.count("*").alias("mention_count"))
    return entities_of(e, vehicle_min, forced)


def entities_of(e: DataFrame, vehicle_min: int = 3, forced: DataFrame | None = None) -> DataFrame:
    """Entities from a row per name: canonical_name, first (FIRST_MENTION) and mention_count."""
    e = e.select("canonical_name", F.col("first.entity_type").alias("entity_type"), F.col("first.passage_id").alias("first_seen_passage"), "mention_count")
    e = e.withColumn("forced_id", F.lit(None).cast("string")) if forced is None else e.join(forced.select("canonical_name", F.col("entity_id").alias("forced_id")), "canonical_name", "left")
    e = e.where((F.col("entity_type") != "vehicle") | (F.col("mention_count") >= vehicle_min) | F.col("forced_id").isNotNull())
    return e.select(F.coalesce("forced_id", folded_digest("entity_", F.col("canonical_name"), F.col("entity_type"))).alias("entity_id"), "canonical_name", "entity_type", "first_seen_passage", "mention_count")


def aliases(named: DataFrame) -> DataFrame:
    """alias_id, alias_text, entity_id, confidence: the name at 1, its first word at 0.8 unless that is common or itself a
    name, its last at 0.7 for persons unless common."""
    part = F.split("canonical_name", r"(?U)\s+")
    more = F.size(part) > 1
    first, last = part[0], F.get(part, F.size(part) - 1)
    row = lambda text, confidence: F.struct(text.alias("alias_text"), F.lit(confidence).alias("confidence"))
    a = named.select("entity_id", F.explode(F.array(
        row(F.col("canonical_name"), 1.0),
        F.when(more & ~first.isin(*COMMON_WORDS), row(first, 0.8)),
        F.when(more & (F.col("entity_type") == "person") & ~last.isin(*COMMON_WORDS), row(last, 0.7)),
    )).alias("a")).where("a is not null").select("entity_id", "a.*")
    names = named.select(F.col("canonical_name").alias("alias_text"), F.lit(0.8).alias("confidence")).distinct()
    a = a.join(names, ["alias_text", "confidence"], "left_anti")
    return a.select(folded_digest("alias_", F.col("alias_text"), F.col("entity_id")).alias("alias_id"), "alias_text", "entity_id", "confidence")


def entity_anchors(found: DataFrame, named: DataFrame) -> DataFrame:
    """anchor_id, passage_id, char_start, char_end, excerpt of the mentions of entities that stayed, each once."""
    kept = found.join(named.select("canonical_name"), "canonical_name", "left_semi")
    return kept.select(folded_digest("anchor_", F.col("passage_id"), F.col("char_start").cast("string"), F.col("char_end").cast("string")).alias("anchor_id"), "passage_id", "char_start", "char_end", "excerpt").distinct()


def with_aliases(named: DataFrame, known: DataFrame) -> DataFrame:
    """entity_id, canonical_name and the sorted texts of its aliases, joined by ;"""
    own = known.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias_text")), ";").alias("aliases"))
    return named.join(own, "entity_id", "left").select("entity_id", "canonical_name", F.coalesce("aliases", F.lit("")).alias("aliases"))
