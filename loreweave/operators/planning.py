"""Outline, convergences, reveals, twists and the dossier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lexicons import DOSSIER_ORDER
from loreweave.functions.ranking import ranked
from loreweave.functions.text import digest

BOOKS = (6, 7)


def outline_beats(obliged: DataFrame, named: DataFrame, books: tuple[int, int] = BOOKS) -> DataFrame:
    """beat_id, book_number, obligation_id, description, pov_character, entity_ids: the first half of the obligations by id
    (one at least) makes the first book, the rest the second."""
    half = F.greatest(F.lit(1), F.floor(F.col("total") / 2)).cast("int")
    o = ranked(obliged.select("obligation_id", "description", "related_entity_ids"), "obligation_id")
    o = o.withColumn("book_number", F.when(F.col("rank") < half, books[0]).otherwise(books[1])).withColumn("place", F.when(F.col("rank") < half, F.col("rank")).otherwise(F.col("rank") - half) + 1)
    names = named.select(F.col("entity_id").alias("pov"), F.col("canonical_name").alias("pov_character"))
    o = o.withColumn("pov", F.get("related_entity_ids", F.lit(0))).join(names, "pov", "left")
    return o.select(F.format_string("book%d_beat_%03d", "book_number", "place").alias("beat_id"), "book_number", "obligation_id", "description", "pov_character", F.array_join("related_entity_ids", ";").alias("entity_ids"))


def convergence(beats: DataFrame, books: tuple[int, int] = BOOKS) -> DataFrame:
    """convergence_id, entity_id, obligations, suggested_placement, dramatic_weight, section_id: entities of two obligations or more."""
    e = beats.where("entity_ids <> ''").select("book_number", "obligation_id", F.explode(F.split("entity_ids", ";")).alias("entity_id"))
    c = e.groupBy("entity_id").agg(F.array_sort(F.collect_set("obligation_id")).alias("o"), F.min("book_number").alias("first"), F.countDistinct("book_number").alias("n")).where(F.size("o") >= 2)
    place = F.when(F.col("n") >= 2, F.lit(f"Between books {books[0]} and {books[1]}")).otherwise(F.format_string("Book %d midpoint", "first"))
    c = c.select(F.concat(F.lit("conv_"), F.col("entity_id")).alias("convergence_id"), "entity_id", F.array_join("o", ";").alias("obligations"), place.alias("suggested_placement"), F.round(F.least(F.lit(1.0), 0.3 + 0.1 * F.size("o")), 6).alias("dramatic_weight"))
    return c.withColumn("section_id", F.when(F.col("suggested_placement").contains(f"Book {books[1]}"), F.lit(f"book{books[1]}")).otherwise(F.lit(f"book{books[0]}")))


def bridging_beats(points: DataFrame) -> DataFrame:
    """beat_id, section_id, convergence_id: a beat per convergence, numbered by id within its section."""
    p = ranked(points.select("section_id", "convergence_id"), "section_id", "convergence_id")
    first = p.groupBy("section_id").agg(F.min("rank").alias("first"))
    n = F.col("rank") - F.col("first") + 1
    return p.join(first, "section_id").select(F.concat(F.lit("bridge_"), F.col("section_id"), F.lit("_"), F.lpad(n.cast("string"), 2, "0")).alias("beat_id"), "section_id", "convergence_id")


def coverage_map(obliged: DataFrame, beats: DataFrame) -> DataFrame:
    """obligation_id and its beats, joined by ; (empty if none has it)."""
    b = beats.groupBy("obligation_id").agg(F.array_join(F.array_sort(F.collect_list("beat_id")), ";").alias("beat_ids"))
    return obliged.select("obligation_id").join(b, "obligation_id", "left").select("obligation_id", F.coalesce("beat_ids", F.lit("")).alias("beat_ids"))


def _evidence(obliged: DataFrame, anchors: DataFrame) -> DataFrame:
    e = obliged.select("obligation_id", F.posexplode("evidence_anchor_ids").alias("at", "anchor_id")).join(anchors.select("anchor_id"), "anchor_id", "left_semi")
    e = e.groupBy("obligation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "anchor_id"))), lambda x: x["anchor_id"]), ";").alias("evidence"))
    return obliged.join(e, "obligation_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))


def reveal_ledger(obliged: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row per mystery: reveal and truth ids, evidence that exists, who learns of it."""
    m = _evidence(obliged.where("category = 'mystery'"), anchors)
    return m.select(digest("reveal_", 12, "reveal", F.col("obligation_id"), by=":").alias("reveal_id"), F.col("obligation_id").alias("mystery_obligation_id"), F.col("description").alias("mystery_description"), digest("truth_", 12, "truth", F.col("obligation_id"), by=":").alias("candidate_truth_ids"), F.col("evidence").alias("evidence_for"), F.lit(0.5).alias("likelihood"), F.array_join("related_entity_ids", ";").alias("characters_who_learn"), F.lit("moderate").alias("dramatic_impact"))


def reveals_csv(ledger: DataFrame) -> DataFrame:
    """The ledger as its file has it: eight columns, of which the truth that is chosen and its place are still empty."""
    return ledger.select("reveal_id", "mystery_obligation_id", "mystery_description", "candidate_truth_ids", F.lit("").alias("selected_truth"), F.lit("").alias("reveal_placement"), "characters_who_learn", "dramatic_impact")


def twist_bank(obliged: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row per obligation: twist id, description, evidence that exists."""
    return _evidence(obliged, anchors).select(digest("twist_", 12, "twist", F.col("obligation_id"), by=":").alias("twist_id"), F.concat(F.lit("Twist proposal derived from obligation "), F.col("obligation_id")).alias("description"), F.lit("revelation").alias("twist_type"), F.col("obligation_id").alias("affected_obligations"), F.array_join("related_entity_ids", ";").alias("affected_entities"), F.col("evidence").alias("evidence_support"), F.lit(0.5).alias("reader_predictability"), F.lit(0.5).alias("thematic_alignment"))


def dossier_lines(obliged: DataFrame, resolved: DataFrame) -> DataFrame:
    """section, obligation_id, block: a markdown block per obligation with its quotations, in the dossier's order of sections."""
    quotes = resolved.groupBy("obligation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "passage_id", "excerpt"))), lambda x: F.concat(F.lit("> "), x["excerpt"], F.lit(" ("), x["passage_id"], F.lit(")"))), "\n").alias("quotes"))
    section = F.array_position(F.array(*map(F.lit, DOSSIER_ORDER)), F.col("category"))
    block = F.concat(F.lit("### "), F.col("description"), F.lit("\nConfidence: "), F.format_string("%.2f", "confidence"), F.lit("\n"), F.coalesce("quotes", F.lit("> (no evidence found)")))
    return obliged.join(quotes, "obligation_id", "left").select(section.alias("section"), "obligation_id", block.alias("block")).orderBy("section", "obligation_id")


def dossier(obliged: DataFrame, resolved: DataFrame) -> DataFrame:
    """value: the dossier as lines of text, ordered; write it with coalesce(1).write.text."""
    lines = dossier_lines(obliged, resolved)
    return lines.select("section", "obligation_id", F.explode(F.split("block", "\n")).alias("value"))
