"""Near-duplicate obligations: a blocked similarity join, and greedy merging in rounds of pairs that no other can change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.lineage import dropped, written
from loreweave.functions.ranking import ranked, running
from loreweave.functions.text import digest, jaccard, tokens
from loreweave.operators.meeting import candidates

#: What equal categories, related entities and shared evidence can add to a description's Jaccard.
MOST_BONUS = 0.25


def similarity(a: str, b: str) -> Column:
    """Of rows a and b with tokens, category, related_entity_ids, evidence_anchor_ids; 1 at most."""
    col = lambda side, name: F.col(f"{side}.{name}")
    bonus = lambda name, weight: F.when((F.size(col(a, name)) > 0) & (F.size(col(b, name)) > 0), F.lit(weight) * jaccard(col(a, name), col(b, name))).otherwise(F.lit(0.0))
    same = F.when(col(a, "category") == col(b, "category"), F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), jaccard(col(a, "tokens"), col(b, "tokens")) + same + bonus("related_entity_ids", 0.1) + bonus("evidence_anchor_ids", 0.05))


def find_duplicates(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(i, j, similarity) of pairs with i before j by obligation_id and a similarity of threshold or more.

    Such a pair has a Jaccard of threshold - 0.25 at least. Pairs that may have it meet as numbers (candidates()); what is left, few but
    similar pairs, is verified by the rows themselves. Rows without tokens form a block of their own.
    """
    r = written(rows.select("obligation_id", "category", "related_entity_ids", "evidence_anchor_ids", tokens(F.col("description")).alias("tokens")))
    met = candidates(r.select(F.col("obligation_id").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")), threshold - MOST_BONUS)
    side = lambda end, name: r.select(F.col("obligation_id").alias(end), F.struct(*r.columns).alias(name))
    pairs = met.join(side("i", "a"), "i").join(side("j", "b"), "j")
    return pairs.select("i", "j", similarity("a", "b").alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


#: Pairs of one row that a round of merging works off.
PARTNERS = 1000


def _class() -> Column:
    """Words and category of a row, as a key."""
    return F.sha2(F.to_json(F.struct(tokens(F.col("description")).alias("t"), F.col("category").alias("c")), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Merges:
    """What merging did. owners: obligation_id, owner (the row that it is part of at the end, itself if it stayed). edges: source,
    target, weight of every merge, target being what source took in. items: owner, kind (anchor, entity, resolution), value and
    at, the order of the merged lists. Nothing is gathered by owner."""

    owners: DataFrame
    edges: DataFrame
    items: DataFrame


def _classes(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows alike in words and category, merged in order of id: a row with more evidence than all before it together takes
    over. Returns rows with rep, place (of the list's order) and before; edges; and each rep with the size of its evidence.

    A takeover at least doubles what a class has, so there are few in a class, however many rows that has.
    """
    held = base.select("class", "obligation_id", F.explode("evidence_anchor_ids").alias("anchor"))
    fresh = held.groupBy("class", "anchor").agg(F.min("obligation_id").alias("obligation_id")).groupBy("obligation_id").agg(F.count("*").alias("fresh"))
    sized = base.select("class", "obligation_id", F.size("evidence_anchor_ids").cast("long").alias("n")).join(fresh, "obligation_id", "left").select("class", "obligation_id", "n", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    told = written(running(sized, "class", "obligation_id", "fresh", "before"))
    ends = told.groupBy("class").agg(F.min("obligation_id").alias("first"), F.sum("fresh").alias("size"), F.sort_array(F.collect_list(F.when(F.col("n") > F.col("before"), F.col("obligation_id"))), False).alias("more"))  # 64 at most
    ends = ends.select("class", "size", F.when(F.array_contains("more", F.col("first")), F.col("more")).otherwise(F.concat("more", F.array("first"))).alias("winners"))
    told = told.join(ends, "class").withColumn("rep", F.col("winners")[0]).withColumn("place", F.array_position("winners", F.col("obligation_id")))
    later = F.get("winners", F.col("place").cast("int") - 2)
    now = F.element_at(F.filter("winners", lambda w: w < F.col("obligation_id")), 1)
    into = F.when(F.col("place") == 0, now).when(F.col("place") > 1, later)
    told = written(told.withColumn("into", into).withColumn("place", F.when(F.col("place") == 0, F.lit(1 << 30)).otherwise(F.col("place"))))
    edges = told.where("into is not null").select(F.col("into").alias("source"), F.col("obligation_id").alias("target"), F.lit(1.0).alias("weight"))
    return told.select("obligation_id", "rep", "place", "before"), edges, told.where("rep = obligation_id").select(F.col("rep").alias("node"), F.col("size").alias("n"))


def _round(pairs: DataFrame, sizes: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One round: merges (source, target, weight) and moves (node, owner, shift, n): whose lists go where in whose, and new sizes; and the
    tables that both still read.

    A pair is decided once no other pair of its two rows comes first. So wherever two rows are each other's first pair, the
    one that stays works off its next pairs too, as long as these are the first of the other row, until it is taken in itself.
    """
    way = lambda x, y: pairs.select(F.col(x).alias("x"), F.col(y).alias("y"), F.struct((-F.col("similarity")).alias("s"), "i", "j").alias("r"))
    both = way("i", "j").unionByName(way("j", "i"))
    best = written(both.groupBy("x").agg(F.min("r").alias("first")))
    rows = both.join(best.select(F.col("x").alias("y"), F.col("first").alias("of_y")), "y").withColumn("due", F.col("r") == F.col("of_y"))
    stop = rows.groupBy("x").agg(F.min(F.when(~F.col("due"), F.col("r"))).alias("stop"), F.min("r").alias("first"))
    rows = rows.where("due").join(stop, "x").where(F.col("stop").isNull() | (F.col("r") < F.col("stop")))
    n = lambda c, to: sizes.select(F.col("node").alias(c), F.col("n").alias(to))
    mutual = rows.where(F.col("r") == F.col("first")).select("x", F.col("r.i").alias("i"), F.col("r.j").alias("j")).join(n("i", "ni"), "i").join(n("j", "nj"), "j")
    stays = mutual.where(F.col("x") == F.when(F.col("ni") >= F.col("nj"), F.col("i")).otherwise(F.col("j"))).select("x")
    line = rows.join(stays, "x", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("r"))).where(F.col("k") <= PARTNERS)
    line = partners = written(line.join(n("y", "n"), "y").select("x", "y", "k", "n", (-F.col("r.s")).alias("weight")))
    own = line.select("x").distinct().join(n("x", "n"), "x").select("x", F.col("x").alias("y"), F.lit(0).alias("k"), "n", F.lit(None).cast("double").alias("weight"))
    line = own.unionByName(line)
    fresh = line.join(items.where("kind = 'anchor'").withColumnRenamed("owner", "y"), "y").groupBy("x", "value").agg(F.min("k").alias("k")).groupBy("x", "k").agg(F.count("*").alias("fresh"))
    before = Window.partitionBy("x").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # PARTNERS + 1 rows at most
    line = line.join(fresh, ["x", "k"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0))).withColumn("before", F.coalesce(F.sum("fresh").over(before), F.lit(0)))
    over = (F.col("k") > 0) & ((F.col("n") > F.col("before")) | (F.col("n") == F.col("before")) & (F.col("y") < F.col("x")))
    line = decided = written(line.withColumn("over", over))
    end = line.groupBy("x").agg(F.min(F.when(F.col("over"), F.col("k"))).alias("end"))
    line = line.join(end, "x").where(F.col("end").isNull() | (F.col("k") <= F.col("end")))
    last = line.groupBy("x").agg(F.max_by("y", "k").alias("y"), F.sum("fresh").alias("size"), F.max("end").alias("end"))
    last = last.select("x", F.when(F.col("end").isNull(), F.col("x")).otherwise(F.col("y")).alias("owner"), "size")
    line = written(line.join(last, "x"))
    merged = line.where("k > 0").select(F.when(F.col("over"), F.col("y")).otherwise(F.col("x")).alias("source"), F.when(F.col("over"), F.col("x")).otherwise(F.col("y")).alias("target"), "weight")
    moves = line.select(F.col("y").alias("node"), "owner", F.when(F.col("y") == F.col("owner"), F.lit(-1)).otherwise(F.col("k")).alias("shift"), F.col("size").alias("n"))
    return merged, moves, [best, partners, decided, line]


def merges(rows: DataFrame, threshold: float = 0.8) -> Merges:
    """Greedy merging by similarity, best pair first and then by ids: of two rows the one with more evidence, the first on a
    tie, takes in the other with all that it has; a row that was taken in takes no further part.

    Rows alike in words and category come first, then pairs of what is left, by each kept row's own words, entities and evidence. Pairs
    are decided in rounds, in each of which all that no earlier pair can change are, which gives what one pair after the
    other gives. No class or group of rows is gathered anywhere. Lists of a row are sets; ids are unique.
    """
    names = ["obligation_id", "category", "description", "evidence_anchor_ids", "resolution_passage_id", "related_entity_ids"]
    base = written(rows.select(*names, _class().alias("class")))
    in_class, edges, sizes = _classes(base)
    listed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(listed("anchor", F.col("evidence_anchor_ids")), listed("entity", F.col("related_entity_ids")), listed("resolution", F.filter(F.array("resolution_passage_id"), lambda v: v.isNotNull())))
    items = base.select("obligation_id", F.posexplode(every).alias("pos", "item")).join(in_class, "obligation_id")
    items = items.groupBy("rep", "item").agg(F.min(F.struct("place", "before", "obligation_id", "pos")).alias("o")).select(F.col("rep").alias("owner"), "item.*", "o.*")
    items = ranked(items.select("owner", "kind", "value", "place", "obligation_id", "pos"), "owner", "place", "obligation_id", "pos")
    first = items.groupBy("owner").agg(F.min("rank").alias("first"))
    items = written(items.join(first, "owner").select("owner", "kind", "value", (F.col("rank") - F.col("first")).cast("long").alias("at")))
    kept = base.join(sizes.select(F.col("node").alias("obligation_id")), "obligation_id", "left_semi")
    pairs = written(find_duplicates(kept, threshold))
    sizes = written(sizes.join(pairs.select(F.col("i").alias("node")).union(pairs.select(F.col("j").alias("node"))).distinct(), "node", "left_semi"))
    moved, all_edges = None, [edges]
    live = written(items.join(sizes.select(F.col("node").alias("owner")), "owner", "left_semi"))
    rest = written(items.join(sizes.select(F.col("node").alias("owner")), "owner", "left_anti"))
    while not pairs.isEmpty():
        merged, moves, scratch = _round(pairs, sizes, live)
        merged, moves = written(merged), written(moves)
        dropped(*scratch)
        old = [pairs, sizes, live, moved, moves]
        all_edges.append(merged)
        gone = moves.where("node <> owner").select("node", "owner")
        step = live.join(moves.select(F.col("node").alias("owner"), F.col("owner").alias("to"), "shift"), "owner", "left")
        shifted = written(step.select(F.coalesce("to", "owner").alias("owner"), "kind", "value", F.struct(F.coalesce("shift", F.lit(0)).alias("shift"), "at").alias("o")).groupBy("owner", "kind", "value").agg(F.min("o").alias("o")))
        live = _renumbered(shifted)
        sizes = written(sizes.join(moves.select("node", F.col("owner").alias("to"), F.col("n").alias("now")), "node", "left").where("to is null or to = node").select("node", F.coalesce("now", "n").alias("n")))
        moved = written(gone if moved is None else moved.join(gone.toDF("owner", "to"), "owner", "left").select("node", F.coalesce("to", "owner").alias("owner")).unionByName(gone))
        for end in ("i", "j"):
            pairs = pairs.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        pairs = written(pairs.select("i", "j", "similarity"))
        dropped(*old, shifted)
    owners = in_class.select("obligation_id", F.col("rep").alias("owner"))
    if moved is not None:
        owners = owners.join(moved.toDF("owner", "to"), "owner", "left").select("obligation_id", F.coalesce("to", "owner").alias("owner"))
    return Merges(written(owners), reduce(DataFrame.unionByName, all_edges), rest.unionByName(live))


def _renumbered(items: DataFrame) -> DataFrame:
    """at in the order of o, as a number."""
    told = ranked(items.select("owner", "kind", "value", "o"), "owner", "o", "kind", "value")
    return written(told.select("owner", "kind", "value", F.col("rank").cast("long").alias("at")))


MERGED = ("obligation_id", "category", "description", "evidence_anchor_ids", "last_seen_passage_id", "confidence", "is_resolved", "resolution_passage_id", "related_entity_ids", "absorbed")


def merged_rows(rows: DataFrame, m: Merges) -> DataFrame:
    """A row for each that stayed: the highest confidence, the latest passage, resolved if any is, the first resolution, and
    n_absorbed. Sums and maxima only."""
    digits = F.filter(F.split("last_seen_passage_id", "[_-]"), lambda p: p.rlike(r"^[+-]?[0-9]{1,18}$"))
    newest = F.struct(F.coalesce(F.get(digits, F.size(digits) - 1).cast("long"), F.lit(0).cast("long")).alias("n"), F.col("last_seen_passage_id").alias("id"))
    told = rows.join(m.owners, "obligation_id").groupBy("owner").agg(F.max(newest).alias("newest"), F.max("confidence").alias("confidence"), F.bool_or("is_resolved").alias("is_resolved"), (F.count("*") - 1).alias("n_absorbed"))
    resolved = m.items.where("kind = 'resolution'").groupBy("owner").agg(F.min_by("value", "at").alias("resolution_passage_id"))
    kept = rows.select(F.col("obligation_id").alias("owner"), "category", "description")
    told = told.join(kept, "owner").join(resolved, "owner", "left")
    return told.select(F.col("owner").alias("obligation_id"), "category", "description", F.col("newest.id").alias("last_seen_passage_id"), "confidence", "is_resolved", "resolution_passage_id", "n_absorbed")


def merge_obligations(rows: DataFrame, threshold: float = 0.8, m: Merges | None = None) -> DataFrame:
    """The rows left after merging, with their lists as arrays and absorbed, the ids that each took in. A list grows with what it
    has; merges() and merged_rows() give the same without any."""
    m = m or merges(rows, threshold)
    listed = m.items.where("kind <> 'resolution'").groupBy("owner", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("list"))
    of = lambda kind, name: listed.where(F.col("kind") == kind).select(F.col("owner").alias("obligation_id"), F.col("list").alias(name))
    took = m.owners.where("owner <> obligation_id").groupBy("owner").agg(F.array_sort(F.collect_list("obligation_id")).alias("absorbed")).withColumnRenamed("owner", "obligation_id")
    told = merged_rows(rows, m).join(of("anchor", "evidence_anchor_ids"), "obligation_id", "left").join(of("entity", "related_entity_ids"), "obligation_id", "left").join(took, "obligation_id", "left")
    none = F.array().cast("array<string>")
    for name in ("evidence_anchor_ids", "related_entity_ids", "absorbed"):
        told = told.withColumn(name, F.coalesce(name, none))
    return told.select(*MERGED)


def duplicate_edges(m: Merges) -> DataFrame:
    """edge_id, source, target, weight: a DUPLICATES edge for every merge, with the similarity that led to it."""
    e = m.edges.select(F.col("source").alias("source_obligation_id"), F.col("target").alias("target_obligation_id"), "weight")
    return e.select(digest("dup_", 16, F.col("source_obligation_id"), F.col("target_obligation_id")).alias("edge_id"), "source_obligation_id", "target_obligation_id", F.lit("DUPLICATES").alias("edge_type"), "weight")


def dedupe_rate(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: rows before and after merging, and the share that merging took away (0 of none)."""
    n = rows.agg(F.count("*").alias("before")).crossJoin(merged.agg(F.count("*").alias("after")))
    return n.select("before", "after", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(F.lit(0.0)).alias("dedupe_rate"))
