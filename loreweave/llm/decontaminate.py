"""Benchmark decontamination (operator 2): word windows of benchmark items looked up in every document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import ascii_lower, dropped, packed_row, power_of_two, sent_if_small, written
from loreweave.llm.ngrams import with_window_hashes

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The set sent to every task is a bit table of at most so many bits (2 MB); beyond 16 windows a bit it only prunes less.
MOST_BITS = 1 << 24
#: Windows of items are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(bench: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """gram, len, hash, items: each distinct window with the items that hold it. Items without words have none."""
    w = bench.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    g = w.select("item", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("gram_words"))
    g = g.groupBy("len", "gram_words").agg(F.collect_set("item").alias("items"))
    return g.withColumn("gram", F.array_join("gram_words", " "))


def _table(grams: DataFrame, lengths: list[int]) -> tuple[dict[int, Column], dict[int, int]]:
    """For each window length a bit table of the hashes of its windows, as an array of longs, and its size as a power of two."""
    tables, sizes = {}, {}
    for n in lengths:
        own = with_window_hashes(grams.where(F.col("len") == n), "gram_words", [n], "h_").select(F.col(f"h_{n}")[0].alias("h"))
        bits = min(MOST_BITS, max(64, power_of_two(16 * own.count())))
        own = own.select(F.expr(f"cast(h & {bits - 1}L as int)").alias("b"))
        # at most MOST_BITS / 64 rows reach the driver, however large the benchmark is
        rows = own.groupBy(F.expr("b div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("v")).collect()
        longs = [0] * (bits // 64)
        for r in rows:
            longs[r["at"]] = r["v"]
        tables[n], sizes[n] = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), bits
    return tables, sizes


def _spots(hashes: Column, n: int, table: Column, bits: int) -> Column:
    """(start, len) of the windows of n words whose hash has its bit set."""

    def spot(h: Column, i: Column) -> Column:
        word = F.get(table, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
        bit = F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        return F.when(bit == 1, F.struct(i.alias("start"), F.lit(n).alias("len")))

    return F.filter(F.transform(hashes, spot), lambda x: x.isNotNull())


def _found(docs: DataFrame, bench: DataFrame, window: int, at: Column, keep: dict[str, Column], text: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """(base, hits): base has at, the kept columns and n_words of every document; hits has at, hits (start, len) and items
    of those with any. Documents of equal texts may share an at."""
    grams = written(item_windows(bench, window, item_id), "benchmark-windows")
    told = grams.groupBy("len").agg(F.sum(F.octet_length("gram") + 24 + 16 * F.size("items")).alias("b")).collect()
    lengths, size = sorted(r["len"] for r in told), sum(r["b"] for r in told)
    tables, bits = _table(grams, lengths) if lengths else ({}, {})
    d = docs.select(at.alias("at"), *[c.alias(f"kept_{k}") for k, c in keep.items()], words_of(F.col(text)).alias("words"))
    spots = F.array().cast("array<struct<start:int,len:int>>")
    if lengths:
        d = with_window_hashes(d, "words", lengths, "h_")
        each = [_spots(F.col(f"h_{n}"), n, tables[n], bits[n]) for n in lengths]
        spots = F.concat(*each)
    # the words that a hit has to be verified by, and nothing else of the text, go along
    probable = F.transform(spots, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice("words", s["start"] + 1, s["len"]), " ").alias("gram")))
    base = written(d.select("at", *[f"kept_{k}" for k in keep], F.size("words").cast("long").alias("n_words"), probable.alias("probable")), "decontamination")
    one = base.where(F.size("probable") > 0).select("at", F.explode("probable").alias("p")).select("at", "p.start", "p.len", "p.gram")
    known = grams.select("gram", "len", "items")
    hits = one.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["gram", "len"])
    hits = hits.groupBy("at").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return base, hits


def _covered(hits: Column) -> Column:
    """Words inside any of the sorted (start, len) hits."""
    return F.aggregate(hits, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["upto"], x["start"] + x["len"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], s["upto"]))).cast("long").alias("n")))["n"]


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated: one row per row of docs.

    Null and empty texts have no words and no hits; an item of fewer words than the window is one window; a null item
    text has none; a null item_id is no item. Repeated rows each get a row. Empty tables give empty or clean results.
    """
    base, hits = _found(docs, bench.where(F.col(item_id).isNotNull()), window, F.monotonically_increasing_id(), {"doc_id": F.col(doc_id)}, text, item_id)
    items = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.cast("string")))
    out = base.drop("probable").join(hits.withColumn("items", F.col("items").cast("array<string>")), "at", "left")
    out = out.select(F.col("kept_doc_id").alias("doc_id"), "n_words", F.coalesce(_covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs without benchmark passages, with all their columns: remove="documents" drops each text with a hit,
    remove="spans" drops from it each hit word and the separator after it, the rest staying as it was.

    What a text is decides, so that only its digest is looked up where it lies, and texts are shuffled only where very
    many are contaminated. Null and empty texts stay; repeated rows are treated alike; an empty table stays empty, and an
    empty benchmark leaves all; columns may have any names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    base, hits = _found(docs, bench.where(F.col(item_id).isNotNull()), window, mark, {}, text, item_id)
    hits = written(hits.select("at", *["hits"] * (remove == "spans")), "contaminated")
    dropped(base)
    rows = docs.select(packed_row(docs).alias("row"), mark.alias("at"))
    if remove == "documents":
        return rows.join(sent_if_small(hits.select("at"), "at", most=BROADCAST_BYTES), "at", "left_anti").select("row.*")
    out = rows.join(hits, "at", "left")
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    lead = F.regexp_extract(body, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    flags = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    left = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), flags)), lambda i: F.get(pieces, i)), "")
    cleaned = F.when(F.col("hits").isNotNull(), F.concat(lead, left)).otherwise(F.col(f"row.`{text}`"))
    return out.select(F.col("row").withField(f"`{text}`", cleaned).alias("row")).select("row.*")
