"""Paragraphs of documents, with offsets into the text as it came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import ahead, with_block_sums

BLANK_LINE = r"\n\s*\n"


def segment(docs: DataFrame, delimiter: str = BLANK_LINE) -> DataFrame:
    """passage_id, source_id, order_hint, paragraph_index, text, char_start, char_end from source_id, order_hint, raw_text.

    A paragraph is what lies between delimiters, stripped, if anything is left; \\r\\n reads as \\n in text and counts two
    in offsets, which are code points of raw_text. Everything happens inside a document's row: no shuffle.
    """
    pattern = f"(?U){delimiter}"
    parts, gaps = F.split("raw_text", pattern, -1), F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0))
    d = docs.where(F.col("raw_text").isNotNull()).select("source_id", "order_hint", parts.alias("part"), gaps.alias("gap"))
    d = with_block_sums(d.withColumn("size", F.zip_with("part", "gap", lambda x, g: F.length(x) + F.coalesce(F.length(g), F.lit(0)))), "size")

    blank = lambda c: c.rlike(r"(?U)^\s")

    def paragraph(part, i):
        # most parts begin and end with a letter, which tells at once that nothing is to be stripped
        ahead_of, behind = blank(F.substring(part, 1, 1)), blank(F.substring(part, -1, 1))
        bare = F.when(ahead_of | behind, F.regexp_replace(part, r"(?U)^\s+|\s+\z", "")).otherwise(part)
        led = F.when(ahead_of, F.length(part) - F.length(F.regexp_replace(part, r"(?U)^\s+", ""))).otherwise(0)
        start = ahead("size", i) + led
        text = F.when(F.contains(bare, F.lit("\r\n")), F.regexp_replace(bare, "\r\n", "\n")).otherwise(bare)
        return F.struct(text.alias("text"), start.alias("char_start"), (start + F.length(bare)).alias("char_end"))

    kept = F.filter(F.transform("part", paragraph), lambda p: p["text"] != "")
    d = d.select("source_id", "order_hint", F.posexplode(kept).alias("paragraph_index", "p"))
    return d.select(F.concat_ws(":", "source_id", F.col("paragraph_index").cast("string")).alias("passage_id"), "source_id", "order_hint", "paragraph_index", "p.text", "p.char_start", "p.char_end")
