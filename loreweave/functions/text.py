"""Spans, digests and token sets as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = ".,!?;:\"'()-[]{}"


def spans(text: Column, pattern: str) -> Column:
    """(start, end, excerpt) of every match of a Java pattern, in code points. Matches must not be empty.

    A text without a match costs one search. Gaps and matches are taken in turn, so that each is found once.
    """
    none = F.array().cast("array<struct<start:int,end:int,excerpt:string>>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    turns = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))  # behind the last gap is no match

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + t["gap"]
        end = start + F.length(t["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), t["m"].alias("excerpt")))
        return F.when(t["m"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["out"], one).alias("out")))

    told = F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), told).otherwise(none)


#: Places of an array whose sizes are summed up together.
BLOCK = 256


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x)


def with_block_sums(rows: DataFrame, size: str) -> DataFrame:
    """Adds before_block: the sum of all sizes before each block, so that ahead() costs a block at most."""
    last = F.floor((F.size(size) - 1) / BLOCK).cast("int")
    rows = rows.withColumn("block_sum", F.when(F.size(size) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(size, b * BLOCK + 1, BLOCK)))))
    grown = F.aggregate("block_sum", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.get(s, F.size(s) - 1) + x)))
    return rows.withColumn("before_block", grown).drop("block_sum")


def ahead(size: str, i: Column) -> Column:
    """The sum of the sizes before place i."""
    b = F.floor(i / BLOCK).cast("int")
    return F.get("before_block", b) + _sum(F.slice(size, b * BLOCK + 1, i % BLOCK))


def _alternatives(pattern: str) -> list[str]:
    """What stands between bars outside of brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "|" and depth == 0 else [*out[:-1], out[-1] + c]
    return out


def led(pattern: str) -> str:
    """A pattern that first looks at the letter ahead, where all its alternatives begin with plain ones: a search passes over other
    places at the cost of a letter instead of that of word boundaries, which is much. Its matches stay the same."""
    heads = ""
    for part in _alternatives(pattern):
        part = part.removeprefix(r"\b")
        words = re.match(r"\(([A-Za-z]+(?:\|[A-Za-z]+)*)\)(?![?*{])", part)
        one = re.match(r"(?:\[([A-Za-z-]+)\]|([A-Za-z]))(?![?*{])", part)
        if not words and not one:
            return pattern
        heads += "".join(w[0] for w in words[1].split("|")) if words else one[1] or one[2]
    return f"(?=[{heads}])(?:{pattern})"


def any_case(pattern: str) -> str:
    return "(?iuU)" + led(pattern)


def digest(prefix: str, size: int, *parts: Column | str, by: str = "|") -> Column:
    """prefix and the first hex digits of the SHA-256 of the joined parts."""
    joined = F.concat_ws(by, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, size))


def folded_digest(prefix: str, *parts: Column) -> Column:
    """A digest of 12 digits over parts stripped and lower-cased."""
    return digest(prefix, 12, *[F.lower(F.regexp_replace(p, r"(?U)^\s+|\s+\z", "")) for p in parts])


def tokens(text: Column) -> Column:
    """Distinct words of a description, lower-cased, without punctuation around them."""
    words = F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: w != "")))  # array_sort calls a comparison for each two


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def recency(passage_id: Column) -> Column:
    """The last piece between _ or - that is a whole number, else 0."""
    pieces = F.filter(F.split(passage_id, "[_-]"), lambda p: p.rlike(r"^[+-]?[0-9]{1,18}$"))
    return F.coalesce(F.get(pieces, F.size(pieces) - 1).cast("long"), F.lit(0).cast("long"))
