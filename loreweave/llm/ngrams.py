"""Word windows inside a row, by built-in array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import BLANKS


def blank_split(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that is not null, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _pairs(left: Column, right: Column, shift: int) -> Column:
    """Hash of left[i] with right[i + shift], for every i that has both."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(df: DataFrame, words: str, lengths: list[int], prefix: str) -> DataFrame:
    """Adds {prefix}{n}: the 64-bit hash of each window of n words by its start, for every n in lengths.

    Hashes of windows of 1, 2, 4, ... words are built by doubling, the others from their binary digits, so a window
    of n words costs about log2(n) hashes. Equal windows have equal hashes; unequal ones may collide.
    """
    made = {1: f"{prefix}1"}
    df = df.withColumn(made[1], F.transform(F.col(words), lambda w: F.xxhash64(w)))
    n = 1
    while 2 * n <= max(lengths):
        made[2 * n] = f"{prefix}{2 * n}"
        df = df.withColumn(made[2 * n], _pairs(F.col(made[n]), F.col(made[n]), n))
        n *= 2
    for want in sorted(set(lengths)):
        done = 0
        for bit in sorted((b for b in list(made) if want & b and b & (b - 1) == 0), reverse=True):
            if done and done + bit not in made:
                made[done + bit] = f"{prefix}{done + bit}"
                df = df.withColumn(made[done + bit], _pairs(F.col(made[done]), F.col(made[bit]), done))
            done += bit
    return df.drop(*(c for k, c in made.items() if k not in lengths))
