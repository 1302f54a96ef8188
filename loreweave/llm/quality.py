"""Quality rules (operator 10): a cascade that asks the rules with most rejections per cost first. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import dropped, packed_row, parts, written
from loreweave.llm.ngrams import blank_split, with_window_hashes

#: Words of a repeated window.
WINDOW = 5


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules. A document at a limit passes."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 20
    max_dup_line_percent: int = 30
    min_mean_word: float = 1.5
    max_mean_word: float = 25.0
    max_bullet_percent: int = 90
    max_ellipsis_percent: int = 30


def _word_chars() -> Column:
    return F.length(F.array_join("words", "")).cast("long")


def _symbols() -> Column:
    return F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long")


def _full_lines() -> Column:
    return F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines() -> Column:
    lines = _full_lines()
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _repeat_words() -> Column:
    """Words covered by windows found twice or more. Hashes rule out most texts; the others compare the windows themselves."""
    n = F.size("windows")
    told = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("at"))))
    # told is sorted by window, so equal windows are neighbours; a window is repeated if either neighbour equals it
    same = F.zip_with(F.slice(told, 1, n - 1), F.slice(told, 2, n - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")))
    at = F.array_sort(F.array_distinct(F.flatten(same)))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), lambda s, i: F.struct((i + WINDOW).alias("upto"), (s["n"] + i + WINDOW - F.greatest(i, s["upto"])).alias("n")))["n"]
    return F.when(F.size(F.array_distinct("windows")) == n, F.lit(0)).otherwise(covered).cast("long")


def _share_of_lines(pattern: str) -> Column:
    """Percent of the lines with words that the pattern finds."""
    lines = _full_lines()
    return 100 * F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.greatest(F.size(lines), F.lit(1))


def rules(limits: Thresholds, symbols: Column | None = None, dup_lines: Column | None = None, repeat_words: Column | None = None) -> dict[str, Column]:
    """Each rule is true where a text must go. They read columns body, words, windows, n_words and word_chars, and measure
    what else they need when they are asked; measures that are there already can be given."""
    symbols, dup_lines, repeat_words = _symbols() if symbols is None else symbols, _dup_lines() if dup_lines is None else dup_lines, _repeat_words() if repeat_words is None else repeat_words
    return {
        "few_words": F.col("n_words") < limits.min_words,
        "repeated_words": 100 * repeat_words > limits.max_repeat_percent * F.col("n_words"),
        "symbols": 100 * symbols > limits.max_symbol_percent * F.col("word_chars"),
        "repeated_lines": 100 * dup_lines > limits.max_dup_line_percent * F.size(_full_lines()),
        "short_words": F.col("word_chars") < limits.min_mean_word * F.col("n_words"),
        "long_words": F.col("word_chars") > limits.max_mean_word * F.col("n_words"),
        "bullet_lines": _share_of_lines(r"^[\x20\x09-\x0D]*[•*-]") > limits.max_bullet_percent,
        "ellipsis_lines": _share_of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*\z") > limits.max_ellipsis_percent,
    }


def _prepared(docs: DataFrame, text: str, keep: Column) -> DataFrame:
    d = docs.select(keep.alias("kept_row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    d = d.withColumn("words", blank_split(F.col("body")))
    d = with_window_hashes(d, "words", [WINDOW], "windows_")
    return d.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", _word_chars()).withColumnRenamed(f"windows_{WINDOW}", "windows")


def _timed(job: Callable[[], list], times: int = 3) -> tuple[float, list]:
    """The median of the seconds that a job takes, and what it returns."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        out = job()
        took.append(time.perf_counter() - began)
    return median(took), out


def rule_order(docs: DataFrame, limits: Thresholds = Thresholds(), text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[dict]:
    """Cost (seconds) and selectivity of each rule over a sample of about sample_rows rows, best rejection per cost first.

    A rule's cost is what its job takes beyond one that reads the same columns and asks nothing. The order changes how
    much work a rejected text costs, never the verdict.
    """
    n = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / max(1, n)), seed=seed).coalesce(max(1, parts(docs.sparkSession) // 8))
    d = written(_prepared(sample, "text", F.lit(0)).drop("kept_row"), "rule-sample-words")  # each rule then costs what is its own
    read = [F.count("*"), F.max(F.size("words")), F.max(F.size("windows")), F.max(F.octet_length("body"))]
    d.agg(*read).collect()
    idle, _ = _timed(lambda: d.agg(*read).collect())
    found = []
    for name, rejects in rules(limits).items():
        took, told = _timed(lambda: d.agg(*read, F.coalesce(F.sum(rejects.cast("long")), F.lit(0))).collect())
        found.append({"rule": name, "cost": max(took - idle, 1e-4), "selectivity": told[0][-1] / max(1, told[0][0])})
    dropped(d)
    return sorted(found, key=lambda x: (-x["selectivity"] / x["cost"], x["cost"], x["rule"]))


def verdict(order: list[str], known: dict[str, Column]) -> Column:
    """The first of the known rules in this order that a text fails, null if none: later rules are not evaluated for a rejected text."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(known[name], F.lit(name)).otherwise(out)
    return out


def quality_report(docs: DataFrame, limits: Thresholds = Thresholds(), doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule: a row per row of docs.

    The four measures and base_failed (fewer than 10 words, or more than a fifth of them in repeated windows) are told for
    every row; kept and failed_rule come from the cascade, which asks a row that failed the base nothing and any other
    row one rule after the other until it fails. A null text is an empty one: no words, so it fails. An empty table gives
    an empty report; equal rows give equal rows; a null doc_id stays null. Other columns of docs play no part, whatever
    their names. Very long texts are handled whole, inside their row.
    """
    order = order or [x["rule"] for x in rule_order(docs, limits, text)]
    d = _prepared(docs, text, F.col(doc_id))
    d = d.select(F.col("kept_row").alias("doc_id"), "body", "words", "windows", "n_words", "word_chars", _symbols().alias("n_symbols"), _dup_lines().alias("n_dup_lines"), _repeat_words().alias("n_repeat_words"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.when(base, F.lit("base")).otherwise(verdict(order, rules(limits, F.col("n_symbols"), F.col("n_dup_lines"), F.col("n_repeat_words"))))
    d = d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rule"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def quality_filter(docs: DataFrame, limits: Thresholds = Thresholds(), text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects; rules run as a short-circuit cascade.

    Null and empty texts go, as they have too few words. Repeated rows are judged alike. An empty table stays empty.
    """
    order = order or [x["rule"] for x in rule_order(docs, limits, text)]
    d = _prepared(docs, text, packed_row(docs))
    # an id in the verdict keeps the optimizer from copying the word arrays' expressions into a filter below them
    failed = F.when(F.monotonically_increasing_id() < 0, F.lit("")).otherwise(verdict(order, rules(limits)))
    return d.select("kept_row", failed.alias("failed")).where(F.col("failed").isNull()).select("kept_row.*")
