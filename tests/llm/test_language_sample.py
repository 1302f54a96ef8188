"""Language samples where copies are most of a language."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.llm import language_id


def test_copies_leave_the_sample_whole(spark):
    word = F.translate(F.hex(F.xxhash64("id")), "0123456789", "ghijklmnop")
    some = spark.range(1000).select("id", F.repeat(F.concat(word, F.lit(" ")), 20).alias("text"))
    copies = spark.range(60_000).select("id", F.lit("this very text again and again " * 9).alias("text"))
    junk = spark.range(3000).select("id", F.concat(F.lit("12 !? "), F.col("id")).alias("text"))
    whole = language_id.learn(some.union(copies).union(junk).select("text", F.lit("x").alias("lang")))["x"]
    assert 0.9 * language_id.TRAIN_CHARS <= len(whole) <= language_id.TRAIN_CHARS
    known = [r.w for r in some.select(F.lower(F.split("text", " ")[0]).alias("w")).collect()]
    assert sum(w in whole for w in known) > 250
