"""Candidates are all similar pairs, however tokens are counted, rows dealt and blocks cut."""

from __future__ import annotations

import random

import pytest

from loreweave.operators import meeting
from loreweave.operators.meeting import candidates


def _sets(rng, n, words):
    made = []
    for _ in range(n):
        some = set(rng.choices(words, k=rng.randint(0, 12)))
        made.append(some)
        if rng.random() < 0.5:
            made.append({w for w in some if rng.random() > 0.2} | set(rng.choices(words, k=rng.randint(0, 2))))
    return made


@pytest.mark.parametrize("least, most, side", [(0.55, 1 << 20, 1 << 13), (0.55, 4, 3), (0.3, 0, 2), (0.8, 30, 5), (0.0, 7, 9)])
def test_all_similar_pairs_meet(spark, monkeypatch, least, most, side):
    monkeypatch.setattr(meeting, "WINDOW", 50)  # pieces of a few rows and pairs
    monkeypatch.setattr(meeting, "TILED", 6 if side % 2 else 64)
    rng = random.Random(int(least * 100) + side)
    words = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(25)]
    rows = [(f"r{i}", sorted(s)) for i, s in enumerate(_sets(rng, 60, words))]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("none", None)], "id string, tokens array<bigint>").repartition(3)
    met = [tuple(r) for r in candidates(df, least, most, side).collect()]
    sets = {k: set(v) for k, v in rows}
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    wanted = {(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j]) >= least - 1e-12}
    assert len(met) == len(set(met)) and wanted <= set(met) and all(i < j and "none" not in (i, j) for i, j in met)
    assert wanted


def test_few_unlike_pairs_leave_a_block(spark):
    """A token that many rows share, without more: as blocks of an SQL join all pairs would be rows."""
    from pyspark.sql import functions as F

    n = 3000
    rows = spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.array(F.lit(7).cast("long"), *[F.xxhash64(F.col("id"), F.lit(k)) for k in range(6)], ).alias("tokens"))
    rows = rows.union(rows.select(F.concat("id", F.lit("+")).alias("id"), "tokens").limit(5))
    assert candidates(rows, 0.55).count() == 5


def test_runs_of_a_block_go_on_in_the_next_batch(spark):
    """All rows alike: one block of several batches, dealt in parts or not, gives each pair once."""
    from pyspark.sql import functions as F

    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1).cast("long")).alias("tokens"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert candidates(rows, 0.55).count() == 300 * 299 // 2
        assert candidates(rows, 0.55, side=64).count() == 300 * 299 // 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    empty = rows.select("id", F.array().cast("array<bigint>").alias("tokens"))
    assert candidates(empty, 0.55, side=64).count() == 300 * 299 // 2 and candidates(rows.limit(0), 0.55).count() == 0
