"""Links by automaton against a search of every name in every passage; points in intervals against all pairs."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.operators import intervals, linking
from loreweave.operators.linking import links


@pytest.mark.parametrize(("shard_bytes", "sent_bytes"), [(2 << 20, 32 << 20), (20, 0)])
def test_links(spark, shard_bytes, sent_bytes):
    rng = random.Random(1)
    names = ["a", "ab", "ABA", "bab", "é", "ÉA", "😀b", "aba", "bbbb", "no such", "", "a b", "Ünder Å"]
    texts = ["".join(rng.choices("aAbBéÉ😀 ", k=rng.randint(0, 25))) for _ in range(60)] + [None, "", "ab" * 20_000, "xünder åx"]
    named = spark.createDataFrame([(f"e{i}", n, "person") for i, n in enumerate(names)], "entity_id string, canonical_name string, entity_type string")
    passages = spark.createDataFrame([(f"p{i}", t, "x") for i, t in enumerate(texts)], "passage_id string, text string, name string").repartition(3)
    got = sorted((r.passage_id, r.entity_id, r.canonical_name, r.position) for r in links(passages, named, shard_bytes, sent_bytes).collect())
    assert got == sorted((f"p{i}", f"e{k}", n, t.lower().find(n.lower()) + 1) for i, t in enumerate(texts) if t for k, n in enumerate(names) if n and n.lower() in t.lower())


def test_no_names_or_passages(spark):
    named = spark.createDataFrame([("e", "ab", "person")], "entity_id string, canonical_name string, entity_type string")
    passages = spark.createDataFrame([("p", "ab")], "passage_id string, text string")
    assert links(passages, named.limit(0)).count() == 0 == links(passages.limit(0), named).count()
    assert links(passages, named.limit(0)).columns == links(passages, named).columns


def test_no_text_is_shuffled(spark):
    named = spark.createDataFrame([("e", "ab", "person")], "entity_id string, canonical_name string, entity_type string")
    passages = spark.createDataFrame([("p", "ab")], "passage_id string, text string")
    plan = links(passages, named)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastNestedLoop" not in plan


def test_passages_are_read_once_for_many_names(spark):
    # 400,000 names of 13 bytes, more than two automata of 2 MB took
    i = F.col("id").cast("string")
    names = spark.range(400_000).select(F.concat(F.lit("e"), i).alias("entity_id"), F.concat(F.lit("Na"), F.lpad(F.conv(i, 10, 16), 10, "x"), F.lit("z")).alias("canonical_name"), F.lit("person").alias("entity_type"))
    texts = names.where("entity_id in ('e7', 'e399999')").select(F.col("entity_id").alias("passage_id"), F.concat(F.lit("é😀 "), F.upper("canonical_name"), F.lit("."), "canonical_name").alias("text"))
    found = links(texts, names)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.passage_id, r.entity_id, r.position) for r in found.collect()) == [("e399999", "e399999", 4), ("e7", "e7", 4)]


@pytest.mark.parametrize(("window", "tried", "base"), [(1 << 20, 1 << 20, linking.BASE), (16, 5, linking.BASE), (7, 3, 1), (64, 9, 257)])
def test_index_against_plain_search(monkeypatch, window, tried, base):
    # with a base of 1 names of the same letters share a hash
    for k, v in {"WINDOW": window, "TRIED": tried, "BASE": base}.items():
        monkeypatch.setattr(linking, k, v)
    rng = random.Random(1)
    for k in range(40):
        letters = "abé😀 " if k % 2 else "ab"
        names = sorted({"".join(rng.choices(letters, k=rng.randint(1, rng.choice([3, 12, 30])))) for _ in range(rng.randint(1, 80))})
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(9)] + ["", "ab" * 70]
        rng.shuffle(texts)
        data, offsets = linking._bytes(pa.array(names))
        got = zip(*(x.tolist() for x in linking.Index(data, offsets[1:]).search(*linking._bytes(pa.array(["abab", *texts])[1:]))))
        assert sorted(got) == sorted((i, j, t.find(x) + 1) for i, t in enumerate(texts) for j, x in enumerate(names) if x in t)


def test_points_in_intervals(spark):
    rng = random.Random(2)
    ends = [None, None, -9, -1, 0, 1, 2, 3, 7, 8, 15, 16, 1000, 10**12]
    spans = [(i, rng.choice(ends), rng.choice(ends)) for i in range(150)] + [(150, 0, 0), (151, 5, 4), (152, -(2**62), 2**62)]
    spots = [(i, rng.choice([None, -10, -9, -8, 0, 0, 1, 4, 8, 16, 999, 1001, 10**12])) for i in range(60)]
    a = spark.createDataFrame(spans, "i long, first long, last long")
    b = spark.createDataFrame(spots, "p long, at long")
    met = intervals.containing(a, b)
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.columns == ["i", "first", "last", "p", "at"]
    want = sorted((i, p) for i, x, y in spans for p, t in spots if t is not None and (x is None or x <= t) and (y is None or t <= y))
    assert sorted((r.i, r.p) for r in met.collect()) == want
    assert intervals.containing(a, b.limit(0)).count() == 0 == intervals.containing(a.limit(0), b).count()
    assert intervals.containing(a, b.where("at is null")).count() == 0


def test_open_intervals_are_counted_without_pairs(spark):
    rng = random.Random(5)
    for ends in ([None, -9, -1, 0, 1, 2, 7, 8, 16, 1000, 10**12], [0, 3, 4, 9], [None]):
        spans = [(i, rng.choice(ends), rng.choice(ends)) for i in range(rng.choice([3, 40, 150]))] + [(150, 5, 4), (151, -(2**62), -10), (152, 900, 901)]
        spots = [(i, rng.choice([None, -10, -9, 0, 0, 1, 4, 8, 900, 999, 10**12, 10**13])) for i in range(60)]
        a, b = spark.createDataFrame(spans, "i long, first long, last long"), spark.createDataFrame(spots, "p long, at long")
        got = intervals.open_at(a, b)
        met = {t: [x for _, x, y in spans if (x is None or x <= t) and (y is None or t <= y)] for _, t in spots if t is not None}
        assert sorted(map(tuple, got.select("at", "n_open", "earliest").collect())) == sorted((t, len(v), min((x for x in v if x is not None), default=None)) for t, v in met.items() if v)
    assert intervals.open_at(a, b.limit(0)).count() == 0 == intervals.open_at(a.limit(0), b).count()
    many = spark.range(30_000).select("id", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))  # 900 million pairs
    assert [tuple(r) for r in intervals.open_at(many, many.select(F.col("id").alias("at"))).agg(F.count("*"), F.min("n_open"), F.max("n_open"), F.max("earliest")).collect()] == [(30_000, 30_000, 30_000, 0)]


def test_story_times(spark):
    rows = [("a", "T1", None, None), ("b", None, "T1", "T3"), ("c", None, "T1", None), ("d", None, None, "T9"), ("e", "T2", "T4", "T5"), ("f", None, "T3", "T1"), ("g", None, "", "é"), ("h", "unknown", None, None)]
    related = spark.createDataFrame(rows, "relationship_id string, label string, s string, e string").select("relationship_id", F.struct(F.col("label").alias("time_label"), F.col("s").alias("time_start"), F.col("e").alias("time_end")).alias("story_time"))
    times = ["T0", "T1", "T10", "T2", "T2", "T3", "T4", "é", "unknown", None]
    got = intervals.active_at(related, spark.createDataFrame([(t,) for t in times], "time_value string"))
    want = {(i, t) for i, label, s, e in rows for t in times if t is not None and (label == t or s is not None and s <= t and (e is None or e >= t))}
    assert sorted(map(tuple, got.collect())) == sorted(want)
