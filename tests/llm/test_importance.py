"""Importance resampling against a plain version, and on hard inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text: str | None, longest: int) -> Counter:
    w = WORDS.findall((text or "").translate(LOW))
    return Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def plain(rows, target, longest=2, buckets=10_000, seed=7):
    """doc_id, n_words, n_features, weight, score of each row."""
    def totals(texts):
        out = [0] * buckets
        for t in texts:
            for f, n in features(t, longest).items():
                out[zlib.crc32(f.encode()) % buckets] += n
        return out

    s, t = totals(x for _, x in rows), totals(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        own = features(text, longest)
        n = sum(own.values())
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] * k for f, k in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(WORDS.findall((text or "").translate(LOW))), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "The of AND straße été naïve x1 42 sea 😀 lore weave don't end-of-line".split()
    out = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    return [*out, (150, None), (151, ""), (152, " \n\t"), (153, "one"), (None, out[3][1]), (3, out[3][1]), (154, out[3][1]), (155, "of " * 30_000), (156, " ".join(rng.choices(words, k=40_000)))]


TARGET = ["the sea of lore", "Weave, weave the SEA", None, "", "été 42 42"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_scores(spark, rows, longest, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 4000)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, share string, total string, rank int").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.importance_scores(docs, target, longest=longest, buckets=500).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, TARGET, longest, 500), key=key)


def test_ranks(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = plain(rows, TARGET)
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = fit[: 25 * len(fit) // 100]
    got = importance.importance_ranks(docs, target).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    kept = importance.resampled(docs.withColumnRenamed("text", "body"), target.withColumnRenamed("text", "body"), text="body")
    assert kept.columns == ["doc_id", "body"] and {r.doc_id for r in kept.collect()} == {r[0] for r in drawn}


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_ranks(none, docs).count() == 0
    assert sorted(map(tuple, importance.importance_scores(docs, none).collect())) == sorted(plain(rows[:5], []))


def test_blocks_count_what_a_counter_counts():
    bodies = [("of the sea " * 50).encode(), b"", b"the", ("x " * 9 + "the sea").encode()]
    b = importance.Block(bodies, 3, 5)
    got = [Counter() for _ in bodies]
    postings = np.split(b.postings, np.cumsum(b.sizes)[:-1])
    for f, own in zip(b.strings.to_pylist(), postings):
        for p in own:
            got[p & (importance.BLOCK_DOCS - 1)][f.decode()] += (int(p) >> importance.PLACE_BITS) + 1
    assert got == [features(x.decode(), 3) for x in bodies]


def test_dictionary_hashes_a_feature_once(monkeypatch):
    seen, real = [], zlib.crc32
    monkeypatch.setattr(importance.zlib, "crc32", lambda f: seen.append(f) or real(f))
    d = importance.Dictionary(100)
    for features, counts in (([b"a", b"b"], [1, 2]), ([], []), ([b"b", b"a b", b"a"], [3, 4, 5])):
        d.add(pa.array(features, pa.binary()), np.array(counts, np.int64))
    buckets, totals = d.told()
    assert sorted(seen) == [b"a", b"a b", b"b"]
    of = {f: real(f) % 100 for f in set(seen)}
    assert [x.tolist() for x in buckets] == [[of[b"a"], of[b"b"]], [], [of[b"b"], of[b"a b"], of[b"a"]]]
    assert totals.sum() == 15 and totals[of[b"a"]] >= 6
